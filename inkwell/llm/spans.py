"""Positions of regular-expression matches, from built-in functions only.

Spark returns matches without their positions. ``split`` returns the text
between the same matches, so the running sum of both lengths gives each match's
start in code points. Blocks of 512 matches keep the array appends linear in
practice for a text with very many matches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 512
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,hit:string>>"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def span_array(text: Column, found: Column, pattern: str, kind: str, kind_no: int, keep) -> Column:
    """array<struct<start, kind_no, end, kind, hit>> of the matches that ``keep(hit)`` accepts.

    ``found`` is the column that holds ``matches(text, pattern)``.
    """
    none = F.array().cast(SPAN)
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), m.alias("hit")))

    def add(acc: Column, e: Column) -> Column:
        start = acc["pos"] + e["gap"]
        end = start + F.length(e["hit"])
        one = F.array(F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), e["hit"].alias("hit")))
        return F.struct(end.alias("pos"), F.when(keep(e["hit"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def block(pairs: Column):
        return lambda acc, first: F.aggregate(
            F.slice(pairs, first, F.lit(BLOCK)),
            F.struct(acc["pos"].alias("pos"), none.alias("out")),
            add,
            lambda part: F.struct(part["pos"].alias("pos"), F.concat(acc["out"], part["out"]).alias("out")),
        )

    # One-element array: binds the zipped pairs to a variable, so that they are built once a text.
    spans = F.transform(
        F.array(pairs),
        lambda z: F.aggregate(F.sequence(F.lit(1), F.size(z), F.lit(BLOCK)), F.struct(F.lit(0).alias("pos"), none.alias("out")), block(z))["out"],
    )[0]
    return F.when(F.size(found) > 0, spans).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
