"""JSON inside free text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _spans(text: str) -> dict[int, int]:
    """Start of the bracketed part that ends at each closing brace, from one scan.

    Quotes decide what stands inside strings, as seen from a brace: braces with
    an even number of quotes between them are on one level, so two stacks are kept.
    """
    stacks: tuple[list[int], list[int]] = ([], [])
    starts: dict[int, int] = {}
    side, escaped = 0, False
    for i, c in enumerate(text):
        if c == "\\":
            escaped = not escaped
            continue
        if c == '"' and not escaped:
            side ^= 1
        elif c == "{":
            stacks[side].append(i)
        elif c == "}" and stacks[side]:
            starts[i] = stacks[side].pop()
        escaped = False
    return starts


def last_object_in(text: str | None) -> str | None:
    """The part of the text that is the JSON object which ends last, or None."""
    import json

    starts = _spans(text or "")
    for stop in sorted(starts, reverse=True):
        try:
            if isinstance(json.loads(part := text[starts[stop] : stop + 1]), dict):
                return part
        except (ValueError, RecursionError):
            continue
    return None


@F.pandas_udf(StringType())
def last_object(said: pd.Series) -> pd.Series:
    """F-JSON2: the last balanced JSON object in a text; no expression of Spark matches brackets."""
    return said.map(last_object_in)


def first_array(said: Column) -> Column:
    """F-JSON2: the first bracketed part, not greedy."""
    return F.regexp_extract(said, r"(?s)\[.*?\]", 0)


def strip_fence(said: Column) -> Column:
    """A text without the code fence around it."""
    return F.trim(F.regexp_replace(F.trim(said), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"))


def parse_extractions(df: DataFrame, key: str, said: str, targets: dict[str, bool]) -> DataFrame:
    """F-JSON1: key, target, success, value. Unknown targets go; a required one that is missing gives a failed row."""
    shape = "struct<extractions:array<struct<target_name:string,success:boolean,content:string>>>"
    got = df.select(F.col(key), F.from_json(strip_fence(F.col(said)), shape)["extractions"].alias("x"))
    wanted = F.array(*(F.struct(F.lit(t).alias("target"), F.lit(r).alias("required")) for t, r in targets.items()))
    each = got.select(key, "x", F.explode(wanted).alias("w"))
    hit = F.get(F.filter(F.coalesce("x", F.array().cast("array<struct<target_name:string,success:boolean,content:string>>")), lambda e: e["target_name"] == F.col("w")["target"]), F.lit(0))
    out = each.select(key, F.col("w")["target"].alias("target"), F.col("w")["required"].alias("required"), hit.alias("hit"))
    return out.where(F.col("hit").isNotNull() | F.col("required")).select(key, "target", F.coalesce(F.col("hit")["success"], F.lit(False)).alias("success"), F.col("hit")["content"].alias("value"))
