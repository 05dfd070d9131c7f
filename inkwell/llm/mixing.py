"""Mixing sources to target weights.

Tokens are summed by source, each source's share of the whole is set from its
weight, and the repetition rate of a source is its target over its size. Each
document is emitted floor(rate) times, and once more by a coin whose seed is
the document's id and whose probability is the fraction, so that reruns agree.

Defined results: a null text has no words; a null source is a source of its own
and comes last; a document without words is emitted at its source's rate, or
not at all where the whole source has none. A row with a null id is seeded by
its text; repeated rows fall alike. Extra columns are left as they are by
``emit`` and left out by ``plan``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import WORD, cut

#: Weights of the sources in code-point order, repeating; a target is at most this many times the source's size.
WEIGHTS, MOST_REPEATS, SEED = (1, 2, 3), 3, "mix-1"
#: Up to so many sources the targets are solved on the driver and broadcast, beyond it by aggregates and a shuffled join.
DRIVER_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def solve(sizes: list[int], weights: list[int], most: int) -> list[float]:
    """Targets that share the whole by weight, capped at ``most`` times the size, the excess reshared."""
    total, free = sum(sizes), list(range(len(sizes)))
    target = [0.0] * len(sizes)
    rest, weight = total, sum(weights)
    for i in sorted(free, key=lambda i: most * sizes[i] / weights[i]):
        # In this order a source that stays below its cap is followed by such sources only.
        if rest * weights[i] > most * sizes[i] * weight:
            target[i] = float(most * sizes[i])
            rest, weight = rest - most * sizes[i], weight - weights[i]
        else:
            target[i] = rest * weights[i] / weight if weight else 0.0
    return target


def _numbered(sources: DataFrame) -> DataFrame:
    """The sources with their place in code-point order, nulls last; no step gathers them in one task."""
    spark = sources.sparkSession
    parts = cut(sources.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))
    heads = sorted((r["part"], r["n"], r["least"]) for r in parts.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("least")).collect())
    shifts, before = [], 0
    for _, n, least in heads:
        shifts.append(before - least)
        before += n
    shift = spark.createDataFrame(pa.table({"part": pa.array([h[0] for h in heads], pa.int32()), "shift": pa.array(shifts, pa.int64())}))
    return parts.join(F.broadcast(shift), "part").select("source", "source_size", (F.col("id") + F.col("shift")).alias("place"))


def _solve_far(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``solve`` over a table of any number of sources: each round caps what exceeds and reshares the rest."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    table = cut(_numbered(sources).select("source", "source_size", weight.cast("long").alias("weight"), F.lit(False).alias("capped")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while True:
        taken, free = table.agg(F.sum(F.when(F.col("capped"), most * F.col("source_size"))), F.sum(F.when(~F.col("capped"), F.col("weight")))).first()
        rest, free = total - (taken or 0), free or 1
        share = F.lit(rest).cast("double") * F.col("weight") / F.lit(free).cast("double")
        new = ~F.col("capped") & (F.lit(rest).cast("decimal(38,0)") * F.col("weight") > F.lit(most * free).cast("decimal(38,0)") * F.col("source_size"))
        if not table.where(new).limit(1).count():
            return table.select("source", "source_size", F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(share).alias("target"))
        table = cut(table.withColumn("capped", F.col("capped") | new))


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, driver_sources: int = DRIVER_SOURCES) -> tuple[DataFrame, bool]:
    """source, source_size, target of all sources, and whether the table is small enough to broadcast."""
    spark = sized.sparkSession
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    if sums.count() > driver_sources:
        return _solve_far(sums, tuple(weights), most), False
    rows = sorted((tuple(r) for r in sums.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    share = [weights[i % len(weights)] for i in range(len(rows))]
    sizes = [n for _, n in rows]
    # An Arrow table needs no Python workers; a list of rows starts a daemon and its workers in every executor.
    return spark.createDataFrame(pa.table({"source": pa.array([s for s, _ in rows], pa.string()), "source_size": pa.array(sizes, pa.int64()), "target": pa.array(solve(sizes, share, most), pa.float64())})), True


def _with_rates(sized: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    # The null-safe key is never null, so that both joins can hash it.
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    table = table.select(key(F.col("source")).alias("_k"), "source_size", "target")
    return sized.withColumn("_k", key(F.col("source"))).join(F.broadcast(table) if small else table, "_k").drop("_k")


def copies(doc_id: Column, text: Column, source_size: Column, target: Column, seed: str = SEED) -> Column:
    """How often a document is emitted: the whole part of the rate, and the seeded coin for the fraction."""
    rate = F.when(source_size > 0, target / source_size).otherwise(0.0)
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text, F.lit("")))))
    coin = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST_REPEATS, driver_sources: int = DRIVER_SOURCES) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every document."""
    sized = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), F.when(F.col(id_col).isNull(), F.col(text_col)).alias("text"))
    table, small = targets(sized.select("source", "size"), weights, most, driver_sources)
    rated = _with_rates(sized, table, small).withColumn("copies", copies(F.col("doc_id"), F.col("text"), F.col("source_size"), F.col("target")))
    return rated.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST_REPEATS, driver_sources: int = DRIVER_SOURCES) -> DataFrame:
    """The mix itself: every row of df as often as the plan takes it, with all its columns."""
    sized = df.select(F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"))
    table, small = targets(sized, weights, most, driver_sources)
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(source_col).cast("string").alias("source"))
    rated = _with_rates(whole, table, small)
    n = copies(F.col(f"row.{id_col}"), F.col(f"row.{text_col}"), F.col("source_size"), F.col("target"))
    return rated.withColumn("n", n).where("n > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).select("row.*")
