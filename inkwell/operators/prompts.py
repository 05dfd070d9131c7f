"""Query and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.operators.graph import top_per


def query_slots(queries: DataFrame, key: str, order: str, slots: int, original_weight: float = 1.5) -> DataFrame:
    """The first queries of each key fill its slots; the original one weighs more."""
    return top_per(queries, [key], [F.col(order)], slots, "place").withColumn("weight", F.when(F.col("place") == 1, original_weight).otherwise(1.0))


def select_provider(query: Column, rules: list[tuple[tuple[str, ...], str]], default: str) -> Column:
    """The provider of the first rule one of whose terms the query contains."""
    out = F.lit(default)
    for terms, provider in reversed(rules):
        out = F.when(F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(query), t)), provider).otherwise(out)
    return out


def cache_key(query: Column, strategy: Column, titles: Column) -> Column:
    """N23."""
    return F.sha2(F.concat_ws("|", F.lower(query), strategy, titles), 256)


def least_recently_used(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The rows that a cache of this size keeps."""
    return rows.orderBy(*order).limit(most)


def paper_prompt(title: Column, authors: Column, abstract: Column) -> Column:
    """Five authors at most; an abstract of 500 characters or more is cut."""
    a = F.coalesce(abstract, F.lit(""))
    short = F.when(F.length(a) >= 500, F.concat(F.substring(a, 1, 497), F.lit("..."))).otherwise(a)
    return F.concat(F.lit("Title: "), title, F.lit("\nAuthors: "), F.array_join(F.slice(authors, 1, 5), ", "), F.lit("\nAbstract: "), short)


def truncate_prompt(rows: DataFrame, key: list[str], size: str, most: int, order: list[Column]) -> DataFrame:
    """Where a key's rows are too large together, its first max(1, int(n ratio 0.8)) rows stay."""
    sums = rows.groupBy(*key).agg(F.sum(size).alias("_t"), F.count("*").alias("_n"))
    placed = rows.join(sums, key).withColumn("_p", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    keep = (F.col("_t") <= most) | (F.col("_p") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(float(most)) / F.col("_t") * 0.8)))
    return placed.where(keep).drop("_t", "_n", "_p")


def abstract_markdown(title: Column, venue: Column, year: Column, abstract: Column) -> Column:
    """N27."""
    known = lambda c, d: F.coalesce(c.cast("string"), F.lit(d))
    return F.concat(F.lit("# "), title, F.lit("\n**Venue:** "), known(venue, "Unknown"), F.lit("\n**Year:** "), known(year, "Unknown"), F.lit("\n\n"), known(abstract, "No abstract available"))
