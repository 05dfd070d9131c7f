"""Report aggregates (A10-A13, A22, A24, A27, A28) and run states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Hexadecimal digits that name a bucket of a registry's items.
BUCKET_DIGITS = 3


def partition_counts(rows: DataFrame, column: str, providers: tuple[str, ...]) -> DataFrame:
    """A10: rows of providers and of the other sources."""
    inside = F.col(column).isin(*providers)
    return rows.agg(F.count_if(inside).alias("provider"), F.count_if(~inside).alias("citation"))


def percentage(part: Column, whole: Column, places: int = 2) -> Column:
    """0 where the whole is 0."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)) * 100, places)


def extraction_summary(runs: DataFrame) -> DataFrame:
    """A12."""
    ok = F.count_if(F.col("tokens") > 0)
    return runs.agg(F.count("*").alias("n"), ok.alias("ok"), percentage(ok, F.count("*"), 1).alias("success_rate"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 4).alias("avg_tokens"))


def provider_overlap(results: DataFrame) -> DataFrame:
    """Ids that come more than once, even from one provider; distinct ids; the provider of most results."""
    ids = results.groupBy("id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("overlap"), F.count("*").alias("unique_ids"))
    most = results.groupBy("provider").agg(F.count("*").alias("n")).agg(F.max(F.struct("n", (-F.ascii("provider")).alias("o"), "provider"))["provider"].alias("most_results"))
    return ids.join(F.broadcast(most))  # single rows


def cost_ledger(costs: DataFrame, price: float) -> DataFrame:
    """Tokens and cost by provider and day, with totals by provider and of all."""
    return costs.rollup("provider", "day").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / 1e6 * price, 6).alias("cost"))


def histogram(rows: DataFrame, by: list[str], value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative counts up to each bound, from one aggregate."""
    counts = rows.groupBy(*by).agg(*(F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(bounds)))
    pairs = F.array(*(F.struct(F.lit(b).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)))
    return counts.select(*by, F.explode(pairs).alias("x")).select(*by, "x.*")


def registry_hash(rows: DataFrame, by: list[str], item: Column) -> DataFrame:
    """Digest of each group's items, whatever their order.

    A group's items are dealt by the first digits of their own digests; the
    digests of the sorted buckets, in order, make the group's. So no array holds
    a whole group: a bucket has 1 / 4096 of it, and a group 4096 digests.
    """
    dealt = rows.select(*by, item.alias("_item")).withColumn("_bucket", F.substring(F.sha2("_item", 256), 1, BUCKET_DIGITS))
    parts = dealt.groupBy(*by, "_bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_item")), "|"), 256).alias("_part"))
    return parts.groupBy(*by).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_bucket", "_part"))), lambda x: x["_part"]), ""), 256).alias("registry_hash"))


def run_status(ok: Column, failed: Column) -> Column:
    """A28."""
    return F.when(failed == 0, "success").when(ok == 0, "failure").otherwise("partial")
