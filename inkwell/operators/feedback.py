"""Feedback analytics and preference learning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

RATINGS = ("thumbs_up", "thumbs_down", "neutral")


def matching(entries: DataFrame, topic: str | None = None, rating: str | None = None, any_reason: tuple[str, ...] = (), start: str | None = None, end: str | None = None, ids: tuple[int, ...] = ()) -> DataFrame:
    """Entries that meet every condition given."""
    test = F.lit(True)
    if topic is not None:
        test &= F.col("topic") == topic
    if rating is not None:
        test &= F.col("rating") == rating
    if any_reason:
        test &= F.arrays_overlap("reasons", F.array(*map(F.lit, any_reason)))
    if start is not None:
        test &= F.col("ts") >= F.lit(start).cast("timestamp")
    if end is not None:
        test &= F.col("ts") <= F.lit(end).cast("timestamp")
    if ids:
        test &= F.col("paper_id").isin(*ids)
    return entries.where(test)


def ratings(entries: DataFrame) -> DataFrame:
    """(rating, n) with a row for each rating, also those without entries."""
    count = lambda r: F.count_if(F.col("rating") == r)
    row = entries.agg(*(count(r).alias(r) for r in RATINGS))
    return row.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rating"), F.col(r).alias("n")) for r in RATINGS))).alias("x")).select("x.*")


def top_reasons(entries: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The most frequent reasons, of all entries or by key; ties by name."""
    counts = entries.select(*(by or []), F.explode("reasons").alias("reason")).groupBy(*(by or []), "reason").agg(F.count("*").alias("n"))
    order = [F.col("n").desc(), F.col("reason")]
    if not by:
        return counts.orderBy(*order).limit(k)
    return counts.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def by_topic(entries: DataFrame) -> DataFrame:
    """Counts by rating and the share of thumbs up; entries without a topic are ``_uncategorized``."""
    up = F.count_if(F.col("rating") == "thumbs_up")
    counts = [F.count_if(F.col("rating") == r).alias(r) for r in RATINGS]
    return entries.groupBy(F.coalesce("topic", F.lit("_uncategorized")).alias("topic")).agg(F.count("*").alias("total"), *counts, F.coalesce(F.try_divide(up, F.count("*")), F.lit(0.0)).alias("positive_ratio"))


def trending(entries: DataFrame, newest: int = 50, k: int = 5) -> DataFrame:
    """Reasons of the thumbs up among the newest entries."""
    return top_reasons(entries.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(newest).where(F.col("rating") == "thumbs_up"), k)


def submit(entries: DataFrame, new: DataFrame) -> DataFrame:
    """One entry a paper; an update keeps the id, and the topic where it brings none. Columns: paper_id, entry_id, topic, rating, ts."""
    old = entries.select("paper_id", F.col("entry_id").alias("_id"), F.col("topic").alias("_topic"))
    changed = new.join(old, "paper_id", "left").select("paper_id", F.coalesce("_id", "entry_id").alias("entry_id"), F.coalesce("topic", "_topic").alias("topic"), "rating", "ts")
    return entries.join(new.select("paper_id"), "paper_id", "left_anti").select(changed.columns).unionByName(changed)


def archive(entries: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """The newest entries and the others. The cut is found by a top-k, so no task sorts all."""
    newest = entries.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(keep)
    return newest, entries.join(newest.select("event_id"), "event_id", "left_anti")


def beta_means(entries: DataFrame) -> DataFrame:
    """(paper_id, ups, downs, preference): mean of Beta(1 + ups, 1 + downs)."""
    up, down = F.count_if(F.col("rating") == "thumbs_up"), F.count_if(F.col("rating") == "thumbs_down")
    return entries.groupBy("paper_id").agg(up.alias("ups"), down.alias("downs"), ((1 + up) / (2 + up + down)).alias("preference"))


def blend(preference: Column, base: Column, share: float = 0.3) -> Column:
    """Preference, 0.5 where unknown, mixed with the base score."""
    return share * F.coalesce(preference, F.lit(0.5)) + (1 - share) * base


def thompson(papers: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """The n papers of the largest draw from their Beta distributions; draws depend on seed and paper alone."""

    @F.pandas_udf(DoubleType())
    def draw(ids: pd.Series, ups: pd.Series, downs: pd.Series) -> pd.Series:
        return pd.Series([np.random.default_rng([seed, int(i)]).beta(1 + u, 1 + d) for i, u, d in zip(ids, ups, downs, strict=True)], dtype="float64")

    return papers.withColumn("draw", draw("paper_id", "ups", "downs")).orderBy(F.col("draw").desc(), "paper_id").limit(n)


class RidgeModel:
    """Weights over standardised features, with a sigmoid at the end."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, weights: np.ndarray):
        self.mean, self.deviation, self.weights = mean, deviation, weights

    @classmethod
    def fit(cls, rows: DataFrame, features: str, label: str, penalty: float = 0.1) -> RidgeModel:
        """Solve (X'X + penalty I) w = X'y. The sums that this needs are one aggregate of (d + 2) squared numbers, made on the executors."""
        import pyarrow as pa

        def sums(batches):
            total = None
            for b in batches:
                if b.num_rows:
                    x = np.array(b.column(0).to_pylist(), float)
                    y = np.array(b.column(1).to_pylist(), float)[:, None]
                    z = np.hstack([np.ones((len(x), 1)), x, y])
                    total = z.T @ z if total is None else total + z.T @ z
            if total is not None:
                yield pa.RecordBatch.from_pydict({"i": list(range(total.size)), "v": total.ravel().tolist()}, schema=pa.schema([("i", pa.int32()), ("v", pa.float64())]))

        flat = rows.select(F.col(features).cast("array<double>"), F.col(label).cast("double")).where(F.col(label).isNotNull()).mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        d = int(round(len(flat) ** 0.5))
        if not d:
            return cls(np.zeros(0), np.ones(0), np.zeros(0))
        g = np.zeros(d * d)
        for r in flat:
            g[r["i"]] = r["v"]
        g = g.reshape(d, d)
        n, mean = g[0, 0], g[0, 1:-1] / g[0, 0]
        cov = g[1:-1, 1:-1] - n * np.outer(mean, mean)
        deviation = np.sqrt(np.maximum(np.diag(cov) / n, 0)) + 1e-8
        gram = cov / np.outer(deviation, deviation)
        xy = (g[1:-1, -1] - mean * g[0, -1]) / deviation
        return cls(mean, deviation, np.linalg.solve(gram + penalty * np.eye(d - 2), xy))

    def predict(self, features: Column) -> Column:
        """A sum of products in the JVM; the constants move into one intercept."""
        w = self.weights / self.deviation
        dot = F.aggregate(F.zip_with(features.cast("array<double>"), F.array(*(F.lit(float(x)) for x in w)), lambda a, b: a * b), F.lit(float(-(self.mean * w).sum())), lambda s, t: s + t)
        return 1 / (1 + F.exp(-dot))
