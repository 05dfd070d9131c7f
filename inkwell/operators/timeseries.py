"""Time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkwell.functions.time import bucket

KEY = ("series_id", "metric_name")


def aggregate(points: DataFrame, unit: str) -> DataFrame:
    """A1: count, sum, mean, least and most of each day, ISO week or month; empty buckets are absent."""
    start, end = bucket(F.col("period"), unit)
    return points.groupBy(*KEY, start.alias("period_start"), end.alias("period_end")).agg(
        F.count("*").alias("n"), F.sum("value").alias("sum_value"), F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value")
    )


def _mean(low: Column, high: Column, closed: bool) -> Column:
    inside = (F.col("period") >= low) & ((F.col("period") <= high) if closed else (F.col("period") < high))
    return F.avg(F.when(inside, F.col("value")))


def velocity(points: DataFrame, as_of: str, window: int) -> DataFrame:
    """A2: difference of the means of the last window, today included, and the one before, for each day of it; null if one is empty."""
    today = F.lit(as_of).cast("date")
    near, far = _mean(F.date_sub(today, window), today, True), _mean(F.date_sub(today, 2 * window), F.date_sub(today, window), False)
    return points.groupBy(*KEY).agg(((near - far) / window).alias("velocity"))


def acceleration(points: DataFrame, as_of: str, window: int) -> DataFrame:
    """A3: change of the velocity over three windows that end before today."""
    today = F.lit(as_of).cast("date")
    m = [_mean(F.date_sub(today, (i + 1) * window), F.date_sub(today, i * window), False) for i in range(3)]
    return points.groupBy(*KEY).agg((((m[0] - m[1]) / window - (m[1] - m[2]) / window) / window).alias("acceleration"))


def rolling_mean(points: DataFrame, window: int) -> DataFrame:
    """At every point, the mean of the window that ends there."""
    day = F.datediff("period", F.lit("1970-01-01").cast("date"))
    w = W.partitionBy(*KEY).orderBy(day).rangeBetween(-window, 0)
    return points.withColumn("rolling", F.avg("value").over(w))


def between(points: DataFrame, series: str, metric: str, start: str, end: str) -> DataFrame:
    """Points of a series in a closed range, in order."""
    return points.where((F.col("series_id") == series) & (F.col("metric_name") == metric) & F.col("period").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("period")


def latest(points: DataFrame, series: str, metric: str, n: int) -> DataFrame:
    """The n latest points."""
    return points.where((F.col("series_id") == series) & (F.col("metric_name") == metric)).orderBy(F.col("period").desc()).limit(n)


def names(points: DataFrame) -> DataFrame:
    """A6."""
    return points.select(*KEY).distinct()


def upsert(table: DataFrame, new: DataFrame, key: list[str], order: str = "ingest_seq") -> DataFrame:
    """K2, K4, K5: of the rows of a key the one of the highest sequence number stays."""
    # max_by keeps one row a key in each partial aggregate, so a hot key isn't gathered.
    both = table.unionByName(new)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row")).select(*key, "row.*")


def delete_range(points: DataFrame, series: str, metric: str | None, start: str | None, end: str | None) -> tuple[DataFrame, DataFrame]:
    """What stays and what goes, both ends included."""
    gone = F.col("series_id") == series
    for test in (None if metric is None else F.col("metric_name") == metric, None if start is None else F.col("period") >= F.lit(start).cast("date"), None if end is None else F.col("period") <= F.lit(end).cast("date")):
        gone = gone if test is None else gone & test
    return points.where(~gone), points.where(gone)
