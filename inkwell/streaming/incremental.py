"""Incremental processing with Structured Streaming.

A feed of papers is read as a stream. Which identities have been seen is state
of the stream, kept by key in its checkpoint, so a micro-batch touches the keys
that it brings and never reads what was registered before. Each micro-batch
writes its new rows to one folder; one that is run again after a failure
overwrites its own folder and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def registry(spark: SparkSession, folder: str) -> DataFrame | None:
    """M7: all that earlier batches registered, or None."""
    try:
        return spark.read.parquet(f"{folder}/batch=*")
    except Exception as e:  # the first batch finds no folder
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def first_seen(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """M2, M7: the rows of keys that no earlier micro-batch brought: the first of each key in an order."""

    def first(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = None
        for f in frames:
            top = f.sort_values(order, kind="stable").head(1)
            best = top if best is None else pd.concat([best, top]).sort_values(order, kind="stable").head(1)
        if not state.exists:
            state.update((True,))
            yield best

    return stream.groupBy(key).applyInPandasWithState(first, stream.schema, "seen boolean", "append", "NoTimeout")


def poll(spark: SparkSession, stream: DataFrame, folder: str, checkpoint: str, key: str, order: list[str], score=None) -> DataFrame | None:
    """M1, M3, M8: run all that has arrived, batch by batch, then stop; the checkpoint resumes where the last run ended."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = batch if score is None else batch.withColumn("score", score)
        rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    q = first_seen(stream, key, order).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return registry(spark, folder)


def windowed(stream: DataFrame, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event time; rows later than ``late`` are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of users."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def changed_queries(current: DataFrame, state: DataFrame) -> DataFrame:
    """M6: (topic, query_hash, changed): a topic seen first isn't changed."""
    new = current.select("topic", F.sha2("query", 256).alias("query_hash"))
    return new.join(state.select("topic", F.col("query_hash").alias("old")), "topic", "left").select("topic", "query_hash", F.coalesce(F.col("old") != F.col("query_hash"), F.lit(False)).alias("changed"))


def backfill(history: DataFrame, subscriptions: DataFrame, as_of: str, most_days: int, cap: int) -> DataFrame:
    """M4: for each subscription up to ``cap`` rows of the window before its cursor, by id."""
    from inkwell.functions.time import backfill_window
    from inkwell.operators.graph import top_per

    start, end = backfill_window(F.col("cursor"), F.col("created"), F.lit(as_of).cast("date"), most_days)
    rows = subscriptions.select("subscription_id", "topic", start.alias("s"), end.alias("e")).join(history, "topic").where("day >= s and day < e")
    return top_per(rows, ["subscription_id"], [F.col("paper_id")], cap).select("subscription_id", "paper_id")


def retained(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    """M10."""
    return rows.where(F.col("computed_at") >= F.date_sub(F.lit(as_of).cast("date"), days))
