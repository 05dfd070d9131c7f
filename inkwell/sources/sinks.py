"""Sinks (K1-K12): atomic tables, exports and small reports."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import files


def replace_table(df: DataFrame, folder: str, name: str) -> str:
    """Write a new version beside the old ones; readers take the last one that a finished write left, so a failed job changes nothing."""
    spark = df.sparkSession
    last = max((int(p.rsplit("/v-", 1)[1]) for p in files.found(spark, f"{folder}/{name}/v-*")), default=0)
    path = f"{folder}/{name}/v-{last + 1:012d}"
    df.write.parquet(path)
    return path


def current_version(spark: SparkSession, folder: str, name: str) -> str | None:
    """The path of the last finished version: the committer marks a version when all of it is there."""
    done = files.found(spark, f"{folder}/{name}/v-*/_SUCCESS")
    return max(done).rsplit("/", 1)[0] if done else None


def current_table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    """The table's last finished version, or None."""
    path = current_version(spark, folder, name)
    return None if path is None else spark.read.parquet(path)


def tables(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the tables of a folder."""
    return files.found(spark, f"{folder}/*")


def drop_old_versions(spark: SparkSession, folder: str, name: str) -> None:
    """Delete all versions but the last finished one and newer ones that are being written."""
    keep = current_version(spark, folder, name)
    for path in files.found(spark, f"{folder}/{name}/v-*"):
        if keep is not None and path < keep:
            files.remove(spark, path)


def brief(entries: DataFrame) -> DataFrame:
    """K7: (report_id, text): a markdown report of each report_id, one numbered section an entry (place, title, url, summary). S18 reads it back."""
    link = F.when(F.col("url").isNull(), F.col("title")).otherwise(F.concat(F.lit("["), "title", F.lit("]("), "url", F.lit(")")))
    part = F.concat(F.lit("## "), F.col("place").cast("string"), F.lit(". "), link, F.lit("\n"), F.coalesce("summary", F.lit("")), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", part.alias("part")))), lambda x: x["part"])
    return entries.groupBy("report_id").agg(F.concat(F.lit("# "), F.col("report_id").cast("string"), F.lit("\n\n"), F.array_join(parts, "\n")).alias("text"))


def write_reports(reports: DataFrame, folder: str) -> int:
    """K7: one file a report, each atomically; reports are few and small, and come to the driver one by one."""
    n = 0
    for r in reports.select("report_id", "text").toLocalIterator():
        write_text(f"{folder}/{r['report_id']}.md", r["text"])
        n += 1
    return n


def append(df: DataFrame, folder: str, name: str) -> None:
    """K6: append rows; the committer makes all of them visible or none."""
    df.write.mode("append").parquet(f"{folder}/{name}")


def feedback_csv(entries: DataFrame) -> DataFrame:
    """K8: feedback as flat rows, reasons joined by commas."""
    return entries.withColumn("reasons", F.array_join("reasons", ","))


def sharegpt(trajectories: DataFrame) -> Column:
    """K9: a trajectory as one JSON line of conversation turns."""
    turns = F.transform("turns", lambda t: F.struct(F.when(t["action"] == "user", "human").otherwise("gpt").alias("from"), t["text"].alias("value")))
    return F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), turns.alias("conversations")))


def trajectory_csv(trajectories: DataFrame) -> DataFrame:
    """K9: short question and a score of three places."""
    return trajectories.select("conv_id", F.substring("question", 1, 100).alias("question"), F.format_string("%.3f", "score").alias("score"), "n_turns")


def write_text(path: str, text: str) -> None:
    """K7: a small report, atomically: a file beside it is renamed."""
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temp, path)


def mark_done(spark: SparkSession, ids: DataFrame, folder: str, run: str) -> None:
    """Ids of finished work, by run; pending work is an anti-join with them."""
    ids.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(folder)


def pending(work: DataFrame, folder: str, run: str, key: str) -> DataFrame:
    """K11, P15."""
    done = work.sparkSession.read.parquet(folder).where(F.col("run") == run).select(key)
    return work.join(done, key, "left_anti")
