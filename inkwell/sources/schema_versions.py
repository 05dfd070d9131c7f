"""Schema versions of stored tables.

A step takes the tables of one version to the next. A step's tables are written
as new table versions first and its number is recorded last, so a step that
fails leaves the recorded version and its tables as they were.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources import sinks

Tables = dict[str, DataFrame]
RECORD = "schema_versions"


@dataclass(frozen=True)
class Step:
    version: int
    name: str
    up: Callable[[SparkSession, Tables], Tables]


def applied(spark: SparkSession, folder: str) -> list[int]:
    """The versions recorded, in order."""
    table = sinks.current_table(spark, folder, RECORD)
    return [] if table is None else sorted(r["version"] for r in table.select("version").collect())  # as many rows as steps


def migrate(spark: SparkSession, folder: str, steps: list[Step]) -> int:
    """Apply the steps that aren't recorded, in order of their versions; how many there were."""
    done = applied(spark, folder)
    waiting = sorted((s for s in steps if s.version not in done), key=lambda s: s.version)
    if len({s.version for s in steps}) != len(steps):
        raise ValueError("two steps have one version")
    for step in waiting:
        names = [p.rstrip("/").rsplit("/", 1)[-1] for p in sinks.tables(spark, folder) if not p.endswith(f"/{RECORD}")]
        now = {n: sinks.current_table(spark, folder, n) for n in names}
        for name, table in step.up(spark, now).items():
            sinks.replace_table(table, folder, name)
        record = spark.createDataFrame([(step.version, step.name)], "version int, name string")
        before = sinks.current_table(spark, folder, RECORD)
        sinks.replace_table((record if before is None else before.unionByName(record)).orderBy(F.col("version")).coalesce(1), folder, RECORD)
    return len(waiting)
