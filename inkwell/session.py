"""Session settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results; the others are left to the cluster.
SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


def build(master: str | None = None, name: str = "inkwell", **more: str) -> SparkSession:
    """A session with the engine's settings; an existing one is kept."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
