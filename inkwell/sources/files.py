"""Files in whatever store a path names, through Hadoop's file systems, on the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _of(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _of(spark, path)
    return fs.exists(p)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order."""
    fs, p = _of(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Move a file, over another one if need be."""
    fs, p = _of(spark, path)
    _, q = _of(spark, to)
    fs.delete(q, True)
    if not fs.rename(p, q):
        raise OSError(f"{path} was not renamed")


def copy(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _of(spark, path)
    _, q = _of(spark, to)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, fs, q, False, spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _of(spark, path)
    fs.delete(p, True)
