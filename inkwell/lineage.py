"""Lineage cuts for iterative operators."""

from __future__ import annotations

import tempfile

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    A folder of our own is made only where that is unset and one process is all
    there is, as in tests.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="inkwell-"))
    return named or sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share; it goes when the application ends."""
    path = f"{shared_folder(spark)}/{uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written once to the folder that all executors share, and read again; it goes when the application ends.

    A checkpoint would compute its last stage twice, and its reader knows no
    columns or sizes.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
