"""Rows and columns that are computed once, or evenly over all tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column so that it is evaluated once per row.

    A filter on a projected column is pushed below the projection and takes a
    copy of its expression along; a parsed document then gets parsed again for
    every test made on it.  The output of a generator is not copied.  Filters on
    other columns and column pruning still reach the scan.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    computed = df.withColumn(name, value)
    return computed.select(*kept, F.explode(F.array(name)).alias(name))


def dealt(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the shuffle's partitions, before costly work per row.

    A table of millions of narrow rows can be a file of a few megabytes, which one
    task reads; without a shuffle that task does all work that follows, too.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may do without that setting and gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """The rows of a frame that several outputs are made from, written once.

    They go to the shared folder, so a lost executor does not bring the work back.
    """
    path = shared_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
