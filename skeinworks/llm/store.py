"""Tables in the folder that the cluster shares: cut lineage, and rows under numbers of their own."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session that names none, as in tests, gets a new one; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="skein-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept with replicas: later jobs read it, and lost executors don't undo it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, **options) -> DataFrame:
    """``df`` as ``stable`` gives it, but in a compressed table: for results of about the size of the input."""
    folder = new_folder(df.sparkSession, "table")
    df.write.options(compression="zstd", **options).parquet(folder)
    return df.sparkSession.read.parquet(folder)


def whole(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct, in which no name can clash with a column of ours."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def numbered(docs: DataFrame) -> DataFrame:
    """(row, kept): every row of ``docs``, as a struct, under a number of its own, written to the shared folder.

    Numbers come from the written table, so they stay the same whatever runs again. Null and repeated keys of
    ``docs`` don't matter to it.
    """
    return written(docs.select(F.monotonically_increasing_id().alias("row"), whole(docs).alias("kept")))
