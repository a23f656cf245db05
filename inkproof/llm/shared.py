"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` (or the context's own checkpoint folder).

    Where neither is set, a local session is given a temporary folder; on a cluster that would be another disk for
    each executor, so there it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='run-')}")
        folder = context.getCheckpointDir()
    return folder if ":" in folder else f"file://{folder}"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Texts travel to Python in batches of at most so many rows, unless the session has a setting of its own.

    Rows here are whole documents, so the default of 10,000 would hold tens of megabytes on either side of
    every Python worker, and more where long texts meet.
    """
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name) == default:
        spark.conf.set(name, str(rows))


def cut(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut by a reliable checkpoint in the shared folder."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(frame.sparkSession))
    return frame.checkpoint()


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame written as Parquet into the shared folder and read again: columnar, so later reads are pruned."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def binary_text(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; a null is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have (in any case, as Spark resolves names)."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def key_exchange(name: str) -> Column:
    """An expression equal to a string key, but not the same as it to the optimizer.

    A join on it is given an exchange of its own on both sides instead of using the one below the
    aggregation that made one side, and only then can adaptive execution split a hot key.
    """
    return F.concat(F.col(name), F.lit("/"))
