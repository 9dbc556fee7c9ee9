"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH = "4m"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ``BATCH``, or one row, go to Python for queries that run within.

    By default a batch has 10,000 rows or 64 MB, which an executor holds for each of its tasks and
    a Python worker once more.
    """
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(ARROW_BYTES) if before is None else spark.conf.set(ARROW_BYTES, before)


def settle(frame: DataFrame, label: str) -> DataFrame:
    """The rows, written once as Parquet and read back.

    This cuts the lineage, survives lost executors, and gives the planner the real size.  The folder
    is the one named by ``spark.checkpoint.dir``; only a local session may do without, with a folder
    of its own for the life of the session.
    """
    spark = frame.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or local_folder(spark)
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def local_folder(spark) -> str:
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    import tempfile

    if not hasattr(spark, "_llm_folder"):
        spark._llm_folder = tempfile.mkdtemp(prefix="llm-")
    return spark._llm_folder
