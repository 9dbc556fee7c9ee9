"""A pool of postings laid out by day, of which a window reads its own days only.

Rows are filed under load and UTC day: ``load_id=.../posted_on=...``.  The day doesn't depend on the
session's time zone.  A window is a test of ``date_posted`` and one of ``posted_on``; the second one
prunes folders before a file is opened, also where ``as_of`` is a subquery, whose value Spark knows
when the scan starts.
"""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitrank.operators.filters import posted_since
from fitrank.schemas import POSTING

DAY = "posted_on"
DAY_FOLDER = re.compile(f"/{DAY}=([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})/")
LAID_OUT = T.StructType(
    [*POSTING.fields, T.StructField("load_id", T.StringType()), T.StructField(DAY, T.DateType())]
)


def utc_day(time: Column) -> Column:
    return F.date_from_unix_date(F.floor(F.unix_seconds(time) / 86400).cast("int"))


def write_pool(postings: DataFrame, path: str, load_id: str) -> None:
    """Write one load; written again under its id it replaces itself and touches no other load.

    Rows meet by day before they are written, so a load has about one file for each day of modest
    size; a day that holds most rows is split by size.  Rows without a date have a folder of their own.
    """
    columns = [
        (F.col(f.name) if f.name in postings.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in POSTING.fields
    ]
    dated = postings.select(*columns).withColumn(DAY, utc_day(F.col("date_posted")))
    by_day = dated.hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY)
    by_day.parquet(f"{path}/load_id={quote(load_id, safe='')}")


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """All rows of all loads, with ``load_id`` and ``posted_on``."""
    return spark.read.schema(LAID_OUT).parquet(path)


def read_window(spark: SparkSession, path: str, as_of: Column, hours: int) -> DataFrame:
    """The rows that ``filter_window`` keeps of the pool, read from the days of the window alone.

    As there, ``as_of`` is a literal or a scalar subquery, and rows without a date are in no window.
    """
    span = F.make_dt_interval(hours=F.lit(hours))
    days = F.col(DAY) >= utc_day(as_of - span)
    rows = read_pool(spark, path).where(days & posted_since(as_of, hours))
    return rows.select(*POSTING.names)


def newest(spark: SparkSession, path: str) -> Column:
    """The latest ``date_posted`` as a scalar subquery, read from the files of the latest day alone.

    The day comes from the listing of the folders, which Spark makes for every scan.
    """
    rows = read_pool(spark, path)
    days = [found.group(1) for file in rows.inputFiles() if (found := DAY_FOLDER.search(file))]
    last = F.lit(max(days, default=None)).cast("date")
    return rows.where(F.col(DAY) == last).agg(F.max("date_posted")).scalar()


def compact_pool(spark: SparkSession, path: str, into: str, load_id: str) -> None:
    """Write all loads as one load of a new pool; the old one isn't touched."""
    write_pool(read_pool(spark, path), into, load_id)
