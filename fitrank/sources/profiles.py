"""The text that postings are scored against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitrank.functions.text import strip_markup


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """One row ``text`` of a plain, Markdown or HTML file, without markup and link addresses.

    A profile is one file of one person; a path to several files gives several rows, which the
    scorers refuse.
    """
    files = spark.read.text(path, wholetext=True)
    return files.select(strip_markup(F.col("value")).alias("text"))
