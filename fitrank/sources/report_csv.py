"""The scored report as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Quoting under which texts with quotes and line breaks survive.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}


def write_report_csv(report: DataFrame, path: str) -> None:
    """Header in every part file, no row index.  A sorted report keeps its order over the parts."""
    # White space at the ends of a text is part of it; the writer would strip it by default.
    report.write.options(
        **CSV_OPTIONS, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def read_report_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(**CSV_OPTIONS, multiLine=True).csv(path)
