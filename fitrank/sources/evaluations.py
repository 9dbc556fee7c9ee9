"""Reading nested evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitrank.schemas import EVALUATION


def read_evaluations(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Evaluations from files that hold a list or one object; ``lines`` reads JSON lines.

    A list file is parsed by one task, so large sets belong into JSON lines, which split.
    """
    return spark.read.schema(EVALUATION).option("multiLine", not lines).json(path)
