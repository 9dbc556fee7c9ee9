"""Keyword lists kept in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitrank.schemas import BLOCKLISTS


def read_blocklists(spark: SparkSession, path: str) -> DataFrame:
    """(list_name, keyword) of files ``{company_blocklist: [...], title_blocklist: [...]}``."""
    lists = spark.read.schema(BLOCKLISTS).option("multiLine", True).json(path)
    named = F.array(
        *[
            F.struct(F.lit(n).alias("list_name"), F.col(n).alias("keywords"))
            for n in BLOCKLISTS.names
        ]
    )
    return lists.select(F.inline(named)).select("list_name", F.explode("keywords").alias("keyword"))
