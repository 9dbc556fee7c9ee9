"""Projections and row shaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitrank.functions.fixed_values import POSTING_COLUMNS
from fitrank.functions.labels import make_link

SCORE_SUFFIX = "_score"


def number_text(c: Column) -> Column:
    """A float as output text: whole numbers without a fraction, not-a-number and infinity null."""
    finite = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    # A number too large for the decimal keeps its exponent form.
    whole = F.when(finite == F.floor(finite), finite.try_cast("decimal(38,0)").cast("string"))
    return F.coalesce(whole, finite.cast("string"))


def clean_records(df: DataFrame) -> DataFrame:
    """Output form of the scalar columns: ISO dates, whole floats without fraction, NaN as null.

    Lists, structs and all other types pass unchanged.
    """

    def clean(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = number_text(c.cast("double"))
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            micros = F.date_format(c, "SSSSSS")
            seconds = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
            c = F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))
        elif isinstance(field.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        return c.alias(field.name)

    return df.select([clean(f) for f in df.schema.fields])


def make_job_link(postings: DataFrame, keep_parts: bool = True) -> DataFrame:
    """Add ``job_link``; with ``keep_parts=False`` drop the title and address it is made of."""
    out = postings.withColumn("job_link", make_link(F.col("title"), F.col("job_url")))
    return out if keep_parts else out.drop("title", "job_url")


def keep_columns(df: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """The wanted columns that exist, in the wanted order; nothing wanted means the default list."""
    return df.select([c for c in (wanted or POSTING_COLUMNS) if c in df.columns])


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns without any value.  Costs one pass over the data, as the schema depends on it."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.select([c for c in df.columns if counts[c]])


def select_report_columns(
    df: DataFrame, wanted: Sequence[str], sort_column: str = "final_score"
) -> DataFrame:
    """Wanted columns that exist, then every score column and the sort column not listed."""
    if not wanted:
        return df
    scores = [c for c in df.columns if c.endswith(SCORE_SUFFIX) or c == sort_column]
    # A dictionary keeps the first place of each name.
    return df.select(*dict.fromkeys(c for c in (*wanted, *scores) if c in df.columns))
