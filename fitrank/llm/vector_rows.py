"""Rows of a vector table that take part in a comparison."""

from __future__ import annotations

import pyarrow as pa
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitrank.llm.scratch import settle


def finite(vector: str):
    """Is the vector neither null nor empty, without null, NaN and infinite components?"""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad), F.lit(False))


def one_for_each_id(rows: DataFrame, id_column: str) -> DataFrame:
    """The rows, or of several rows of one id the smallest by the other columns.

    Ids are counted on their own first, so whole rows are shuffled only if an id is repeated.
    """
    rows = settle(rows, "rows")
    repeated = rows.groupBy(id_column).count().filter(F.col("count") > 1)
    if not repeated.limit(1).count():
        return rows
    others = [name for name in rows.columns if name != id_column]
    first = rows.groupBy(id_column).agg(F.min(F.struct(*others)).alias("first"))
    return settle(first.select(id_column, "first.*").select(*rows.columns), "rows")


def matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(flat) == 0:
        return np.zeros((0, 0), kind)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)
