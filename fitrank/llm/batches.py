"""Shared pieces of the operators whose work runs in Arrow batches inside Spark tasks."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 62  # a place among 2^62 is exact for any number of rows
SLICE_BYTES = 4 << 20  # text bytes that a task handles at once; a longer single text is one slice


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, *others: str
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Row slices of about ``limit`` text bytes, each with its texts; a null text is empty.

    Texts in ``others`` count too.  Every row is in exactly one slice, whole, so memory is bounded by
    the limit plus the longest row.
    """
    for batch in batches:
        lengths = sum(
            pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
            for name in (column, *others)
        )
        start, size = 0, 0
        for row, length in enumerate(lengths.tolist()):
            size += length
            if size >= limit or row == batch.num_rows - 1:
                part = batch.slice(start, row + 1 - start)
                yield part, [text or "" for text in part.column(column).to_pylist()]
                start, size = row + 1, 0


def as_batch(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def narrow(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The id and the text only, so that extra columns and their names can't matter."""
    return docs.select(
        docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text")
    )


def hash_place(name: str) -> Column:
    """A place from 0 to 2^62 - 1 by a hash of doc_id, another one for each name."""
    return F.pmod(F.xxhash64("doc_id", F.lit(name)), F.lit(1 << HASH_BITS))


def hash_share(wanted: int, available: int) -> Column:
    """The place below which about ``wanted`` of the available rows are."""
    return F.lit((1 << HASH_BITS) * min(wanted, max(available, 1)) // max(available, 1)).cast("bigint")


def columns_apart(*used: str) -> Callable:
    """For an operator on documents that carries their columns: those that it doesn't use bear neutral
    names inside of it, so that no name of a user's column can clash with one of its own."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **options) -> DataFrame:
            inside = [n if n in used else f"column_{i}" for i, n in enumerate(docs.columns)]
            outside = dict(zip(inside, docs.columns, strict=True))
            out = operator(docs.toDF(*inside), *args, **options)
            return out.toDF(*(outside.get(n, n) for n in out.columns))

        return run

    return wrap
