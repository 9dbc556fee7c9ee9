"""Encoders and pair scorers: built-in defaults, or user models in Arrow batches.

A user plug-in is a factory without arguments.  It is called once per Python worker task, loads its
model there and returns a function over a batch.  Without a factory the defaults run as built-in
expressions.  No text is cut unless the caller gives the window of a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitrank.functions.fixed_values import (
    ENCODER_MODELS,
    PAIR_MODELS,
    POSTING_PREFIX,
    PROFILE_PREFIX,
)
from fitrank.functions.text import tokenize

Encoder = Callable[[pd.Series], "np.ndarray"]
PairScorer = Callable[[pd.Series, pd.Series], "np.ndarray"]

HASH_DIMS = 64
BATCH_BYTES = 4 << 20  # text bytes that a user model gets at once; a longer text comes alone


def known_model(models: dict, name: str):
    if name not in models:
        raise ValueError(f"unknown model {name!r}; valid: {sorted(models)}")
    return models[name]


def encoder_prefixes(model: str) -> tuple[str, str]:
    """Leading instructions (posting, profile) that the named encoder expects."""
    _, instructed = known_model(ENCODER_MODELS, model)
    return (POSTING_PREFIX, PROFILE_PREFIX) if instructed else ("", "")


def pair_model_id(model: str) -> str:
    return known_model(PAIR_MODELS, model)


def hashed_vector(text: Column) -> Column:
    """Default encoder without a model: signed feature hashing of terms into 64 numbers.

    Each term adds 1 to or takes 1 from the place that its MD5 names.  The (place, sign) numbers of
    all terms are sorted together with one of each kind, so a count is the distance of run ends.
    """

    def place(term: Column) -> Column:
        digest = F.md5(term)
        slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % HASH_DIMS
        return (slot * 2 + (F.substring(digest, 9, 1) >= "8").cast("int")).cast("int")

    each = F.sequence(F.lit(0), F.lit(2 * HASH_DIMS - 1))
    ordered = F.array_sort(F.concat(F.transform(tokenize(text), place), each))

    def ends(codes: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(1), F.size(codes)),
            lambda i: (i == F.size(codes)) | (F.get(codes, i - 1) != F.get(codes, i)),
        )

    def count(at: Column, kind: Column) -> Column:
        return F.get(at, kind) - F.coalesce(F.get(at, kind - 1), F.lit(0))

    def vector(at: Column) -> Column:
        slots = F.sequence(F.lit(0), F.lit(HASH_DIMS - 1))
        return F.transform(slots, lambda s: (count(at, s * 2) - count(at, s * 2 + 1)).cast("float"))

    ends_of_runs = F.transform(F.array(ordered), ends)
    return F.element_at(F.transform(ends_of_runs, vector), 1)


def by_bytes(*texts: pd.Series) -> Iterator[slice]:
    """Slices of a batch with about BATCH_BYTES of text each."""
    sizes = sum(t.str.len() for t in texts).to_numpy()
    start, size = 0, 0
    for row, own in enumerate(sizes):
        if size and size + own > BATCH_BYTES:
            yield slice(start, row)
            start, size = row, 0
        size += own
    yield slice(start, len(sizes))


def embed_text(text: Column, factory: Callable[[], Encoder] | None = None) -> Column:
    """Vector of a text, by a user encoder if given; null for a null or empty text."""
    if factory is None:
        return F.when(text != "", hashed_vector(text))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for batch in batches:
            filled = batch.fillna("")
            parts = [list(encode(filled.iloc[rows])) for rows in by_bytes(filled) if len(filled)]
            vectors = pd.Series([v for part in parts for v in part], batch.index, dtype="object")
            yield vectors.where(filled != "", None)

    return run(text)


def embed_postings(
    postings: DataFrame,
    model: str = "bge-large",
    factory: Callable[[], Encoder] | None = None,
    use_prefix: bool = True,
) -> DataFrame:
    """(id, embedding) of the descriptions.  The default encoder takes no instructions."""
    prefix = encoder_prefixes(model)[0] if use_prefix else ""
    text = F.when(
        F.coalesce(F.col("description"), F.lit("")) != "",
        F.concat(F.lit(prefix), F.col("description")),
    )
    return postings.select("id", embed_text(text, factory).alias("embedding"))


def profile_vector(
    profile: DataFrame,
    model: str = "bge-large",
    factory: Callable[[], Encoder] | None = None,
    use_prefix: bool = True,
) -> Column:
    """Vector of the profile as a scalar subquery: encoded once, not once per posting."""
    prefix = encoder_prefixes(model)[1] if use_prefix else ""
    text = F.concat(F.lit(prefix), F.col("text"))
    return profile.select(embed_text(text, factory).alias("embedding")).scalar()


def overlap_score(posting: Column, profile: Column) -> Column:
    """Default pair score without a model: the odds of a posting word being in the profile."""
    words = F.array_distinct(tokenize(posting))
    met = F.size(F.array_intersect(words, F.array_distinct(tokenize(profile))))
    return (met + F.lit(1.0)) / (F.size(words) + F.lit(2.0))


def windows(text: str, size: int | None) -> list[str]:
    """The whole text in pieces of the given size; one piece if there is no size."""
    if not size or len(text) <= size:
        return [text]
    return [text[at : at + size] for at in range(0, len(text), size)]


def pair_score(
    postings: DataFrame,
    profile: DataFrame,
    model: str = "bge-reranker-v2-m3",
    factory: Callable[[], PairScorer] | None = None,
    max_chars: int | None = None,
    window: int | None = None,
    column: str = "cross_encoder_score",
) -> DataFrame:
    """Sigmoid of a user scorer over (posting, profile); a null posting is an empty text.

    Whole texts are scored.  A model with a small input takes ``window``: each posting is scored
    piece by piece and its best piece counts.  ``max_chars`` cuts both texts, for results as other
    tools give them.
    """
    pair_model_id(model)
    posting = F.coalesce(F.col("description"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    if max_chars:
        posting, text = F.left(posting, F.lit(max_chars)), F.left(text, F.lit(max_chars))
    wanted = profile.select(text).scalar()
    if factory is None:
        # A subquery may not stand inside an array function, so it becomes a column first.
        paired = postings.withColumn("_wanted", F.coalesce(wanted, F.lit("")))
        return paired.withColumn(column, overlap_score(posting, F.col("_wanted"))).drop("_wanted")

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = factory()
        for texts, wants in batches:
            best = np.full(len(texts), -np.inf)
            for rows in by_bytes(texts):
                pieces = [windows(t, window) for t in texts.iloc[rows]]
                owner = np.repeat(np.arange(rows.start, rows.stop), [len(p) for p in pieces])
                flat = pd.Series([piece for own in pieces for piece in own], dtype="object")
                raw = np.asarray(score(flat, wants.iloc[owner].reset_index(drop=True)), "float64")
                np.maximum.at(best, owner, raw)
            yield pd.Series(best)

    raw = postings.withColumn("_raw", run(posting, F.coalesce(wanted, F.lit(""))))
    return raw.withColumn(column, 1 / (1 + F.exp(-F.col("_raw")))).drop("_raw")
