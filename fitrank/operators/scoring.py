"""Scores computed within a row, and their weighted composite."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitrank.config import ScoreStep
from fitrank.functions.fixed_values import (
    ENGLISH_STOP_WORDS,
    OTHER_SHARE,
    TECH_SHARE,
    TECH_TERMS,
)
from fitrank.functions.text import distinct_terms, literal_array
from fitrank.functions.vectors import cosine

# Longest profile text, in characters, whose terms are sent to every task.
PROFILE_LIMIT = 4_000_000


def profile_terms(
    profile: DataFrame, stop_words: Sequence[str] = ENGLISH_STOP_WORDS
) -> Column:
    """Set of terms of the one profile text, as a scalar subquery.

    The set reaches every task, so the length of the text is checked; more than one profile row is
    an error of the subquery itself.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    checked = F.when(F.length(text) <= PROFILE_LIMIT, text).otherwise(
        F.raise_error(F.lit(f"the profile text is longer than {PROFILE_LIMIT} characters"))
    )
    terms = distinct_terms(checked, stop_words)
    return profile.select(terms.alias("terms")).scalar()


def term_set_ops(
    postings: DataFrame,
    profile: DataFrame,
    tech_terms: Sequence[str] = TECH_TERMS,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Add sizes of the term sets of each posting: all, technical, and both met by the profile.

    Pure array algebra inside the row; nothing is exploded or shuffled.
    """
    none = F.array().cast("array<string>")  # without a profile nothing is met
    wanted = F.coalesce(profile_terms(profile, stop_words), none)
    terms = distinct_terms(F.coalesce(F.col("description"), F.lit("")), stop_words)
    tech = F.array_intersect(F.col("_terms"), literal_array(tech_terms))
    return (
        postings.withColumn("_terms", terms)
        .withColumns(
            {
                "n_terms": F.size("_terms"),
                "_tech": tech,
                "n_met": F.size(F.array_intersect(F.col("_terms"), wanted)),
            }
        )
        .withColumns(
            {
                "n_tech": F.size("_tech"),
                "n_tech_met": F.size(F.array_intersect(F.col("_tech"), wanted)),
            }
        )
        .drop("_terms", "_tech")
    )


def keyword_match(
    postings: DataFrame,
    profile: DataFrame,
    tech_terms: Sequence[str] = TECH_TERMS,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    column: str = "keyword_match_score",
) -> DataFrame:
    """Share of the posting's technical and other terms that the profile holds, weighted 70 : 30."""
    sized = term_set_ops(postings, profile, tech_terms, stop_words)
    tech = F.col("n_tech_met") / F.greatest(F.col("n_tech"), F.lit(1))
    other = (F.col("n_met") - F.col("n_tech_met")) / F.greatest(
        F.col("n_terms") - F.col("n_tech"), F.lit(1)
    )
    score = F.lit(TECH_SHARE) * tech + F.lit(OTHER_SHARE) * other
    return sized.withColumn(column, score).drop("n_terms", "n_tech", "n_met", "n_tech_met")


def embedding_cosine(
    postings: DataFrame,
    vectors: DataFrame,
    profile_vector: Column,
    column: str = "semantic_score",
) -> DataFrame:
    """Cosine of posting and profile vectors; 0.0 without text or vector.

    ``vectors`` has ``id`` and ``embedding``.  The score is computed on the vector side, so the
    join moves one number per posting and no vector; of several vectors of an id the best counts.
    Whether there is text is one flag taken before the join.
    """
    # A subquery may not stand inside an array function, so it becomes a column first.
    paired = vectors.select(F.col("id").alias("_id"), "embedding", profile_vector.alias("_wanted"))
    scores = (
        paired.select("_id", cosine(F.col("embedding"), F.col("_wanted")).alias("_cosine"))
        .groupBy("_id")
        .agg(F.max("_cosine").alias("_cosine"))
    )
    flagged = with_text_flag(postings)
    value = F.when(F.col(HAS_TEXT), F.coalesce(F.col("_cosine"), F.lit(0.0))).otherwise(F.lit(0.0))
    joined = flagged.join(scores, flagged["id"] == scores["_id"], "left")
    return joined.withColumn(column, value).select(*postings.columns, column)


HAS_TEXT = "_has_text"


def with_text_flag(postings: DataFrame) -> DataFrame:
    """Add whether a posting has text.  Set before the first join, it saves moving the text."""
    if HAS_TEXT in postings.columns:
        return postings
    return postings.withColumn(HAS_TEXT, F.coalesce(F.col("description"), F.lit("")) != "")


def weighted_mean(weights: Mapping[str, float]) -> Column:
    """Weighted mean of score columns; null if one is null or the weights sum to zero."""
    parts = [F.col(c) * F.lit(float(w)) for c, w in weights.items()]
    return F.try_divide(reduce(Column.__add__, parts), F.lit(float(sum(weights.values()))))


def composite_score(
    df: DataFrame, steps: Sequence[ScoreStep], column: str = "final_score"
) -> DataFrame:
    """Weighted mean over the columns that enabled steps declare and that exist."""
    present = {s.column: s.weight for s in steps if s.enabled and s.column in df.columns}
    return df.withColumn(column, weighted_mean(present)) if present else df


def composite_score_by_name(
    df: DataFrame, steps: Sequence[ScoreStep], column: str = "final_score"
) -> DataFrame:
    """The older naming rule: a step counts only if ``<name>_score`` exists.

    Steps whose own name ends in ``_score`` thus never count.  Kept for comparable results.
    """
    named = [
        ScoreStep(s.name, f"{s.name}_score", s.weight, s.enabled, s.options) for s in steps
    ]
    return composite_score(df, named, column)
