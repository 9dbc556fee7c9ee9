"""Score, combine and rank all postings against one profile."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from fitrank.config import DEFAULT_STEPS, ScoreStep
from fitrank.functions.fixed_values import REPORT_COLUMNS
from fitrank.operators.joins import join_responses
from fitrank.operators.plugins import embed_postings, pair_score, profile_vector
from fitrank.operators.ranking import rank_by_score
from fitrank.operators.scoring import (
    HAS_TEXT,
    composite_score,
    embedding_cosine,
    keyword_match,
    with_text_flag,
)
from fitrank.operators.shaping import make_job_link, select_report_columns
from fitrank.operators.tfidf import tfidf_cosine

Step = Callable[[DataFrame, DataFrame, dict], DataFrame]


def _options(options: dict, *names: str) -> dict:
    """The options of a step; one that it doesn't know is an error and not left out in silence."""
    unknown = sorted(set(options) - set(names))
    if unknown:
        raise ValueError(f"unknown options {unknown}; valid: {sorted(names)}")
    return options


def _keywords(postings: DataFrame, profile: DataFrame, options: dict) -> DataFrame:
    return keyword_match(postings, profile, **_options(options, "tech_terms", "stop_words"))


def _tfidf(postings: DataFrame, profile: DataFrame, options: dict) -> DataFrame:
    """Takes kept corpus statistics by ``frequencies`` and ``n_docs``."""
    return tfidf_cosine(postings, profile, **_options(options, "stop_words", "frequencies", "n_docs"))


def _semantic(postings: DataFrame, profile: DataFrame, options: dict) -> DataFrame:
    """Uses given ``vectors`` and ``profile_vector``, else an encoder plug-in."""
    how = _options(options, "vectors", "profile_vector", "model", "factory", "use_prefix")
    if "vectors" in how:
        return embedding_cosine(postings, how["vectors"], how["profile_vector"])
    vectors = embed_postings(postings, **how)
    return embedding_cosine(postings, vectors, profile_vector(profile, **how))


def _pairs(postings: DataFrame, profile: DataFrame, options: dict) -> DataFrame:
    how = _options(options, "model", "factory", "max_chars", "window")
    return pair_score(postings, profile, **how)


def _answers(postings: DataFrame, profile: DataFrame, options: dict) -> DataFrame:
    return join_responses(postings, **_options(options, "responses", "max_chars"))


STEPS: dict[str, Step] = {
    "keyword_match": _keywords,
    "tfidf_cosine": _tfidf,
    "semantic_score": _semantic,
    "cross_encoder_score": _pairs,
    "llm_fit_score": _answers,
}


def register_step(name: str, step: Step) -> None:
    """Add a scorer ``(postings, profile, options) -> postings with a new column``."""
    STEPS[name] = step


def apply_steps(
    postings: DataFrame,
    profile: DataFrame,
    steps: Sequence[ScoreStep] = DEFAULT_STEPS,
    inputs: Mapping[str, dict] | None = None,
) -> DataFrame:
    """Run the enabled steps in order; ``inputs`` adds tables and plug-ins to a step's options.

    Steps that only ask whether there is text find a flag set before the first join, so the text
    moves only if a later step or the caller reads it.
    """
    if "description" in postings.columns:
        postings = with_text_flag(postings)
    for step in steps:
        if step.enabled:
            if step.name not in STEPS:
                raise ValueError(f"unknown step {step.name!r}; valid: {sorted(STEPS)}")
            options = {**step.options, **(inputs or {}).get(step.name, {})}
            postings = postings.transform(STEPS[step.name], profile, options)
    return postings.drop(HAS_TEXT)


def score_postings(
    postings: DataFrame,
    profile: DataFrame,
    steps: Sequence[ScoreStep] = DEFAULT_STEPS,
    inputs: Mapping[str, dict] | None = None,
    columns: Sequence[str] = REPORT_COLUMNS,
    final_column: str = "final_score",
    combine: bool = True,
) -> DataFrame:
    """The ranked report: all scores, their weighted mean, best first.

    ``final_column`` names the mean; without ``combine`` there is none and the rows are not ordered.

    The joins of the steps are all by posting id, so the postings are shuffled once for them.
    """
    scored = apply_steps(postings, profile, steps, inputs)
    if combine:
        scored = composite_score(scored, steps, final_column)
    if "job_link" not in scored.columns and {"title", "job_url"} <= set(scored.columns):
        scored = make_job_link(scored)
    if final_column in scored.columns:
        scored = rank_by_score(scored, final_column)
    if final_column != "final_score":
        columns = [final_column if c == "final_score" else c for c in columns]
    return select_report_columns(scored, columns, final_column)
