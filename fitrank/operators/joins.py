"""Joins of postings with answers of external services."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitrank.functions.answers import answer_rationale, answer_score, build_prompt
from fitrank.operators.scoring import HAS_TEXT, with_text_flag


def build_prompts(
    postings: DataFrame, profile: DataFrame, max_chars: int | None = None
) -> DataFrame:
    """(id, prompt) of every posting with text, for any batch answering service.

    Texts are whole; ``max_chars`` cuts both, for a service with a small input.
    """
    wanted = profile.select("text").scalar()
    prompt = build_prompt(F.col("description"), wanted, max_chars)
    prompts = postings.select("id", prompt.alias("prompt"))
    return prompts.where(F.col("prompt").isNotNull())


def _with_error(responses: DataFrame) -> DataFrame:
    has = "error" in responses.columns
    error = F.col("error") if has else F.lit(None)
    return responses.select("id", "answer", error.cast("string").alias("error"))


def parse_responses(responses: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(id, llm_fit_score, llm_fit_rationale) of the answers alone."""
    text = F.lit("-")
    answers = _with_error(responses)
    return answers.select(
        "id",
        answer_score(F.col("answer"), text, F.col("error")).alias("llm_fit_score"),
        answer_rationale(F.col("answer"), text, F.col("error"), max_chars).alias(
            "llm_fit_rationale"
        ),
    )


def join_responses(
    postings: DataFrame, responses: DataFrame, max_chars: int | None = None
) -> DataFrame:
    """Add score and rationale of the answers; 0.0 and empty where there is none.

    ``responses`` has ``id``, ``answer`` and perhaps ``error``.  Of several answers to one id the
    smallest (answer, error) counts, so no posting is repeated.  What depends on the text is one
    flag taken before the join; the score and rationale are made of the narrow answer.
    """
    answers = _with_error(responses).select(
        F.col("id").alias("_id"), F.struct("answer", "error").alias("_given")
    )
    one = answers.groupBy("_id").agg(F.min("_given").alias("_given"))
    flagged = with_text_flag(postings)
    text = F.when(F.col(HAS_TEXT), "-").otherwise("")
    joined = flagged.join(one, flagged["id"] == one["_id"], "left")
    args = (F.col("_given.answer"), text, F.col("_given.error"))
    scored = joined.withColumns(
        {
            "llm_fit_score": answer_score(*args),
            "llm_fit_rationale": answer_rationale(*args, max_chars),
        }
    )
    return scored.select(*postings.columns, "llm_fit_score", "llm_fit_rationale")
