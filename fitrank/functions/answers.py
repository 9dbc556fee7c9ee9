"""Prompts for an external answering service and the reading of its answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitrank.functions.fixed_values import ANSWER_PROMPT
from fitrank.functions.text import strip_space

# Patterns of the two answer lines and of a bare number.
SCORE_LINE = r"(?i)SCORE:\s*(\d+(?:\.\d+)?)"
REASON_LINE = r"(?i)REASON:\s*([^\n]+)"
BARE_NUMBER = r"\b(\d+(?:\.\d+)?)\b"
# Fixed value: score of an answer without any usable number.
DEFAULT_POINTS = 5.0


def shortened(text: Column, max_chars: int | None) -> Column:
    return F.left(text, F.lit(max_chars)) if max_chars else text


def build_prompt(description: Column, profile: Column, max_chars: int | None = None) -> Column:
    """Prompt text for one posting; null when there is nothing to rate.

    Both texts are whole unless the caller gives a length.
    """
    head, rest = ANSWER_PROMPT.split("{job}")
    middle, tail = rest.split("{resume}")
    job, resume = shortened(description, max_chars), shortened(profile, max_chars)
    prompt = F.concat(F.lit(head), job, F.lit(middle), resume, F.lit(tail))
    return F.when(description != "", prompt)


def answer_points(answer: Column) -> Column:
    """Points 0..10: the score line, else the first bare number in 0..10, else 5."""
    numbers = F.transform(
        F.regexp_extract_all(answer, F.lit(BARE_NUMBER), F.lit(1)), lambda x: x.cast("double")
    )
    fallback = F.get(F.filter(numbers, lambda x: x.between(0, 10)), F.lit(0))
    # An unmatched pattern yields an empty text, which the tolerant cast turns into null.
    declared = F.regexp_extract(answer, SCORE_LINE, 1).try_cast("double")
    points = F.coalesce(declared, fallback, F.lit(DEFAULT_POINTS))
    return F.least(F.lit(10.0), F.greatest(F.lit(0.0), points))


def answer_score(answer: Column, description: Column, error: Column) -> Column:
    """Score 0..1; 0.0 for a posting without text and for a failed call."""
    failed = F.coalesce(description, F.lit("")).eqNullSafe("") | error.isNotNull() | answer.isNull()
    return F.when(failed, F.lit(0.0)).otherwise(answer_points(answer) / 10)


def answer_rationale(
    answer: Column, description: Column, error: Column, max_chars: int | None = None
) -> Column:
    """Text after the reason mark, else the whole answer; error text for a failed call.

    ``max_chars`` shortens an answer without the mark, for results as other tools give them.
    """
    reason = strip_space(F.regexp_extract(answer, REASON_LINE, 1))
    head = shortened(strip_space(answer), max_chars)
    return (
        F.when(F.coalesce(description, F.lit("")) == "", F.lit(""))
        .when(error.isNotNull(), F.concat(F.lit("error: "), error))
        .when(answer.isNull(), F.lit(""))
        .when(answer.rlike(REASON_LINE), reason)
        .otherwise(head)
    )
