"""Hard reject rules: the first rule that holds gives score 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitrank.functions.fixed_values import CLEARANCE_KEYWORDS, COMPANY_BLOCKLIST
from fitrank.functions.text import contains_any, norm_key

# Texts of the five rules, in order of precedence.
RULE_TEXTS = (
    "requires 6 or more years of experience",
    "company is a job board",
    "AI trainer position",
    "requires a security clearance",
    "on-site or hybrid outside the home region",
)
# Patterns that stand for the rules' wording.
YEARS_PATTERN = r"(\d{1,2})\s*\+?\s*(?:years|yrs)"
TRAINER_PATTERN = r"(?i)\bai (trainer|training)\b"
ONSITE_PATTERN = r"(?i)hybrid|on-?site|in[- ]person"
MAX_YEARS = 6


def hard_rules(
    postings: DataFrame,
    home_region: str = "michigan",
    job_boards: Sequence[str] = COMPANY_BLOCKLIST,
) -> DataFrame:
    """Add ``rule_no`` and ``rule_text`` (null if no rule holds) and ``overall_score`` (0 or null)."""
    text = F.coalesce(F.col("description"), F.lit(""))
    years = F.transform(
        F.regexp_extract_all(F.lower(text), F.lit(YEARS_PATTERN), F.lit(1)),
        lambda y: y.cast("int"),
    )
    tests: list[Column] = [
        F.coalesce(F.array_max(years) >= MAX_YEARS, F.lit(False)),
        norm_key(F.col("company")).isin([b.strip().lower() for b in job_boards]),
        F.coalesce(F.col("title"), F.lit("")).rlike(TRAINER_PATTERN),
        contains_any(text, CLEARANCE_KEYWORDS),
        text.rlike(ONSITE_PATTERN)
        & ~F.coalesce(F.lower("location"), F.lit("")).contains(home_region.lower()),
    ]
    number = F
    for no, test in enumerate(tests, 1):
        number = number.when(test, F.lit(no))
    return postings.withColumn("rule_no", number).withColumns(
        {
            "rule_text": F.get(F.array(*[F.lit(t) for t in RULE_TEXTS]), F.col("rule_no") - 1),
            "overall_score": F.when(F.col("rule_no").isNotNull(), F.lit(0)),
        }
    )
