"""Label expressions used by the report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitrank.functions.fixed_values import SCORE_BANDS


def _band(score: Column, position: int) -> Column:
    *bounded, last = SCORE_BANDS
    out = F
    for band in bounded:
        out = out.when(score >= band[0], F.lit(band[position]))
    return out.otherwise(F.lit(last[position]))


def score_color(score: Column) -> Column:
    return _band(score, 1)


def score_badge(score: Column) -> Column:
    return _band(score, 2)


def recommendation_label(rec: Column, exact_case: bool = False) -> Column:
    """Label class of a recommendation.

    The tolerant form ignores case and knows ``apply`` and ``skip``; the exact form is
    case-sensitive and knows ``maybe`` too.
    """
    known = ("apply", "skip", "maybe") if exact_case else ("apply", "skip")
    value = rec if exact_case else F.lower(rec)
    out = F
    for name in known:
        out = out.when(value == name, F.lit(f"rec-{name}"))
    return out.otherwise(F.lit("rec-neutral"))


# Fixed value: form of a link in the postings file.
LINK_PATTERN = r"^\[(.+)\]\((.+)\)$"


def make_link(title: Column, url: Column) -> Column:
    """``[title](url)`` if both are given, else null."""
    return F.when((title != "") & (url != ""), F.format_string("[%s](%s)", title, url))


def link_text(link: Column) -> Column:
    """Text of a link; the raw value if it is not one."""
    return F.when(link.rlike(LINK_PATTERN), F.regexp_extract(link, LINK_PATTERN, 1)).otherwise(link)


def link_url(link: Column) -> Column:
    return F.when(link.rlike(LINK_PATTERN), F.regexp_extract(link, LINK_PATTERN, 2))
