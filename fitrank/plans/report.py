"""The report view over evaluations: all filters of the page and its order, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from fitrank.operators import report as R


@dataclass(frozen=True)
class ReportView:
    """Choices of a reader; an empty choice restricts nothing."""

    query: str = ""
    recommendation: str = ""
    score_band: str = ""
    applied: str = ""
    sort_column: str = "overall_score"
    clicks: int = 1


def report_view(evaluations: DataFrame, applied: DataFrame, view: ReportView) -> DataFrame:
    flat = R.flatten_evaluations(evaluations)
    flat = R.filter_recommendation(flat, view.recommendation)
    flat = R.filter_score_band(flat, view.score_band)
    flat = R.search(flat, view.query)
    flat = R.filter_applied(flat, applied, view.applied)
    if view.sort_column == "applied":
        return R.sort_applied(flat, applied, view.clicks)
    return R.sort_report(flat, view.sort_column, view.clicks)
