"""The report over evaluated postings: flattening, filters, search, order and key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitrank.functions.fixed_values import BAND_FILTERS
from fitrank.functions.labels import recommendation_label, score_badge, score_color

# Flat name -> path of the nested evaluation.
SCORE_PATHS = {
    "overall_score": "overall_score",
    "technical": "dimensions.technical_skills.score",
    "experience": "dimensions.experience_level.score",
    "domain": "dimensions.domain_knowledge.score",
    "soft_skills": "dimensions.soft_skills.score",
}
TEXT_PATHS = ("job_id", "company", "job_link", "recommendation", "summary")
LIST_PATHS = {
    "strengths": "strengths",
    "gaps": "gaps",
    "must_met": "must_haves.met",
    "must_missing": "must_haves.missing",
    "tech_evidence": "dimensions.technical_skills.evidence",
    "exp_evidence": "dimensions.experience_level.evidence",
    "domain_evidence": "dimensions.domain_knowledge.evidence",
}
# Columns whose first click sorts upwards.
ASCENDING_FIRST = ("company", "job_link", "recommendation")


def flatten_evaluations(evaluations: DataFrame) -> DataFrame:
    """17 flat columns of the nested evaluations; a missing value is "", 0 or an empty list."""
    none = F.array().cast("array<string>")
    columns = {name: F.coalesce(F.col(name), F.lit("")) for name in TEXT_PATHS}
    columns |= {n: F.coalesce(F.col(p), F.lit(0.0)) for n, p in SCORE_PATHS.items()}
    columns |= {n: F.coalesce(F.col(p), none) for n, p in LIST_PATHS.items()}
    return evaluations.select([c.alias(name) for name, c in columns.items()])


def explode_evidence(flat: DataFrame) -> DataFrame:
    """One row per list item: (job_id, kind, pos, item); an empty list gives one row without item."""
    kinds = F.array(
        *[F.struct(F.lit(n).alias("kind"), F.col(n).alias("items")) for n in LIST_PATHS]
    )
    lists = flat.select("job_id", F.inline(kinds))
    return lists.select("job_id", "kind", F.posexplode_outer("items").alias("pos", "item"))


def score_bands(flat: DataFrame) -> DataFrame:
    return flat.withColumns(
        {"color": score_color(F.col("overall_score")), "badge": score_badge(F.col("overall_score"))}
    )


def recommendation_classes(flat: DataFrame) -> DataFrame:
    rec = F.coalesce(F.col("recommendation"), F.lit(""))
    return flat.withColumns(
        {
            "rec_class": recommendation_label(rec),
            "rec_badge": recommendation_label(rec, exact_case=True),
        }
    )


def filter_recommendation(flat: DataFrame, wanted: str) -> DataFrame:
    """Exact-case match; an empty choice keeps all."""
    return flat.where(F.col("recommendation") == wanted) if wanted else flat


def filter_score_band(flat: DataFrame, choice: str) -> DataFrame:
    """Inclusive whole-number band; a fraction between two bands is in neither."""
    if not choice:
        return flat
    low, high = BAND_FILTERS[choice]
    return flat.where(F.col("overall_score").between(low, high))


def filter_applied(flat: DataFrame, applied: DataFrame, choice: str) -> DataFrame:
    """``yes``: only applied jobs, ``no``: only others, empty: all."""
    if not choice:
        return flat
    how = {"yes": "left_semi", "no": "left_anti"}[choice]
    return flat.join(applied.select("job_id"), "job_id", how)


def search_text() -> Column:
    """The text the search box looks into, in lower case."""
    parts = [
        F.coalesce(F.col(c), F.lit("")) for c in ("company", "job_link", "summary", "recommendation")
    ]
    return F.lower(F.concat_ws(" ", *parts, F.col("strengths"), F.col("gaps")))


def search(flat: DataFrame, query: str) -> DataFrame:
    return flat.where(search_text().contains(query.lower())) if query else flat


def sort_report(flat: DataFrame, column: str, clicks: int = 1) -> DataFrame:
    """Order by a column: texts by collation, numbers by value.

    The first click sorts company, link and recommendation upwards and all else downwards; every
    further click turns the order around.  Ties go by job id.
    """
    upwards = (column in ASCENDING_FIRST) == (clicks % 2 == 1)
    value = F.col(column)
    if dict(flat.dtypes)[column] == "string":
        value = F.collate(F.coalesce(value, F.lit("")), "UNICODE")
    order = value.asc_nulls_first() if upwards else value.desc_nulls_last()
    return flat.orderBy(order, F.col("job_id"))


def mark_applied(flat: DataFrame, applied: DataFrame) -> DataFrame:
    marks = applied.select("job_id").distinct().withColumn("_mark", F.lit(True))
    flag = F.coalesce(F.col("_mark"), F.lit(False))
    return flat.join(marks, "job_id", "left").withColumn("is_applied", flag).drop("_mark")


def sort_applied(flat: DataFrame, applied: DataFrame, clicks: int = 1) -> DataFrame:
    """Applied jobs first on the first click, last on the second."""
    value = F.col("is_applied")
    order = value.desc() if clicks % 2 == 1 else value.asc()
    return mark_applied(flat, applied).orderBy(order, F.col("job_id"))


def kpi_counts(flat: DataFrame) -> DataFrame:
    """Row count and counts per recommendation, ignoring case."""
    rec = F.lower(F.coalesce(F.col("recommendation"), F.lit("")))
    return flat.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(rec == name).alias(f"n_{name}") for name in ("apply", "maybe", "skip")],
    )


def kpi_avg_score(flat: DataFrame) -> DataFrame:
    """Mean overall score rounded half to even, missing scores as 0; 0 without rows."""
    mean = F.avg(F.coalesce(F.col("overall_score"), F.lit(0)))
    return flat.agg(F.coalesce(F.bround(mean, 0), F.lit(0.0)).cast("bigint").alias("avg_score"))


def kpi_applied(applied: DataFrame) -> DataFrame:
    return applied.agg(F.count_distinct("job_id").alias("n_applied"))
