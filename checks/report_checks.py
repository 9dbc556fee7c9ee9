"""Queries and SQL for the report over evaluated postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import Views, duckdb_with
from fitrank.operators import report as R
from fitrank.plans.report import ReportView, report_view

E = duckdb_with("postings", "evaluations_flat")
EA = duckdb_with("postings", "evaluations_flat", "applied")

FLAT = """flat AS (SELECT job_id, company, job_link, CAST(overall_score AS DOUBLE) AS overall_score,
  coalesce(CAST(technical AS DOUBLE), 0) AS technical, coalesce(CAST(experience AS DOUBLE), 0) AS experience,
  coalesce(CAST(domain AS DOUBLE), 0) AS domain, coalesce(CAST(soft_skills AS DOUBLE), 0) AS soft_skills,
  coalesce(recommendation, '') AS recommendation, summary, strength_1, gap_1,
  technical IS NOT NULL AS rated FROM evaluations_flat)"""
SCORES = ("overall_score", "technical", "experience", "domain", "soft_skills")
BRIEF = ("job_id", "company", "overall_score", "recommendation")
BRIEF_SQL = ", ".join(BRIEF)


def flat(v: Views):
    return R.flatten_evaluations(v.evaluations)


def brief(df, *more):
    return df.select(*BRIEF, *more)


def q_flatten(v: Views):
    lists = [F.array_join(c, "|").alias(c) for c in R.LIST_PATHS]
    return flat(v).select(*R.TEXT_PATHS, *SCORES, *lists)


def q_search(v: Views):
    return brief(R.search(flat(v), "Lacks Nation_1"))


LIST_SQL = {
    "strengths": "strength_1",
    "gaps": "gap_1",
    "must_met": "CASE WHEN rated THEN strength_1 ELSE '' END",
    "must_missing": "CASE WHEN rated THEN gap_1 ELSE '' END",
    "tech_evidence": "CASE WHEN rated THEN strength_1 || '|' || gap_1 ELSE '' END",
    "exp_evidence": "CASE WHEN rated THEN gap_1 ELSE '' END",
    "domain_evidence": "''",
}
HAY = "lower(concat_ws(' ', company, job_link, summary, recommendation, strength_1, gap_1))"

CHECKS = {
    "flatten_evaluations": (
        q_flatten,
        f"""{E}, {FLAT} SELECT {', '.join((*R.TEXT_PATHS, *SCORES))},
{', '.join(f'{sql} AS {name}' for name, sql in LIST_SQL.items())} FROM flat""",
    ),
    "explode_evidence": (
        lambda v: R.explode_evidence(flat(v)),
        f"""{E}, {FLAT}, lists AS (
{' UNION ALL '.join(f"SELECT job_id, '{n}' AS kind, nullif({s}, '') AS items FROM flat" for n, s in LIST_SQL.items())})
SELECT job_id, kind, CAST(p AS INT) AS pos, CASE WHEN p IS NOT NULL THEN split_part(items, '|', p + 1) END AS item
FROM (SELECT *, unnest(CASE WHEN items IS NULL THEN [NULL] WHEN contains(items, '|') THEN [0, 1] ELSE [0] END) AS p
  FROM lists)""",
    ),
    "score_band": (
        lambda v: brief(R.score_bands(flat(v)), "color", "badge"),
        f"""{E}, {FLAT} SELECT {BRIEF_SQL},
CASE WHEN overall_score >= 80 THEN '#22c55e' WHEN overall_score >= 60 THEN '#f59e0b'
  WHEN overall_score >= 40 THEN '#f97316' ELSE '#ef4444' END AS color,
CASE WHEN overall_score >= 80 THEN 'badge-green' WHEN overall_score >= 60 THEN 'badge-amber'
  WHEN overall_score >= 40 THEN 'badge-orange' ELSE 'badge-red' END AS badge FROM flat""",
    ),
    "rec_class": (
        lambda v: brief(R.recommendation_classes(flat(v)), "rec_class", "rec_badge"),
        f"""{E}, {FLAT} SELECT {BRIEF_SQL},
CASE lower(recommendation) WHEN 'apply' THEN 'rec-apply' WHEN 'skip' THEN 'rec-skip' ELSE 'rec-neutral' END AS rec_class,
CASE recommendation WHEN 'apply' THEN 'rec-apply' WHEN 'skip' THEN 'rec-skip' WHEN 'maybe' THEN 'rec-maybe'
  ELSE 'rec-neutral' END AS rec_badge FROM flat""",
    ),
    "rpt_filter_recommendation": (
        lambda v: brief(R.filter_recommendation(flat(v), "apply")),
        f"{E}, {FLAT} SELECT {BRIEF_SQL} FROM flat WHERE recommendation = 'apply'",
    ),
    "rpt_filter_score_band": (
        lambda v: brief(
            R.filter_score_band(
                flat(v).withColumn("overall_score", F.col("overall_score") + F.col("technical") % 2 / 2), "60"
            )
        ),
        f"""{E}, {FLAT} SELECT job_id, company, overall_score + technical % 2 / 2 AS overall_score, recommendation
FROM flat WHERE overall_score + technical % 2 / 2 BETWEEN 60 AND 79""",
    ),
    "rpt_filter_applied": (
        lambda v: brief(R.filter_applied(flat(v), v.applied, "yes")),
        f"{EA}, {FLAT} SELECT {BRIEF_SQL} FROM flat WHERE job_id IN (SELECT job_id FROM applied)",
    ),
    "rpt_filter_not_applied": (
        lambda v: brief(R.filter_applied(flat(v), v.applied, "no")),
        f"{EA}, {FLAT} SELECT {BRIEF_SQL} FROM flat WHERE job_id NOT IN (SELECT job_id FROM applied)",
    ),
    "rpt_search": (
        q_search,
        f"{E}, {FLAT} SELECT {BRIEF_SQL} FROM flat WHERE contains({HAY}, 'lacks nation_1')",
    ),
    "rpt_sort": (
        lambda v: brief(R.sort_report(flat(v), "company")),
        f"{E}, {FLAT} SELECT {BRIEF_SQL} FROM flat ORDER BY company, job_id",
    ),
    "rpt_sort_applied": (
        lambda v: brief(R.sort_applied(flat(v), v.applied), "is_applied"),
        f"""{EA}, {FLAT} SELECT {BRIEF_SQL}, job_id IN (SELECT job_id FROM applied) AS is_applied
FROM flat ORDER BY is_applied DESC, job_id""",
    ),
    "report_view": (
        lambda v: brief(
            report_view(
                v.evaluations,
                v.applied,
                ReportView("knows", "maybe", "60", "no", "technical", 2),
            ),
            "technical",
        ),
        f"""{EA}, {FLAT} SELECT {BRIEF_SQL}, technical FROM flat WHERE recommendation = 'maybe'
AND overall_score BETWEEN 60 AND 79 AND contains({HAY}, 'knows')
AND job_id NOT IN (SELECT job_id FROM applied) ORDER BY technical, job_id""",
    ),
    "kpi_counts": (
        lambda v: R.kpi_counts(flat(v)),
        f"""{E}, {FLAT} SELECT count(*) AS total,
count(*) FILTER (WHERE lower(recommendation) = 'apply') AS n_apply,
count(*) FILTER (WHERE lower(recommendation) = 'maybe') AS n_maybe,
count(*) FILTER (WHERE lower(recommendation) = 'skip') AS n_skip FROM flat""",
    ),
    "kpi_avg_score": (
        lambda v: R.kpi_avg_score(flat(v)),
        f"{E}, {FLAT} SELECT CAST(round_even(avg(overall_score), 0) AS BIGINT) AS avg_score FROM flat",
    ),
    "kpi_applied": (
        lambda v: R.kpi_applied(v.applied),
        f"{EA} SELECT count(DISTINCT job_id) AS n_applied FROM applied",
    ),
}
