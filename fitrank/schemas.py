"""Explicit schemas; a column absent from a file reads as null."""

from __future__ import annotations

from pyspark.sql import types as T

from fitrank.functions.fixed_values import POSTING_COLUMNS

_TYPED = {
    "date_posted": T.TimestampType(),
    "min_amount": T.DoubleType(),
    "max_amount": T.DoubleType(),
    "is_remote": T.BooleanType(),
}

POSTING = T.StructType(
    [T.StructField(c, _TYPED.get(c, T.StringType())) for c in (*POSTING_COLUMNS, "job_link")]
)

CRITERIA = T.StructType(
    [
        T.StructField("search_term", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("is_remote", T.BooleanType()),
        T.StructField("hours_old", T.IntegerType()),
        T.StructField("job_type", T.StringType()),
    ]
)

MANIFEST = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("generated_at", T.StringType()),
        T.StructField("search_criteria", T.ArrayType(CRITERIA)),
        T.StructField("total_new_jobs", T.LongType()),
    ]
)

ENVELOPE = T.StructType(
    [
        T.StructField("generated_at", T.StringType()),
        T.StructField("total_new_jobs", T.LongType()),
        T.StructField("jobs", T.ArrayType(POSTING)),
    ]
)

BLOCKLISTS = T.StructType(
    [
        T.StructField("company_blocklist", T.ArrayType(T.StringType())),
        T.StructField("title_blocklist", T.ArrayType(T.StringType())),
    ]
)

_DIMENSION = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
    ]
)

EVALUATION = T.StructType(
    [
        T.StructField("job_id", T.StringType()),
        T.StructField("company", T.StringType()),
        T.StructField("job_link", T.StringType()),
        T.StructField("overall_score", T.DoubleType()),
        T.StructField(
            "dimensions",
            T.StructType(
                [
                    T.StructField(name, _DIMENSION)
                    for name in (
                        "technical_skills",
                        "experience_level",
                        "domain_knowledge",
                        "soft_skills",
                    )
                ]
            ),
        ),
        T.StructField(
            "must_haves",
            T.StructType(
                [
                    T.StructField("met", T.ArrayType(T.StringType())),
                    T.StructField("missing", T.ArrayType(T.StringType())),
                ]
            ),
        ),
        T.StructField("strengths", T.ArrayType(T.StringType())),
        T.StructField("gaps", T.ArrayType(T.StringType())),
        T.StructField("recommendation", T.StringType()),
        T.StructField("summary", T.StringType()),
    ]
)
