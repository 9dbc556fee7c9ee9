"""Reading and writing postings and their run manifest."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitrank.config import Search
from fitrank.schemas import CRITERIA, ENVELOPE, MANIFEST, POSTING


def read_envelopes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Rows of envelope files ``{generated_at, search_criteria, total_new_jobs, jobs[]}``.

    One envelope is one run's output and is parsed by one task; any number of them may be given
    by folder or pattern.  No jobs give no rows, a missing path is an error.
    """
    files = spark.read.schema(ENVELOPE).option("multiLine", True).json(path)
    return files.select(F.inline("jobs"))


def read_postings(spark: SparkSession, path: str | list[str], form: str = "parquet") -> DataFrame:
    """Postings in a splittable form (``parquet``, ``orc``, ``json`` lines) or as ``envelope``."""
    if form == "envelope":
        return read_envelopes(spark, path)
    return spark.read.schema(POSTING).format(form).load(path)


def write_postings(
    postings: DataFrame,
    path: str,
    searches: Sequence[Search],
    form: str = "parquet",
    run_id: str | None = None,
    before_commit: Callable[[], None] | None = None,
) -> DataFrame:
    """Write the rows of one run and then its one-row manifest; return the manifest.

    ``before_commit`` is called between the two and may write what the manifest is to commit too.

    The manifest comes last and so marks a complete run.  Its figures are read from the written
    rows and not from a second evaluation of the plan.  If rows tell the window they were found
    with (``hours_old``), the criteria show by how much the windows were widened in the end.

    A run that is written again with the same ``run_id`` replaces its own rows and manifest and
    touches no other run, so a repeated run leaves the same result.
    """
    spark = postings.sparkSession
    run = run_id or uuid.uuid4().hex
    rows = f"{path}/jobs/run_id={run}"
    dated = postings.withColumn("run_date", F.current_date())
    dated.write.mode("overwrite").format(form).save(rows)

    # Without a row there may be no file to take the schema from.
    mine = spark.read.schema(dated.schema).format(form).load(rows)
    wider = F.lit(None).cast("int")
    if "hours_old" in postings.columns:
        start = F.lit(searches[0].hours_old)
        if "search_no" in postings.columns:
            own = F.create_map(*[F.lit(x) for s in searches for x in (s.search_no, s.hours_old)])
            start = F.element_at(own, F.col("search_no"))
        wider = F.max(F.col("hours_old") - start)
    figures = mine.agg(F.count(F.lit(1)).alias("total_new_jobs"), wider.alias("_wider"))

    def criteria(s: Search):
        values = [F.lit(getattr(s, f.name)).cast(f.dataType).alias(f.name) for f in CRITERIA.fields]
        hours = (F.lit(s.hours_old) + F.coalesce("_wider", F.lit(0))).cast("int")
        return F.struct(*values).withField("hours_old", hours)

    manifest = figures.select(
        F.lit(run).alias("run_id"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias(
            "generated_at"
        ),
        F.array(*[criteria(s) for s in searches]).alias("search_criteria"),
        "total_new_jobs",
    )
    if before_commit:
        before_commit()
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/run_id={run}")
    return read_manifest(spark, path).where(F.col("run_id") == run)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each complete run."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def read_run(spark: SparkSession, path: str, run_id: str, form: str = "parquet") -> DataFrame:
    """Rows of one complete run; a run without a manifest was broken off and is an error."""
    if read_manifest(spark, path).where(F.col("run_id") == run_id).isEmpty():
        raise ValueError(f"there is no complete run {run_id!r}")
    return spark.read.format(form).load(f"{path}/jobs/run_id={run_id}").drop("run_date")
