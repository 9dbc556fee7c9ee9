"""Queries and SQL for the streaming jobs: tables are written as files and streamed once."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from checks.ingest_checks import P, SQL_TESTS, TITLES_OUT, sql_norm
from checks.scoring_checks import KEYWORD_SQL, PP, six
from checks.views import Views
from fitrank.config import FilterRules
from fitrank.session import new_scratch
from fitrank.streaming import postings as S
from fitrank.streaming import recent_ids


FILES = 4
FILE_ROWS = 20_000


def stream_of(v: Views, repeats: int = 1, columns=("id", "title", "company", "date_posted"), batches: int = 1):
    """The postings as a folder of files, each posting ``repeats`` times, read in so many batches.

    There are ``FILES`` files, or more of them for a larger table, none of much more than ``FILE_ROWS`` rows.
    """
    rows = v.postings.select(*columns)
    rows = rows.withColumn("date_posted", F.col("date_posted").cast("timestamp"))
    for _ in range(repeats - 1):
        rows = rows.union(rows)
    path = new_scratch(v.spark, "stream-in")
    files = max(FILES, -(-rows.count() // FILE_ROWS))
    rows.repartition(files).write.parquet(path)
    options = {"maxFilesPerTrigger": -(-files // batches)} if batches > 1 else {}
    return S.read_posting_stream(v.spark, path, schema=rows.schema, **options)


def run(v: Views, out):
    path, state = new_scratch(v.spark, "stream-out"), new_scratch(v.spark, "stream-state")
    S.write_stream(out, path, state).awaitTermination()
    return v.spark.read.schema(out.schema).parquet(path)


def q_new(v: Views):
    return run(v, S.new_by_id(stream_of(v, 2, batches=2))).select("id", "title", "company")


def q_new_bounded(v: Views):
    """Both outputs; the horizon is exceeded by most of the table, which arrives newest first."""
    columns = ("id", "title", "company", "date_posted")
    rows = v.postings.select(*columns).withColumn("date_posted", F.col("date_posted").cast("timestamp"))
    path = new_scratch(v.spark, "stream-in")
    newest = F.col("date_posted") >= rows.agg(F.max("date_posted")).scalar() - F.expr("INTERVAL 100 HOURS")
    out, late, state = (new_scratch(v.spark, f"bounded-{n}") for n in ("out", "late", "state"))
    for part in (rows.where(newest), rows.union(rows)):
        part.write.mode("append").parquet(path)
        stream = S.read_posting_stream(v.spark, path, schema=rows.schema)
        S.bounded_stream(stream, out, late, 100, state).awaitTermination()
    read = lambda folder, name: v.spark.read.schema(rows.schema).parquet(folder).select(
        "id", "title", "company", F.lit(name).alias("output")
    )
    return read(out, "new").union(read(late, "late"))


def q_recent(v: Views):
    """As above, with the ids in the state store: one stream that is started twice."""
    columns = ("id", "title", "company", "date_posted")
    rows = v.postings.select(*columns).withColumn("date_posted", F.col("date_posted").cast("timestamp"))
    path, out, state = (new_scratch(v.spark, f"recent-{n}") for n in ("in", "out", "state"))
    newest = F.col("date_posted") >= rows.agg(F.max("date_posted")).scalar() - F.expr("INTERVAL 100 HOURS")
    for part in (rows.where(newest), rows.union(rows)):
        part.write.mode("append").parquet(path)
        stream = S.read_posting_stream(v.spark, path, schema=rows.schema)
        recent_ids.recent_stream(stream, out, state, 100).awaitTermination()
    full = StructType([*rows.schema.fields, StructField("output", StringType())])
    return v.spark.read.schema(full).parquet(out).select("id", "title", "company", "output")


def q_filter_score(v: Views):
    stream = stream_of(v, 2, ("id", "title", "company", "date_posted", "is_remote", "description"))
    out, ids = new_scratch(v.spark, "scored"), new_scratch(v.spark, "scored-ids")
    rules = FilterRules(title_blocklist=TITLES_OUT, is_remote=True)
    state = new_scratch(v.spark, "scored-state")
    S.filter_score_stream(stream, v.profile, rules, out, ids, state).awaitTermination()
    scored = v.spark.read.parquet(out).select("id", "title", "company", "keyword_match_score")
    return six(scored, "keyword_match_score")


def q_counts(v: Views):
    out, state = new_scratch(v.spark, "counts"), new_scratch(v.spark, "counts-state")
    S.ingest_counts(stream_of(v, batches=2), out, state).awaitTermination()
    sums = S.read_counts(v.spark, out)
    return sums.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


BOUNDED_SQL = f"""{P}, edge AS (SELECT max(date_posted) - INTERVAL 100 HOUR AS t FROM postings)
SELECT id, title, company, 'new' AS output FROM postings, edge WHERE date_posted >= t
UNION ALL SELECT id, title, company, 'late' FROM postings, edge, range(2) WHERE date_posted < t"""

CHECKS = {
    "stream_new_postings": (q_new, f"{P} SELECT id, title, company FROM postings"),
    "stream_new_postings_bounded": (q_new_bounded, BOUNDED_SQL),
    "stream_recent_postings": (q_recent, BOUNDED_SQL),
    "stream_filter_score": (
        q_filter_score,
        f"""{PP}, {KEYWORD_SQL} SELECT id, title, company, round(score, 6) AS keyword_match_score FROM (
  SELECT *, row_number() OVER (PARTITION BY {sql_norm('title')}, {sql_norm('company')} ORDER BY id) AS rn
  FROM postings WHERE {SQL_TESTS['title_blocklist']} AND {SQL_TESTS['remote']})
JOIN keyword USING (id) WHERE rn = 1""",
    ),
    "stream_ingest_counts": (
        q_counts,
        f"""{P} SELECT strftime(date_trunc('day', date_posted), '%Y-%m-%d %H:%M:%S') AS window_start, company,
count(*) AS n FROM postings GROUP BY 1, 2""",
    ),
}
