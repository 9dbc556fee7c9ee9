"""Queries and SQL for sources and sinks: tables are written in the file form and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.ingest_checks import (
    INGEST_RULES,
    P,
    PS,
    STRICT_RULES,
    base,
    chain_sql,
    keyword_tables,
    search_sql,
    sql_norm,
)
from checks.report_checks import E, FLAT, SCORES
from checks.views import SEARCHES, Views, duckdb_with
from fitrank.config import Lookback
from fitrank.functions.text import strip_markup
from fitrank.operators import filters
from fitrank.operators.report import TEXT_PATHS, flatten_evaluations
from fitrank.plans.ingest import run_ingest
from fitrank.session import new_scratch
from fitrank.sources import blocklists, evaluations, postings, profiles, report_csv, seen

# Rows per written envelope or list file; the number of files grows with the table.
FILE_ROWS = 500


def one_per_file(df, path, form="json"):
    df.write.option("maxRecordsPerFile", 1).format(form).save(path)
    return path


def bundle():
    """Number of the file that a posting goes to."""
    return F.floor(F.col("id").cast("bigint") / FILE_ROWS).alias("bundle")


def q_read_postings(v: Views):
    rows = v.postings.select("*", bundle())
    columns = [F.col(c) for c in v.postings.columns]
    files = rows.groupBy("bundle").agg(
        F.lit("2024-01-31T00:00:00Z").alias("generated_at"),
        F.count(F.lit(1)).alias("total_new_jobs"),
        F.collect_list(F.struct(*columns)).alias("jobs"),
    )
    path = one_per_file(files.drop("bundle"), new_scratch(v.spark, "envelopes"))
    read = postings.read_postings(v.spark, path, "envelope")
    return read.select(
        "id", "title", "company", "is_remote", F.length("description").alias("n_chars"), "salary_source"
    )


def q_read_seen(v: Views):
    ids = v.seen.select("id", bundle()).groupBy("bundle")
    lists = ids.agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("value")).select("value")
    path = one_per_file(lists, new_scratch(v.spark, "seen-lists"), "text")
    return seen.import_seen(v.spark, path)


def q_read_blocklists(v: Views):
    titles, firms = keyword_tables(v)
    words = titles.union(firms).distinct().withColumn("first", F.left("keyword", F.lit(4)))
    files = words.groupBy("first").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("list_name") == n, F.col("keyword")))).alias(n)
            for n in ("company_blocklist", "title_blocklist")
        ]
    )
    path = one_per_file(files.drop("first"), new_scratch(v.spark, "blocklists"))
    return blocklists.read_blocklists(v.spark, path)


def q_read_evaluations(v: Views):
    path = new_scratch(v.spark, "evaluations")
    v.evaluations.write.option("ignoreNullFields", False).json(path)
    return flat_columns(evaluations.read_evaluations(v.spark, path, lines=True))


def flat_columns(df):
    return flatten_evaluations(df).select(*TEXT_PATHS, *SCORES)


def q_read_evaluation_lists(v: Views):
    """The list form: each file holds a JSON list."""
    rows = v.evaluations.withColumn(
        "bundle", F.floor(F.col("job_id").cast("bigint") / FILE_ROWS)
    )
    columns = [F.col(c) for c in v.evaluations.columns]
    lists = rows.groupBy("bundle").agg(F.to_json(F.collect_list(F.struct(*columns))).alias("value"))
    path = one_per_file(lists.select("value"), new_scratch(v.spark, "evaluation-lists"), "text")
    return flat_columns(evaluations.read_evaluations(v.spark, path))


def q_write_postings(v: Views):
    path = new_scratch(v.spark, "postings")
    kept = base(filters.filter_chain(v.postings, INGEST_RULES, v.seen), "date_posted", "is_remote")
    manifest = postings.write_postings(kept, path, SEARCHES, run_id="run-1")
    rows = postings.read_run(v.spark, path, "run-1")
    return rows.withColumn("total_new_jobs", manifest.select("total_new_jobs").scalar())


def q_write_seen(v: Views):
    path = new_scratch(v.spark, "seen")
    v.seen.write.parquet(path)
    table = seen.read_seen(v.spark, path)
    seen.write_seen(v.postings.union(v.postings), table, path)
    return seen.read_seen(v.spark, path)


def q_write_csv(v: Views):
    path = new_scratch(v.spark, "report")
    text = F.when(F.col("is_remote"), F.concat(F.lit(' a "quoted" '), "title", F.lit('\nline, two\n')))
    report = v.postings.select("id", "company", "location", text.alias("note"), "description")
    report_csv.write_report_csv(report, path)
    back = report_csv.read_report_csv(v.spark, path, report.schema)
    return back.withColumn("description", F.md5("description"))


def q_run_ingest(v: Views):
    """A whole run: the rows written and, with no title, the ids of the state afterwards."""
    out, state = new_scratch(v.spark, "run"), new_scratch(v.spark, "run-seen")
    v.seen.write.parquet(state)
    table = seen.read_seen(v.spark, state)
    manifest = run_ingest(
        v.postings, SEARCHES, INGEST_RULES, table, v.as_of, out, state, Lookback(start=240)
    ).first()
    written = postings.read_run(v.spark, out, manifest.run_id).select(
        "id", "title", "hours_old", F.md5("description").alias("text")
    )
    none = F.lit(None)
    known = seen.read_seen(v.spark, state).select(
        "id", none.cast("string").alias("title"), none.cast("int").alias("hours_old"), none.cast("string").alias("text")
    )
    return written.unionByName(known)


def q_read_profile(v: Views):
    """A Markdown file with the profile of the tables."""
    path = new_scratch(v.spark, "profile")
    marked = F.concat(F.lit("# Profile\n\n- **see** [my page](https://example.com/x)\n\n"), "text")
    v.profile.select(marked.alias("value")).write.text(path)
    return profiles.read_profile(v.spark, f"{path}/*.txt")


CHECKS = {
    "read_profile": (
        q_read_profile,
        f"""{duckdb_with("profile")} SELECT trim(regexp_replace('Profile see my page ' || text, '\\s+', ' ', 'g'))
AS text FROM profile""",
    ),
    "read_postings": (
        q_read_postings,
        f"""{P} SELECT id, title, company, is_remote, CAST(length(description) AS INT) AS n_chars,
NULL::VARCHAR AS salary_source FROM postings""",
    ),
    "read_seen": (q_read_seen, f"{PS} SELECT id FROM seen"),
    "read_blocklists": (
        q_read_blocklists,
        f"""{P} SELECT DISTINCT 'title_blocklist' AS list_name, title AS keyword FROM postings
UNION SELECT DISTINCT 'company_blocklist', company FROM postings""",
    ),
    "read_evaluations": (
        q_read_evaluations,
        f"{E}, {FLAT} SELECT {', '.join((*TEXT_PATHS, *SCORES))} FROM flat",
    ),
    "read_evaluation_lists": (
        q_read_evaluation_lists,
        f"{E}, {FLAT} SELECT {', '.join((*TEXT_PATHS, *SCORES))} FROM flat",
    ),
    "write_postings": (
        q_write_postings,
        f"""{PS}, kept AS (SELECT id, title, company, date_posted, is_remote FROM postings
  WHERE {chain_sql(STRICT_RULES)})
SELECT *, (SELECT count(*) FROM kept) AS total_new_jobs FROM kept""",
    ),
    "write_seen": (q_write_seen, f"{PS} SELECT id FROM seen UNION SELECT id FROM postings"),
    "write_report_csv": (
        q_write_csv,
        f"""{P} SELECT id, company, location, CASE WHEN is_remote
THEN ' a "quoted" ' || title || chr(10) || 'line, two' || chr(10) END AS note,
md5(description) AS description FROM postings""",
    ),
    "run_ingest": (
        q_run_ingest,
        f"""{PS}, {search_sql()},
passed AS (SELECT * FROM capped WHERE {chain_sql(STRICT_RULES)}),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {sql_norm('title')},
  {sql_norm('company')} ORDER BY search_no, id) AS rn_first FROM passed) WHERE rn_first = 1)
SELECT id, title, CAST(hours_old AS INT) AS hours_old, md5(description) AS text FROM firsts
UNION ALL SELECT id, NULL, NULL, NULL FROM (SELECT id FROM seen UNION SELECT id FROM capped)""",
    ),
    "strip_markup": (
        lambda v: v.table("pages").select("page_id", "url", strip_markup(F.col("html")).alias("text")),
        r"""WITH a AS (SELECT page_id, url, regexp_replace(html, '<!--.*?-->', ' ', 'gs') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(x, '<script\b.*?</script\s*>', ' ', 'gis') AS x FROM a),
c AS (SELECT page_id, url, regexp_replace(x, '<style\b.*?</style\s*>', ' ', 'gis') AS x FROM b),
d AS (SELECT page_id, url, regexp_replace(x, '<[^>]*>', ' ', 'g') AS x FROM c),
e AS (SELECT page_id, url, regexp_replace(x, '!?\[([^\]\n]*)\]\([^)\n]*\)', '\1', 'g') AS x FROM d),
f AS (SELECT page_id, url, regexp_replace(x, '(?m)^[ \t]*(#{1,6}|>|[-*+]|[0-9]+\.)[ \t]+', '', 'g') AS x FROM e),
g AS (SELECT page_id, url, regexp_replace(x, '\*\*|__|~~|`+', '', 'g') AS x FROM f),
h AS (SELECT page_id, url, replace(replace(replace(replace(x, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'),
  '&quot;', '"') AS x FROM g),
i AS (SELECT page_id, url, replace(replace(replace(x, '&#39;', ''''), '&apos;', ''''), '&amp;', '&') AS x FROM h)
SELECT page_id, url, trim(regexp_replace(x, '\s+', ' ', 'g')) AS text FROM i""",
    ),
}
