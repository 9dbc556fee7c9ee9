"""Queries and SQL for kept state: statistics by batch, the pool by day, the bucketed seen table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.ingest_checks import CHECKS as INGEST
from checks.io_checks import CHECKS as IO
from checks.io_checks import flat_columns, one_per_file
from checks.scoring_checks import CHECKS as SCORING
from checks.scoring_checks import six
from checks.report_checks import BRIEF_SQL, FLAT, HAY, E, brief, flat
from checks.views import Views, duckdb_with
from fitrank.operators import filters, tfidf
from fitrank.session import new_scratch
from fitrank.schemas import EVALUATION
from fitrank.sources import json_lists, pool, search_index, statistics
from fitrank.sources.seen_table import SeenTable

P = duckdb_with("postings")
BATCHES = 3


def part(v: Views, number: int):
    return v.postings.where(F.crc32(F.col("id").cast("binary")) % BATCHES == number)


def logged(v: Views):
    """Statistics of all postings and the profile: some batches, one taken back, a merge between."""
    path, merged = new_scratch(v.spark, "log"), new_scratch(v.spark, "log-merged")
    for number in range(BATCHES - 1):
        statistics.log_statistics(part(v, number), path, f"part/{number}")
    statistics.log_statistics(v.profile, path, "profile", "text")
    statistics.log_statistics(v.seen, path, "ids", "id")
    statistics.log_statistics(v.seen, path, "ids taken back", "id", sign=-1)
    statistics.compact_statistics(v.spark, path, merged, 4)
    for number in range(BATCHES):
        statistics.log_statistics(part(v, number), merged, f"part/{number}")
    return statistics.read_statistics(v.spark, merged)


def q_logged(v: Views):
    return statistics.frequencies(logged(v))


def q_tfidf_logged(v: Views):
    kept = logged(v)
    texts = v.table("benchmark")
    scores = tfidf.tfidf_scores(
        texts, v.profile, "text", "item_id",
        frequencies=statistics.frequencies(kept), n_docs=statistics.corpus_size(kept),
    )
    return six(scores, "score")


def laid_out(v: Views) -> str:
    path = new_scratch(v.spark, "pool")
    for number in range(BATCHES):
        pool.write_pool(part(v, number), path, f"load {number}")
    pool.write_pool(part(v, 0), path, "load 0")
    return path


def q_window(v: Views):
    path = laid_out(v)
    rows = pool.read_window(v.spark, path, pool.newest(v.spark, path), 72)
    return rows.select("id", "title", "company", "date_posted")


def seen_table(v: Views) -> SeenTable:
    name = f"seen_{uuid.uuid4().hex}"
    table = SeenTable(v.spark, name, new_scratch(v.spark, "seen-table"), 8, most_files=2)
    table.add(v.seen)
    return table


def q_filter_table(v: Views):
    rows = filters.filter_seen(v.postings, seen_table(v).read())
    return rows.select("id", "title", "company")


def q_add(v: Views):
    table = seen_table(v)
    for number in (0, 1, 1, 2):
        table.add(part(v, number))
    return table.read()


def q_json_list(v: Views):
    """All evaluations in lists of many records, one for each company."""
    columns = [F.col(c) for c in v.evaluations.columns]
    lists = v.evaluations.groupBy("company").agg(F.to_json(F.collect_list(F.struct(*columns))).alias("value"))
    path = one_per_file(lists.select("value"), new_scratch(v.spark, "json-list"), "text")
    return flat_columns(json_lists.read_json_list(v.spark, path, EVALUATION))


def index(v: Views) -> str:
    path = new_scratch(v.spark, "index")
    search_index.write_index(flat(v), path)
    return path


def q_search_index(v: Views):
    return brief(search_index.search_index(v.spark, index(v), "Lacks Nation_1"))


def q_search_many(v: Views):
    words = v.table("part").select(F.explode(F.split("p_name", " ")).alias("query"))
    return search_index.search_many(v.spark, index(v), words)


CHECKS = {
    "read_json_list": (q_json_list, IO["read_evaluation_lists"][1]),
    "search_index": (q_search_index, f"{E}, {FLAT} SELECT {BRIEF_SQL} FROM flat WHERE contains({HAY}, 'lacks nation_1')"),
    "search_many": (
        q_search_many,
        f"""{E}, {FLAT}, words AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS query FROM part)
SELECT query, job_id FROM words w JOIN (SELECT job_id, {HAY} AS hay FROM flat) f ON contains(hay, query)
WHERE query <> ''""",
    ),
    "statistics_log": (q_logged, SCORING["document_frequencies"][1]),
    "tfidf_cosine_logged": (q_tfidf_logged, SCORING["tfidf_cosine_frozen"][1]),
    "pool_window": (q_window, INGEST["filter_window"][1]),
    "filter_seen_table": (q_filter_table, INGEST["filter_seen"][1]),
    "seen_table": (q_add, IO["write_seen"][1]),
}
