"""Queries and SQL for filters, searches, windows, unions and row shaping."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks.views import SEARCHES, Views, duckdb_with
from fitrank.config import FilterRules, Lookback
from fitrank.functions import labels
from fitrank.functions import text as TX
from fitrank.functions.fixed_values import (
    CLEARANCE_KEYWORDS,
    COMPANY_BLOCKLIST,
    TITLE_BLOCKLIST,
)
from fitrank.operators import filters, keyword_join, lookback, ranking, rules, shaping
from fitrank.plans import ingest

P = duckdb_with("postings")
PS = duckdb_with("postings", "seen")

COMPANIES = ("SRC3 ", "src7", *COMPANY_BLOCKLIST)
TITLES_OUT = (*TITLE_BLOCKLIST, "hot ")
TITLES_IN = ("Ring", "plate", "trainer")
PLACES_IN = (" Asia", "EUROPE ", "america")
PLACES_OUT = ("canada", "Middle East", "china")
TEXT_IN = ("python", "KAFKA", "git rest")
RULES = FilterRules(
    company_blocklist=COMPANIES,
    title_blocklist=TITLES_OUT,
    title_allowlist=("r", "o", "a"),
    required_locations=PLACES_IN,
    excluded_locations=PLACES_OUT,
    description_blocklist=CLEARANCE_KEYWORDS,
    description_allowlist=("the", "une", "und", "python"),
    is_remote=True,
)
RULES_OFF = FilterRules(
    **{**RULES.__dict__, "disabled": frozenset({"seen", "remote", "location_exclusion"})}
)
WIDENING = Lookback(240, 48, 480, 30)
LOOKBACK = Lookback(start=24, step=24, limit=168, minimum=90)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_any(column: str, words, strip: bool = False) -> str:
    clean = [(w.strip() if strip else w).lower() for w in words]
    return "(" + " OR ".join(f"contains(coalesce(lower({column}), ''), {sql_text(w)})" for w in clean) + ")"


def sql_norm(column: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL OR {column} = 'nan' THEN '' "
        f"ELSE regexp_replace(lower({column}), '^\\s+|\\s+$', '', 'g') END"
    )


def sql_not_company(names) -> str:
    quoted = ", ".join(sql_text(n.strip().lower()) for n in names)
    return f"{sql_norm('company')} NOT IN ({quoted})"


SQL_TESTS = {
    "company_blocklist": sql_not_company(COMPANIES),
    "title_blocklist": "NOT " + sql_any("title", TITLES_OUT),
    "title_allowlist": sql_any("title", RULES.title_allowlist),
    "location": sql_any("location", PLACES_IN, True),
    "location_exclusion": "NOT " + sql_any("location", PLACES_OUT, True),
    "remote": "(is_remote IS NULL OR is_remote)",
    "description_blocklist": "NOT " + sql_any("description", CLEARANCE_KEYWORDS),
    "description_allowlist": sql_any("description", RULES.description_allowlist),
}
SQL_SEEN = "id NOT IN (SELECT id FROM seen)"


def chain_sql(names, seen: bool = True) -> str:
    return " AND ".join([*([SQL_SEEN] if seen else []), *[SQL_TESTS[n] for n in names]])


def search_sql(wider: int = 0) -> str:
    """Pairs of postings and searches in SQL, each search at its own window and so many hours more."""
    rows = ", ".join(
        f"({s.search_no}, {sql_text(s.search_term)}, {sql_text(s.location)}, {s.is_remote}, "
        f"{s.hours_old}, {s.results_per_source})"
        for s in SEARCHES
    )
    return f"""
searches AS (SELECT * FROM (VALUES {rows})
  AS s(search_no, search_term, location, is_remote, hours_old, results_per_source)),
hits AS (SELECT p.*, s.search_no, s.results_per_source, s.hours_old FROM postings p JOIN searches s
  ON contains(lower(p.title), s.search_term) AND contains(lower(p.location), s.location)
  AND (p.is_remote IS NULL OR p.is_remote = s.is_remote)
  AND p.date_posted >= (SELECT max(date_posted) FROM postings) - to_hours(s.hours_old + {wider})),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search_no
  ORDER BY date_posted DESC, id) AS rn FROM hits) WHERE rn <= results_per_source)"""


def lookback_sql(source: str, lb: Lookback, order: str = "id", start: str = "") -> str:
    start = start or str(lb.start)
    last = lb.last_pass if lb.minimum > 0 else 0
    return f"""
aged AS (SELECT *, greatest(0, CAST(ceil(((epoch_us((SELECT max(date_posted) FROM postings))
    - epoch_us(date_posted)) / 3600000000.0 - {start}) / {lb.step}) AS INT)) AS pass_no
  FROM {source}),
keyed AS (SELECT *, {sql_norm('title')} AS t, {sql_norm('company')} AS c FROM aged
  WHERE pass_no <= {last}),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, c
  ORDER BY pass_no, {order}) AS rn_first FROM keyed) WHERE rn_first = 1),
totals AS (SELECT k AS pass_no, (SELECT count(*) FROM firsts f WHERE f.pass_no <= k) AS total
  FROM range(0, {last} + 1) r(k)),
chosen AS (SELECT coalesce(min(pass_no) FILTER (WHERE total >= {lb.minimum}), {last}) AS pass_no
  FROM totals),
kept AS (SELECT *, CAST({start} + (SELECT pass_no FROM chosen) * {lb.step} AS INT) AS hours_used FROM firsts
  WHERE pass_no <= (SELECT pass_no FROM chosen))"""


# Postings without an id, and with ids that repeat.
ODD_SQL = """SELECT CASE WHEN CAST(id AS INT) % 5 = 0 THEN NULL ELSE substr(id, 1, 2) END AS id, title,
  company, date_posted FROM postings"""


def odd_ids(v: Views):
    number = F.col("id").cast("int")
    return v.postings.select(
        F.when(number % 5 != 0, F.substring("id", 1, 2)).alias("id"), "title", "company", "date_posted"
    )


def funnel_sql() -> str:
    names = ["seen", *SQL_TESTS]
    counts, passed = ["(SELECT count(*) FROM postings) AS n0"], []
    for i, name in enumerate(names, 1):
        passed.append(SQL_SEEN if name == "seen" else SQL_TESTS[name])
        counts.append(f"(SELECT count(*) FROM postings WHERE {' AND '.join(passed)}) AS n{i}")
    keys = f"SELECT DISTINCT {sql_norm('title')}, {sql_norm('company')} FROM postings"
    counts.append(f"(SELECT count(*) FROM ({keys} WHERE {' AND '.join(passed)})) AS kept")
    rows = [
        f"SELECT {i} AS step_no, '{n}' AS filter_name, n{i - 1} AS rows_before, n{i} AS rows_after FROM c"
        for i, n in enumerate(names, 1)
    ]
    k = len(names)
    rows.append(f"SELECT {k + 1}, 'reposts', n{k}, kept FROM c")
    return f"{PS}, c AS (SELECT {', '.join(counts)}) " + " UNION ALL ".join(rows)


BASE = ("id", "title", "company")


def base(df, *more):
    return df.select(*BASE, *more)


def q_clean(v: Views):
    n = F.col("id").cast("double")
    df = v.postings.select(
        "id",
        "date_posted",
        "is_remote",
        F.to_date("date_posted").alias("day"),
        F.when(F.col("id").cast("int") % 5 == 0, float("nan")).otherwise(n / 2).alias("min_amount"),
        F.when(F.col("id").cast("int") % 7 == 0, float("inf")).otherwise(n * 1000).alias("max_amount"),
    )
    return shaping.clean_records(df)


def q_parse_link(v: Views):
    link = F.when(F.col("id").cast("int") % 9 == 0, F.col("title")).otherwise(
        labels.make_link(F.col("title"), F.col("job_url"))
    )
    df = v.postings.select("id", link.alias("job_link"))
    return df.select(
        "id",
        labels.link_text(F.col("job_link")).alias("link_text"),
        labels.link_url(F.col("job_link")).alias("link_url"),
    )


def q_union(v: Views):
    remote = v.postings.where("is_remote").select("id", "title", F.lit(0).alias("search_no"))
    other = v.postings.where("is_remote IS NOT TRUE").select("id", "company", F.lit(1).alias("search_no"))
    return ranking.union_searches([remote, other])


def keyword_tables(v: Views):
    """Keyword tables made of the titles and companies of the postings."""
    p = v.postings
    titles = p.select(F.lit("title_blocklist").alias("list_name"), F.col("title").alias("keyword"))
    firms = p.select(F.lit("company_blocklist").alias("list_name"), F.col("company").alias("keyword"))
    return titles, firms


def q_blocklist_union(v: Views):
    titles, firms = keyword_tables(v)
    return ranking.blocklist_union(titles.union(firms), firms)


def q_company_table(v: Views):
    """Blocked companies as a table: those with a job in the first nation's region."""
    blocked = v.postings.where(F.col("location").contains("AFRICA")).where(
        F.col("title").contains("blue")
    )
    return base(
        filters.filter_company_blocklist(v.postings, blocked.select(F.col("company").alias("keyword")))
    )


def q_tables(v: Views):
    def named(name, table, condition, column):
        chosen = v.spark.read.parquet(f"{v.sf_dir}/{table}.parquet").where(condition)
        return chosen.select(F.lit(name).alias("list_name"), F.col(column).alias("keyword"))

    lists = (
        named("excluded_locations", "nation", "n_regionkey = 0", "n_name")
        .union(named("required_locations", "region", "r_regionkey < 3", "r_name"))
        .union(named("company_blocklist", "documents", "doc_id % 100 = 7", "source"))
        .union(v.spark.sql("SELECT 'title_blocklist', 'STAFF' UNION ALL SELECT 'description_allowlist', NULL"))
    )
    return base(filters.filter_by_tables(v.postings, lists))


def part_names(v: Views):
    return v.table("part").select(F.lower("p_name").alias("keyword"))


def q_keyword_join(v: Views):
    """All part names as one list against all titles."""
    texts = v.postings.select("id", F.lower("title").alias("text"))
    pairs = keyword_join.keyword_hits(texts, part_names(v))
    keyed = texts.withColumn("key", keyword_join.text_key(F.col("text")))
    return keyed.join(pairs, "key").select("id", "keyword")


def benchmark_words(v: Views):
    """Words of the benchmark, those of fewer than four letters too, as one long list."""
    return v.table("benchmark").select(F.explode(F.split("text", " ")).alias("keyword"))


def q_long_lists(v: Views):
    """Titles with a part name, descriptions without any of the longer benchmark words."""
    kept = keyword_join.filter_by_keyword_table(v.postings, part_names(v), "title", True)
    words = benchmark_words(v).where(F.char_length("keyword") >= 11)
    return base(keyword_join.filter_by_keyword_table(kept, words, "description", False))


def q_description_words(v: Views):
    """Number of benchmark words of every length that each description holds."""
    texts = v.postings.select("id", F.lower("description").alias("text"))
    words = benchmark_words(v).select(F.lower("keyword").alias("keyword"))
    pairs = keyword_join.keyword_hits(texts, words).groupBy("key").agg(F.count("*").alias("n_words"))
    keyed = texts.withColumn("key", keyword_join.text_key(F.col("text")))
    return keyed.join(pairs, "key").select("id", "n_words")


SEARCH_TABLE = """
SELECT CAST(p_partkey AS INT) AS search_no,
  CASE WHEN p_partkey % 40 = 0 THEN '' WHEN p_partkey % 41 = 0 THEN NULL
    WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS search_term,
  CASE p_partkey % 4 WHEN 0 THEN ' Asia ' WHEN 1 THEN 'europe' WHEN 2 THEN '' END AS location,
  CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_remote,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(48 + p_partkey % 9 * 48 AS INT) END AS hours_old,
  20 AS results_per_source,
  CASE p_partkey % 5 WHEN 0 THEN 'fulltime' WHEN 1 THEN 'contract' ELSE '' END AS job_type
FROM {part}
"""


def q_search_table(v: Views):
    """One search for every row of the part table."""
    searches = v.spark.sql(SEARCH_TABLE, part=v.table("part"))
    found = keyword_join.join_search_table(v.postings.drop("description"), searches, v.as_of)
    return found.select("id", "search_no", "search_term")


def hits(v: Views):
    return ranking.join_searches(v.postings, SEARCHES, v.as_of)


SEARCH_TEXT = "id, title, company, location, search_no"
STRICT_RULES = ("title_blocklist", "description_blocklist")
INGEST_RULES = FilterRules(
    title_blocklist=TITLES_OUT, description_blocklist=CLEARANCE_KEYWORDS
)
# The last search has rules of its own, on top of which nothing of the common ones is left out.
OWN_SEARCHES = [
    *SEARCHES[:-1],
    replace(SEARCHES[-1], rules=replace(INGEST_RULES, required_locations=("EUROPE", "asia"))),
]
OWN_SQL = (
    f"(search_no <> {SEARCHES[-1].search_no} OR contains(lower(location), 'europe') "
    "OR contains(lower(location), 'asia'))"
)

CHECKS = {
    "norm_key": (
        lambda v: v.postings.select(
            "id",
            TX.norm_key(F.concat(F.lit(" \t"), "title", F.lit("\n "))).alias("title_key"),
            TX.norm_key(F.when(F.col("is_remote"), "nan").otherwise(F.col("company"))).alias("company_key"),
        ),
        f"""{P}, x AS (SELECT id, concat(' ', chr(9), title, chr(10), ' ') AS t,
  CASE WHEN is_remote THEN 'nan' ELSE company END AS c FROM postings)
SELECT id, {sql_norm('t')} AS title_key, {sql_norm('c')} AS company_key FROM x""",
    ),
    "clean_records": (
        q_clean,
        f"""{P}, x AS (SELECT id, date_posted, is_remote, CAST(date_posted AS DATE) AS day,
  CASE WHEN CAST(id AS INT) % 5 = 0 THEN NULL ELSE CAST(id AS DOUBLE) / 2 END AS a,
  CASE WHEN CAST(id AS INT) % 7 = 0 THEN NULL ELSE CAST(id AS BIGINT) * 1000 END AS b FROM postings)
SELECT id, strftime(date_posted, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN epoch_us(date_posted) % 1000000 = 0 THEN '' ELSE strftime(date_posted, '.%f') END AS date_posted,
  is_remote, strftime(day, '%Y-%m-%d') AS day,
  CASE WHEN a = floor(a) THEN CAST(CAST(a AS BIGINT) AS VARCHAR) ELSE CAST(a AS VARCHAR) END AS min_amount,
  CAST(b AS VARCHAR) AS max_amount FROM x""",
    ),
    "make_job_link": (
        lambda v: shaping.make_job_link(
            v.postings.withColumn("title", F.when(F.col("is_remote"), F.col("title"))), False
        ).select("id", "company", "job_link"),
        f"""{P} SELECT id, company, CASE WHEN is_remote THEN '[' || title || '](' || job_url || ')' END
AS job_link FROM postings""",
    ),
    "parse_job_link": (
        q_parse_link,
        f"""{P} SELECT id, title AS link_text,
CASE WHEN CAST(id AS INT) % 9 <> 0 THEN job_url END AS link_url FROM postings""",
    ),
    "keep_columns": (
        lambda v: shaping.keep_columns(
            v.postings, ["job_type", "id", "salary_source", "location", "title"]
        ),
        f"{P} SELECT job_type, id, location, title FROM postings",
    ),
    "drop_all_null_columns": (
        lambda v: shaping.drop_all_null_columns(
            base(v.postings, "is_remote", F.lit(None).cast("string").alias("salary_source"))
        ),
        f"{P} SELECT id, title, company, is_remote FROM postings",
    ),
    "filter_seen": (
        lambda v: base(filters.filter_seen(v.postings, v.seen)),
        f"{PS} SELECT id, title, company FROM postings WHERE {SQL_SEEN}",
    ),
    "filter_company_blocklist": (
        lambda v: base(filters.filter_company_blocklist(v.postings, COMPANIES)),
        f"{P} SELECT id, title, company FROM postings WHERE {SQL_TESTS['company_blocklist']}",
    ),
    "filter_company_blocklist_table": (
        q_company_table,
        f"""{P} SELECT id, title, company FROM postings WHERE company NOT IN (SELECT company
FROM postings WHERE contains(location, 'AFRICA') AND contains(title, 'blue'))""",
    ),
    "filter_title_blocklist": (
        lambda v: base(filters.filter_title_blocklist(v.postings, TITLES_OUT)),
        f"{P} SELECT id, title, company FROM postings WHERE {SQL_TESTS['title_blocklist']}",
    ),
    "filter_title_allowlist": (
        lambda v: base(filters.filter_title_allowlist(v.postings, TITLES_IN)),
        f"{P} SELECT id, title, company FROM postings WHERE {sql_any('title', TITLES_IN)}",
    ),
    "filter_location_required": (
        lambda v: base(filters.filter_location_required(v.postings, PLACES_IN), "location"),
        f"{P} SELECT id, title, company, location FROM postings WHERE {SQL_TESTS['location']}",
    ),
    "filter_location_excluded": (
        lambda v: base(filters.filter_location_excluded(v.postings, PLACES_OUT), "location"),
        f"{P} SELECT id, title, company, location FROM postings WHERE {SQL_TESTS['location_exclusion']}",
    ),
    "filter_remote": (
        lambda v: base(filters.filter_remote(v.postings, False), "is_remote"),
        f"{P} SELECT id, title, company, is_remote FROM postings WHERE is_remote IS NULL OR NOT is_remote",
    ),
    "filter_description_blocklist": (
        lambda v: base(filters.filter_description_blocklist(v.postings, CLEARANCE_KEYWORDS)),
        f"{P} SELECT id, title, company FROM postings WHERE {SQL_TESTS['description_blocklist']}",
    ),
    "filter_description_allowlist": (
        lambda v: base(filters.filter_description_allowlist(v.postings, TEXT_IN)),
        f"{P} SELECT id, title, company FROM postings WHERE {sql_any('description', TEXT_IN)}",
    ),
    "filter_chain": (
        lambda v: base(filters.filter_chain(v.postings, RULES, v.seen), "location", "is_remote"),
        f"{PS} SELECT id, title, company, location, is_remote FROM postings WHERE {chain_sql(SQL_TESTS)}",
    ),
    "filter_chain_disabled": (
        lambda v: base(filters.filter_chain(v.postings, RULES_OFF, v.seen)),
        f"""{P} SELECT id, title, company FROM postings
WHERE {chain_sql([n for n in SQL_TESTS if n not in RULES_OFF.disabled], False)}""",
    ),
    "filter_funnel": (
        lambda v: filters.filter_funnel(v.postings, RULES, v.seen),
        funnel_sql(),
    ),
    "filter_window": (
        lambda v: base(filters.filter_window(v.postings, v.as_of, 72), "date_posted"),
        f"""{P} SELECT id, title, company, date_posted FROM postings
WHERE date_posted >= (SELECT max(date_posted) FROM postings) - INTERVAL 72 HOUR""",
    ),
    "filter_job_type": (
        lambda v: base(filters.filter_job_type(v.postings, "contract"), "job_type"),
        f"{P} SELECT id, title, company, job_type FROM postings WHERE job_type = 'contract'",
    ),
    "hard_rules": (
        lambda v: rules.hard_rules(v.postings, "asia", ("SRC5", *COMPANY_BLOCKLIST)).select(
            "id", "rule_no", "rule_text", "overall_score"
        ),
        f"""{P}, x AS (SELECT id, CASE
  WHEN coalesce(list_max(CAST(regexp_extract_all(lower(coalesce(description, '')),
    '(\\d{{1,2}})\\s*\\+?\\s*(?:years|yrs)', 1) AS INT[])) >= 6, false) THEN 1
  WHEN NOT ({sql_not_company(("SRC5", *COMPANY_BLOCKLIST))}) THEN 2
  WHEN regexp_matches(coalesce(title, ''), '(?i)\\bai (trainer|training)\\b') THEN 3
  WHEN {sql_any('description', CLEARANCE_KEYWORDS)} THEN 4
  WHEN regexp_matches(coalesce(description, ''), '(?i)hybrid|on-?site|in[- ]person')
    AND NOT contains(lower(location), 'asia') THEN 5 END AS rule_no FROM postings)
SELECT id, rule_no, CASE rule_no WHEN 1 THEN 'requires 6 or more years of experience'
  WHEN 2 THEN 'company is a job board' WHEN 3 THEN 'AI trainer position'
  WHEN 4 THEN 'requires a security clearance' WHEN 5 THEN 'on-site or hybrid outside the home region'
  END AS rule_text, CASE WHEN rule_no IS NOT NULL THEN 0 END AS overall_score FROM x""",
    ),
    "join_searches": (
        lambda v: hits(v).select("id", "title", "company", "location", "search_no"),
        f"{P}, {search_sql()} SELECT {SEARCH_TEXT} FROM hits",
    ),
    "keyword_join": (
        q_keyword_join,
        f"""{P} SELECT id, keyword FROM postings
JOIN (SELECT DISTINCT lower(p_name) AS keyword FROM part) ON contains(lower(title), keyword)""",
    ),
    "keyword_join_descriptions": (
        q_description_words,
        f"""{P}, words AS (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS keyword FROM benchmark)
SELECT id, count(*) AS n_words FROM postings JOIN words ON keyword <> '' AND contains(lower(description), keyword)
GROUP BY id""",
    ),
    "filter_long_lists": (
        q_long_lists,
        f"""{P}, words AS (SELECT DISTINCT keyword FROM (SELECT unnest(string_split(text, ' ')) AS keyword FROM benchmark)
  WHERE length(keyword) >= 11)
SELECT id, title, company FROM postings p WHERE EXISTS (SELECT 1 FROM part WHERE contains(lower(p.title), lower(p_name)))
  AND NOT EXISTS (SELECT 1 FROM words WHERE contains(coalesce(lower(p.description), ''), lower(keyword)))""",
    ),
    "join_search_table": (
        q_search_table,
        f"""{P}, searches AS ({SEARCH_TABLE.format(part='part').strip()}),
latest AS (SELECT max(date_posted) AS as_of FROM postings)
SELECT id, search_no, search_term FROM postings p, searches s, latest
WHERE (coalesce(search_term, '') = '' OR contains(lower(title), lower(search_term)))
  AND (coalesce(trim(s.location), '') = '' OR contains(lower(p.location), lower(trim(s.location))))
  AND (s.is_remote IS NULL OR p.is_remote IS NULL OR s.is_remote = p.is_remote)
  AND (hours_old IS NULL OR date_posted >= as_of - to_hours(hours_old))
  AND (s.job_type = '' OR s.job_type = p.job_type)""",
    ),
    "topn_per_search": (
        lambda v: ranking.topn_per_search(hits(v).drop("description"), largest=50).select(
            "id", "title", "company", "location", "search_no"
        ),
        f"{P}, {search_sql()} SELECT {SEARCH_TEXT} FROM capped",
    ),
    "dedup_reposts": (
        lambda v: ranking.dedup_reposts(v.postings, ("id",)).select(
            "id", "title", "company", F.length("description").alias("n_chars")
        ),
        f"""{P} SELECT id, title, company, CAST(length(description) AS INT) AS n_chars FROM (SELECT *,
  row_number() OVER (PARTITION BY {sql_norm('title')}, {sql_norm('company')} ORDER BY id) AS rn
  FROM postings) WHERE rn = 1""",
    ),
    "unique_ids": (
        lambda v: base(ranking.unique_ids(odd_ids(v), ("date_posted", "title"))),
        f"""{P}, odd AS ({ODD_SQL})
SELECT id, title, company FROM (SELECT *, row_number() OVER (PARTITION BY id
  ORDER BY date_posted, title, company) AS rn FROM odd) WHERE rn = 1 OR id IS NULL""",
    ),
    "dedup_odd_ids": (
        lambda v: ranking.dedup_reposts(odd_ids(v), ("date_posted", "id")).select("title", "company", "date_posted"),
        f"""{P}, odd AS ({ODD_SQL})
SELECT title, company, date_posted FROM (SELECT *, row_number() OVER (PARTITION BY {sql_norm('title')},
  {sql_norm('company')} ORDER BY date_posted, id NULLS FIRST, title, company) AS rn FROM odd) WHERE rn = 1""",
    ),
    "adaptive_lookback": (
        lambda v: lookback.adaptive_lookback(
            filters.filter_chain(v.postings, INGEST_RULES, v.seen), v.as_of, LOOKBACK
        ).select("id", "title", "company", "pass_no", "hours_old"),
        f"""{PS}, passed AS (SELECT * FROM postings WHERE {chain_sql(STRICT_RULES)}),
{lookback_sql('passed', LOOKBACK)}
SELECT id, title, company, pass_no, hours_used AS hours_old FROM kept""",
    ),
    "new_postings": (
        lambda v: ingest.new_postings(
            v.postings, OWN_SEARCHES, INGEST_RULES, v.seen, v.as_of, WIDENING
        ).select(
            "id", "title", "company", "search_no", "hours_old", F.length("description").alias("n_chars")
        ),
        f"""{PS}, {search_sql(240)},
passed AS (SELECT * FROM capped WHERE {chain_sql(STRICT_RULES)} AND {OWN_SQL}),
{lookback_sql('passed', WIDENING, 'search_no, id', 'hours_old')}
SELECT id, title, company, search_no, hours_used AS hours_old,
  CAST(length(description) AS INT) AS n_chars FROM kept""",
    ),
    "filter_by_tables": (
        q_tables,
        f"""{P}, lists AS (SELECT 'excluded_locations' AS list_name, n_name AS keyword FROM nation
    WHERE n_regionkey = 0 UNION ALL SELECT 'required_locations', r_name FROM region WHERE r_regionkey < 3
  UNION ALL SELECT 'company_blocklist', source FROM documents WHERE doc_id % 100 = 7
  UNION ALL SELECT 'title_blocklist', 'STAFF' UNION ALL SELECT 'description_allowlist', NULL)
SELECT id, title, company FROM postings p WHERE {sql_norm('company')} NOT IN (SELECT lower(keyword) FROM lists
    WHERE list_name = 'company_blocklist')
  AND NOT EXISTS (SELECT 1 FROM lists WHERE list_name = 'excluded_locations' AND contains(lower(p.location), lower(keyword)))
  AND EXISTS (SELECT 1 FROM lists WHERE list_name = 'required_locations' AND contains(lower(p.location), lower(keyword)))
  AND NOT contains(lower(p.title), 'staff')""",
    ),
    "ingest_funnel": (
        lambda v: ingest.ingest_funnel(v.postings, SEARCHES, RULES, v.seen, v.as_of),
        f"""{PS}, {search_sql()}, all_postings AS (SELECT * FROM capped),
{funnel_sql().removeprefix(f"{PS}, ").replace('FROM postings', 'FROM all_postings')}""",
    ),
    "union_searches": (
        q_union,
        f"""{P} SELECT id, title, 0 AS search_no, NULL::VARCHAR AS company FROM postings WHERE is_remote
UNION ALL SELECT id, NULL, 1, company FROM postings WHERE is_remote IS NOT TRUE""",
    ),
    "union_seen": (
        lambda v: ranking.union_seen(v.seen, v.postings),
        f"{PS} SELECT id FROM seen UNION SELECT id FROM postings",
    ),
    "blocklist_union": (
        q_blocklist_union,
        f"""{P} SELECT DISTINCT 'title_blocklist' AS list_name, title AS keyword FROM postings
UNION SELECT DISTINCT 'company_blocklist', company FROM postings""",
    ),
    "preview": (
        lambda v: base(ranking.preview(filters.filter_remote(v.postings, True))),
        f"""{P} SELECT id, title, company FROM postings WHERE is_remote IS NULL OR is_remote
ORDER BY id LIMIT 5""",
    ),
}
