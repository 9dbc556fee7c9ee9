"""Queries and SQL for text statistics, scores and the ranked report."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.views import Views, duckdb_with
from fitrank.config import DEFAULT_STEPS, ScoreStep
from fitrank.functions import text as TX
from fitrank.functions.answers import SCORE_LINE
from fitrank.functions.fixed_values import ANSWER_PROMPT, ENGLISH_STOP_WORDS, TECH_TERMS
from fitrank.operators import joins, plugins, profiles_join, ranking, scoring, shaping, tfidf
from fitrank.plans.scoring import score_postings

P = duckdb_with("postings")
PP = duckdb_with("postings", "profile")
PPR = duckdb_with("postings", "profile", "responses")
PR = duckdb_with("postings", "responses")

TOKEN = r"[\p{L}\p{N}_]{2,}"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP_SQL = f"stop AS (SELECT unnest([{quoted(ENGLISH_STOP_WORDS)}]) AS term)"
TECH_SQL = f"tech AS (SELECT unnest([{quoted(TECH_TERMS)}]) AS term)"
TOKENS_SQL = f"""{STOP_SQL},
tokens AS (SELECT * FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(description, '')), '{TOKEN}'))
  AS term FROM postings) WHERE term NOT IN (SELECT term FROM stop))"""
WANTED_SQL = f"""wanted AS (SELECT term, count(*) AS tf FROM (SELECT unnest(regexp_extract_all(lower(text),
  '{TOKEN}')) AS term FROM profile) WHERE term NOT IN (SELECT term FROM stop) GROUP BY term)"""
SETS_SQL = f"""{TOKENS_SQL}, {TECH_SQL}, {WANTED_SQL},
sets AS (SELECT p.id, count(d.term) AS n_terms, count(t.term) AS n_tech, count(w.term) AS n_met,
  count(CASE WHEN t.term IS NOT NULL THEN w.term END) AS n_tech_met
  FROM postings p LEFT JOIN (SELECT DISTINCT id, term FROM tokens) d ON d.id = p.id
  LEFT JOIN tech t ON t.term = d.term LEFT JOIN wanted w ON w.term = d.term GROUP BY p.id)"""
KEYWORD_SQL = f"""{SETS_SQL},
keyword AS (SELECT id, 0.7e0 * (n_tech_met / greatest(n_tech, 1))
  + 0.3e0 * ((n_met - n_tech_met) / greatest(n_terms - n_tech, 1)) AS score FROM sets)"""
TFIDF_SQL = """
tf AS (SELECT id, term, count(*) AS tf FROM tokens GROUP BY id, term),
n AS (SELECT count(*) + 1 AS n FROM postings),
df AS (SELECT term, count(*) AS df FROM (SELECT id, term FROM tf UNION ALL SELECT NULL, term FROM wanted)
  GROUP BY term),
idf AS (SELECT term, ln((1e0 + n) / (1e0 + df)) + 1e0 AS idf FROM df, n),
plen AS (SELECT sqrt(sum((tf * idf) ** 2)) AS len FROM wanted JOIN idf USING (term)),
cos AS (SELECT t.id, sum(t.tf * i.idf * w.tf * i.idf) / (sqrt(sum((t.tf * i.idf) ** 2))
    * (SELECT len FROM plen)) AS score
  FROM tf t JOIN idf i USING (term) LEFT JOIN wanted w USING (term) GROUP BY t.id),
tfidf AS (SELECT p.id, coalesce(c.score, 0e0) AS score FROM postings p LEFT JOIN cos c USING (id))"""
SEMANTIC_SQL = """
semantic AS (SELECT p.id, CASE WHEN coalesce(p.description, '') = '' THEN 0e0 ELSE coalesce(
    list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings
    WHERE vec_id = 3) AS DOUBLE[])), 0e0) END AS score
  FROM postings p LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = p.id)"""
ANSWERS_SQL = r"""
points AS (SELECT id, answer, coalesce(
    TRY_CAST(nullif(regexp_extract(answer, '(?i)SCORE:\s*(\d+(?:\.\d+)?)', 1), '') AS DOUBLE),
    list_filter(CAST(regexp_extract_all(answer, '\b(\d+(?:\.\d+)?)\b', 1) AS DOUBLE[]),
      lambda x: x BETWEEN 0 AND 10)[1], 5e0) AS points FROM responses),
answers AS (SELECT id, least(10e0, greatest(0e0, points)) / 10 AS score,
    CASE WHEN regexp_matches(answer, '(?i)REASON:\s*[^\n]+')
      THEN regexp_replace(regexp_extract(answer, '(?i)REASON:\s*([^\n]+)', 1), '^\s+|\s+$', '', 'g')
      ELSE regexp_replace(answer, '^\s+|\s+$', '', 'g') END AS rationale FROM points),
fit AS (SELECT p.id, CASE WHEN coalesce(p.description, '') = '' OR a.id IS NULL THEN 0e0 ELSE a.score END
    AS score, CASE WHEN coalesce(p.description, '') = '' OR a.id IS NULL THEN '' ELSE a.rationale END
    AS rationale FROM postings p LEFT JOIN answers a USING (id))"""

FOUR_STEPS = tuple(s for s in DEFAULT_STEPS if s.enabled)
TWO_STEPS = (
    ScoreStep("keyword_match", "keyword_match_score", 1.0),
    ScoreStep("semantic_score", "semantic_score", 3.0),
    ScoreStep("cross_encoder_score", "cross_encoder_score", 5.0),
    ScoreStep("tfidf_cosine", "tfidf_cosine_score", 2.0, enabled=False),
)
REPORT = (
    "id", "job_link", "company", "location", "job_type", "is_remote", "llm_fit_rationale",
)


def six(df, *scores):
    return df.withColumns({s: F.round(s, 6) for s in scores})


def keyword(v: Views):
    return scoring.keyword_match(v.postings, v.profile)


def two_scores(v: Views):
    """Keyword and vector score, without any text."""
    scored = scoring.embedding_cosine(keyword(v), v.vectors, v.profile_vector)
    return scored.select("id", "keyword_match_score", "semantic_score")


def flagship(v: Views):
    inputs = {
        "semantic_score": {"vectors": v.vectors, "profile_vector": v.profile_vector},
        "llm_fit_score": {"responses": v.responses},
    }
    report = score_postings(v.postings, v.profile, DEFAULT_STEPS, inputs, REPORT)
    return six(report, *[s.column for s in FOUR_STEPS], "final_score")


def q_prompts(v: Views):
    return joins.build_prompts(v.postings, v.profile)


def q_semantic(v: Views):
    scored = scoring.embedding_cosine(v.postings, v.vectors, v.profile_vector)
    return six(scored.select("id", "semantic_score"), "semantic_score")


def q_frozen(v: Views):
    """Other texts, scored with the statistics of the postings."""
    kept = tfidf.document_frequencies(v.postings, v.profile)
    size = v.postings.agg((F.count(F.lit(1)) + 1).alias("n")).scalar()
    texts = v.spark.read.parquet(f"{v.sf_dir}/benchmark.parquet")
    scores = tfidf.tfidf_scores(texts, v.profile, "text", "item_id", frequencies=kept, n_docs=size)
    return six(scores, "score")


def q_embed(v: Views):
    vectors = plugins.embed_postings(v.postings, use_prefix=False)
    return vectors.select(
        "id", F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("slot", "value")
    )


def q_embed_score(v: Views):
    vectors = plugins.embed_postings(v.postings, use_prefix=False)
    wanted = plugins.profile_vector(v.profile, use_prefix=False)
    scored = scoring.embedding_cosine(v.postings, vectors, wanted)
    return six(scored.select("id", "semantic_score"), "semantic_score")


def q_pairs(v: Views):
    scored = plugins.pair_score(v.postings, v.profile)
    # Shares of up to 666 words: at nine digits none of them lies halfway between two values.
    return scored.select("id", F.round("cross_encoder_score", 9).alias("cross_encoder_score"))


def q_select(v: Views):
    df = keyword(v).withColumn("final_score", F.col("keyword_match_score") * 2)
    out = shaping.select_report_columns(df, ["location", "id", "no_such_column"])
    return six(out, "keyword_match_score", "final_score")


HASH_SLOT = "CAST('0x' || md5(term)[1:8] AS BIGINT) % 64"
HASH_SIGN = "CASE WHEN md5(term)[9] < '8' THEN 1 ELSE -1 END"
HASHED_SQL = f"""{P}, hashed AS (SELECT id, {HASH_SLOT} AS slot, sum({HASH_SIGN}) AS value
  FROM (SELECT id, unnest(regexp_extract_all(lower(description), '{TOKEN}')) AS term FROM postings)
  GROUP BY ALL)
SELECT p.id, CAST(s.slot AS INT) AS slot, CAST(coalesce(h.value, 0) AS DOUBLE) AS value
FROM postings p CROSS JOIN range(0, 64) s(slot) LEFT JOIN hashed h ON h.id = p.id AND h.slot = s.slot
WHERE coalesce(p.description, '') <> ''"""
PROMPT_HEAD, _rest = ANSWER_PROMPT.replace("'", "''").split("{job}")
PROMPT_MIDDLE = _rest.split("{resume}")[0]

CHECKS = {
    "tokenize": (
        lambda v: v.postings.select(
            "id", F.array_join(TX.tokenize(F.coalesce("description", F.lit(""))), " ").alias("tokens")
        ),
        f"""{P} SELECT id, array_to_string(regexp_extract_all(lower(coalesce(description, '')), '{TOKEN}'),
' ') AS tokens FROM postings""",
    ),
    "remove_stop_words": (
        lambda v: v.postings.select(
            "id",
            F.array_join(TX.remove_stop_words(TX.tokenize(F.coalesce("description", F.lit("")))), " ").alias("tokens"),
        ),
        f"""{P} SELECT id, array_to_string(list_filter(regexp_extract_all(lower(coalesce(
  description, '')), '{TOKEN}'), lambda x: x NOT IN ({quoted(ENGLISH_STOP_WORDS)})), ' ') AS tokens FROM postings""",
    ),
    "distinct_terms": (
        lambda v: v.postings.select(
            "id", F.explode(TX.distinct_terms(F.col("description"))).alias("term")
        ),
        f"{P}, {TOKENS_SQL} SELECT DISTINCT id, term FROM tokens",
    ),
    "term_frequencies": (
        lambda v: tfidf.term_frequencies(v.postings),
        f"{P}, {TOKENS_SQL} SELECT id, term, CAST(count(*) AS INT) AS tf FROM tokens GROUP BY id, term",
    ),
    "document_frequencies": (
        lambda v: tfidf.document_frequencies(v.postings, v.profile),
        f"""{PP}, {TOKENS_SQL}, {WANTED_SQL} SELECT term, count(*) AS df FROM
(SELECT DISTINCT id, term FROM tokens UNION ALL SELECT NULL, term FROM wanted) GROUP BY term""",
    ),
    "term_set_ops": (
        lambda v: scoring.term_set_ops(v.postings, v.profile).select(
            "id", *[F.col(c).cast("bigint").alias(c) for c in ("n_terms", "n_tech", "n_met", "n_tech_met")]
        ),
        f"{PP}, {SETS_SQL} SELECT * FROM sets",
    ),
    "keyword_match": (
        lambda v: six(keyword(v).select("id", "keyword_match_score"), "keyword_match_score"),
        f"{PP}, {KEYWORD_SQL} SELECT id, round(score, 6) AS keyword_match_score FROM keyword",
    ),
    "tfidf_cosine": (
        lambda v: six(tfidf.tfidf_scores(v.postings, v.profile), "score"),
        f"{PP}, {TOKENS_SQL}, {WANTED_SQL}, {TFIDF_SQL} SELECT id, round(score, 6) AS score FROM tfidf",
    ),
    "tfidf_cosine_frozen": (
        q_frozen,
        f"""{PP}, {TOKENS_SQL}, {WANTED_SQL}, {TFIDF_SQL},
other AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text),
  '{TOKEN}')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT o.item_id, sum(o.tf * i.idf * w.tf * i.idf) / (sqrt(sum((o.tf * i.idf) ** 2))
    * (SELECT len FROM plen)) AS score
  FROM other o JOIN idf i USING (term) LEFT JOIN wanted w USING (term) GROUP BY o.item_id)
SELECT b.item_id, round(coalesce(s.score, 0e0), 6) AS score FROM benchmark b LEFT JOIN scored s USING (item_id)""",
    ),
    "top_postings": (
        lambda v: six(
            profiles_join.top_postings(
                v.postings, v.table("benchmark"), 20, profile_key="item_id"
            ),
            "score",
        ),
        f"""{P}, {TOKENS_SQL}, other AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id,
  unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM benchmark) GROUP BY ALL),
asked AS (SELECT * FROM other WHERE term NOT IN (SELECT term FROM stop)),
tf AS (SELECT id, term, count(*) AS tf FROM tokens GROUP BY id, term),
n AS (SELECT count(*) AS n FROM postings), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT id, term, tf * (ln((1e0 + n) / (1e0 + df)) + 1e0) AS x FROM tf JOIN df USING (term), n),
wanted AS (SELECT item_id, term, tf * (ln((1e0 + n) / (1e0 + coalesce(df, 0))) + 1e0) AS x
  FROM asked LEFT JOIN df USING (term), n),
len AS (SELECT id, sqrt(sum(x * x)) AS len FROM weights GROUP BY id),
own AS (SELECT item_id, sqrt(sum(x * x)) AS len FROM wanted GROUP BY item_id),
scores AS (SELECT item_id, id, sum(w.x * a.x) / any_value(len.len * own.len) AS score
  FROM weights w JOIN wanted a USING (term) JOIN len USING (id) JOIN own USING (item_id) GROUP BY item_id, id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, id) AS INT) AS rank, id,
  round(score, 6) AS score FROM scores QUALIFY rank <= 20""",
    ),
    "embedding_cosine": (
        q_semantic,
        f"{P}, {SEMANTIC_SQL} SELECT id, round(score, 6) AS semantic_score FROM semantic",
    ),
    "embed_text": (q_embed, HASHED_SQL),
    "embed_text_score": (
        q_embed_score,
        f"""{HASHED_SQL.split("SELECT p.id, CAST(s.slot")[0].replace(P, PP)},
wanted AS (SELECT {HASH_SLOT} AS slot, sum({HASH_SIGN}) AS value FROM (SELECT
  unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM profile) GROUP BY ALL),
c AS (SELECT h.id, sum(h.value * w.value) / (nullif(sqrt(sum(h.value ** 2)), 0)
  * (SELECT sqrt(sum(value ** 2)) FROM wanted)) AS score FROM hashed h LEFT JOIN wanted w USING (slot) GROUP BY h.id)
SELECT p.id, round(coalesce(c.score, 0e0), 6) AS semantic_score FROM postings p LEFT JOIN c USING (id)""",
    ),
    "pair_score": (
        q_pairs,
        f"""{PP}, words AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(description),
  '{TOKEN}')) AS term FROM postings),
wanted AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM profile),
n AS (SELECT p.id, count(w.term) AS n, count(x.term) AS k FROM postings p LEFT JOIN words w ON w.id = p.id
  LEFT JOIN wanted x ON x.term = w.term GROUP BY p.id)
SELECT id, round((k + 1e0) / (n + 2e0), 9) AS cross_encoder_score FROM n""",
    ),
    "build_prompts": (
        q_prompts,
        f"""{PP} SELECT id, concat('{PROMPT_HEAD}', description, '{PROMPT_MIDDLE}',
(SELECT text FROM profile)) AS prompt FROM postings WHERE description <> ''""",
    ),
    "parse_responses": (
        lambda v: joins.parse_responses(v.responses),
        f"""{PR}, {ANSWERS_SQL}
SELECT id, score AS llm_fit_score, rationale AS llm_fit_rationale FROM answers""",
    ),
    "join_responses": (
        lambda v: joins.join_responses(
            v.postings, v.responses.where(F.col("answer") != "no number")
        ).select("id", "llm_fit_score", "llm_fit_rationale"),
        f"""{PR.replace("responses AS (", "every_answer AS (")},
responses AS (SELECT * FROM every_answer WHERE answer <> 'no number'), {ANSWERS_SQL}
SELECT id, score AS llm_fit_score, rationale AS llm_fit_rationale FROM fit""",
    ),
    "composite_score": (
        lambda v: six(
            scoring.composite_score(two_scores(v), TWO_STEPS).select("id", "final_score"), "final_score"
        ),
        f"""{PP}, {KEYWORD_SQL}, {SEMANTIC_SQL} SELECT k.id,
round((k.score * 1e0 + s.score * 3e0) / 4e0, 6) AS final_score FROM keyword k JOIN semantic s USING (id)""",
    ),
    "composite_score_by_name": (
        lambda v: six(
            scoring.composite_score_by_name(two_scores(v), TWO_STEPS).select("id", "final_score"),
            "final_score",
        ),
        f"{PP}, {KEYWORD_SQL} SELECT id, round(score, 6) AS final_score FROM keyword",
    ),
    "rank_by_score": (
        lambda v: six(ranking.rank_by_score(two_scores(v), "semantic_score"), "keyword_match_score", "semantic_score"),
        f"""{PP}, {KEYWORD_SQL}, {SEMANTIC_SQL} SELECT k.id, round(k.score, 6) AS keyword_match_score,
round(s.score, 6) AS semantic_score FROM keyword k JOIN semantic s USING (id)
ORDER BY s.score DESC NULLS LAST, k.id""",
    ),
    "topk_report": (
        lambda v: six(
            ranking.topk_report(two_scores(v), 100, "keyword_match_score").select("id", "keyword_match_score"),
            "keyword_match_score",
        ),
        f"""{PP}, {KEYWORD_SQL} SELECT id, round(score, 6) AS keyword_match_score FROM keyword
ORDER BY score DESC, id LIMIT 100""",
    ),
    "select_report_columns": (
        q_select,
        f"""{PP}, {KEYWORD_SQL} SELECT p.location, p.id, round(k.score, 6) AS keyword_match_score,
round(k.score * 2, 6) AS final_score FROM postings p JOIN keyword k USING (id)""",
    ),
    "score_postings": (
        flagship,
        f"""{PPR}, {KEYWORD_SQL}, {TFIDF_SQL}, {SEMANTIC_SQL}, {ANSWERS_SQL}
SELECT p.id, '[' || p.title || '](' || p.job_url || ')' AS job_link, p.company, p.location, p.job_type,
  p.is_remote, f.rationale AS llm_fit_rationale, round(k.score, 6) AS keyword_match_score,
  round(t.score, 6) AS tfidf_cosine_score, round(s.score, 6) AS semantic_score,
  round(f.score, 6) AS llm_fit_score,
  round((k.score * 0.10e0 + t.score * 0.10e0 + s.score * 0.35e0 + f.score * 0.45e0) / (0.10e0 + 0.10e0 + 0.35e0 + 0.45e0), 6) AS final_score
FROM postings p JOIN keyword k USING (id) JOIN tfidf t USING (id) JOIN semantic s USING (id)
JOIN fit f USING (id)""",
    ),
}
assert SCORE_LINE in ANSWERS_SQL
