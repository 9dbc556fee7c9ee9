"""Checks on physical plans, with broadcasts switched off so that sizes here do not hide shuffles."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from checks import scoring_checks
from checks.views import Views
from fitrank.config import FilterRules, Lookback
from fitrank.operators import filters, lookback, ranking, scoring, tfidf
from fitrank.plans import ingest
from fitrank.plans.scoring import score_postings

SF = "/root/testdata/sf0.001"


@contextmanager
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def stored(spark, tmp_path):
    """The views written out, so that plans start at a scan."""
    v = Views(spark, SF)
    v.postings.write.parquet(str(tmp_path / "postings"))
    v.__dict__["postings"] = spark.read.parquet(str(tmp_path / "postings"))
    return v


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["keyword_match", "tfidf_cosine", "embedding_cosine", "parse_responses", "composite_score", "score_postings"],
)
def test_scores_stay_in_the_jvm(spark, name):
    text = plan(scoring_checks.CHECKS[name][0](Views(spark, SF)))
    assert not re.search(r"(Eval|Map|Group|InPandas|InArrow)\w*(Python|Pandas|Arrow)\w* ", text)


def test_predicates_and_columns_reach_the_scan(stored):
    text = plan(filters.filter_remote(filters.filter_job_type(stored.postings, "contract"), True).select("id"))
    assert "EqualTo(job_type,contract)" in text
    assert "ReadSchema: struct<id:string,job_type:string,is_remote:boolean>" in text
    assert "Exchange" not in text


def test_row_scores_need_no_shuffle(stored):
    wanted = stored.spark.createDataFrame([("python",)], "text string")
    assert "Exchange" not in plan(scoring.keyword_match(stored.postings, wanted))
    assert "Exchange" not in plan(tfidf.term_frequencies(stored.postings))


def test_search_join_is_one_narrow_stage(stored):
    from checks.views import SEARCHES

    text = plan(ranking.join_searches(stored.postings, SEARCHES, F.lit("2024-01-31").cast("timestamp_ntz")))
    assert "Exchange" not in text and "Join" not in text


def test_dedup_sends_one_row_per_key_and_task(stored):
    text = plan(ranking.dedup_reposts(stored.postings.drop("description"), ("id",)))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_min" in text


def test_first_rows_move_no_text_unless_it_is_selected(stored):
    firsts = (
        ranking.unique_ids(stored.postings, ("date_posted",)),
        ranking.dedup_reposts(stored.postings, ("id",)),
        lookback.adaptive_lookback(stored.postings, F.lit("2024-01-31"), Lookback(24, 24, 168, 10)),
    )
    for df in firsts:
        narrow = shuffled_columns(df.select("id", "title"))
        # The aggregate of a text has a value and the row it belongs to.
        assert narrow and not any("description" in c or "Extremum" in c for c in narrow)
        assert any("Extremum" in c for c in shuffled_columns(df))


def test_topn_cuts_before_each_shuffle(stored):
    hits = stored.postings.withColumn("search_no", F.crc32("title"))
    text = plan(ranking.topn_per_search(hits, 5))
    assert text.count("WindowGroupLimit") == 6
    assert text.count("Exchange hashpartitioning") == 3
    # Beyond the limit up to which Spark cuts before a shuffle, the stages stay the same.
    assert plan(ranking.topn_per_search(hits, 5000)).count("Exchange hashpartitioning") == 3


def shuffled_columns(df):
    """The columns that each shuffle of a plan carries."""
    explain = df.sparkSession._jvm.PythonSQLUtils.explainString
    text = explain(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) Exchange[^\n]*\n(?:Input \[\d+\]: )(\[[^\n]*\])", text)


def test_no_text_in_the_shuffles_of_a_narrow_report(spark, stored):
    inputs = {
        "semantic_score": {"vectors": stored.vectors, "profile_vector": stored.profile_vector},
        "llm_fit_score": {"responses": stored.responses},
    }
    with no_broadcast(spark):
        ranked = score_postings(stored.postings, stored.profile, inputs=inputs, columns=("id", "title"))
        carried = shuffled_columns(ranked)
    assert len(carried) > 4 and not any("description" in columns for columns in carried)


def test_few_survivors_do_not_move_the_texts_of_the_pool(spark, stored):
    few = spark.createDataFrame([("3", 1)], "id string, _text_key bigint")
    few = few.withColumns({"title": F.lit("t"), "company": F.lit("c")})
    text = plan(ingest.with_text(few, stored.postings))
    assert "BroadcastHashJoin" in text or "BuildLeft" in text
    assert "SortMergeJoin" not in text


def executed_plan(df):
    """Lines of the plan as it ran, that is without the initial plans of adaptive execution."""
    df.collect()
    kept, skip = [], None
    for line in plan(df).splitlines():
        column = len(line) - len(line.lstrip(" :"))
        if skip is not None and column > skip:
            continue
        skip = column if "== Initial Plan ==" in line else None
        if skip is None:
            kept.append(line)
    return "\n".join(kept)


def pair_shuffles(df):
    """Ids of the executed shuffles of (document, term) pairs; a reused one keeps its id."""
    exchange = r"Exchange hashpartitioning\(term.*REPARTITION_BY_COL, \[plan_id=(\d+)\]"
    return set(re.findall(exchange, executed_plan(df)))


def test_tfidf_tokenizes_once(spark, stored):
    wanted = stored.spark.createDataFrame([("python",)], "text string")
    with no_broadcast(spark):
        df = tfidf.tfidf_scores(stored.postings, wanted)
        assert len(pair_shuffles(df)) == 1
        assert len(pair_shuffles(tfidf.tfidf_cosine(stored.postings, wanted))) == 1
        assert not re.search("CartesianProduct|BroadcastNestedLoop", plan(df))


def test_postings_are_shuffled_once_for_all_scores(spark, stored):
    inputs = {
        "semantic_score": {"vectors": stored.vectors, "profile_vector": stored.profile_vector},
        "llm_fit_score": {"responses": stored.responses},
    }
    with no_broadcast(spark):
        ranked = score_postings(stored.postings, stored.profile, inputs=inputs)
        text = plan(ranked)
        assert len(pair_shuffles(ranked)) == 1
    joins = re.findall(r"SortMergeJoin \[(id#\d+)\], \[_?id#\d+\], LeftOuter", text)
    assert len(joins) == 3 and len(set(joins)) == 1
    assert text.count(f"Exchange hashpartitioning({joins[0]}, ") == 1
    assert not re.search("CartesianProduct|BroadcastNestedLoop", text)


def test_funnel_shuffles_no_text(spark, stored):
    rules = FilterRules(description_blocklist=("x",), title_blocklist=("y",))
    with no_broadcast(spark):
        text = plan(filters.filter_funnel(stored.postings, rules, stored.seen))
    for block in re.findall(r"Exchange hashpartitioning.*?\n(.*)\n", text):
        assert "description#" not in block.split(" AS ")[0]
