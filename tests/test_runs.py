"""One commit for the output and the state of a run; options of scoring steps."""

import datetime

import pytest
from pyspark.sql import functions as F

from fitrank.config import FilterRules, Lookback, ScoreStep, Search
from fitrank.plans import ingest, scoring
from fitrank.sources import postings, seen

DAY = datetime.datetime(2024, 5, 10)
SEARCHES = [Search(0, "engineer", "", True, 24, 10, "")]
POOL = "id string, title string, company string, location string, date_posted timestamp, job_type string, is_remote boolean, description string"


def pool(spark, ids):
    hour = datetime.timedelta(hours=1)
    rows = [(i, f"engineer {i}", "c", "x", DAY - hour, "fulltime", True, f"text {i}") for i in ids]
    return spark.createDataFrame(rows, POOL)


def run(spark, table, folder, run_id=None):
    out, state = f"{folder}/out", f"{folder}/seen dir=1"
    known = seen.read_seen(spark, state)
    return ingest.run_ingest(
        table, SEARCHES, FilterRules(), known, F.lit(DAY), out, state, Lookback(), run_id
    ).first()


def ids(spark, folder, run_id):
    return sorted(r.id for r in postings.read_run(spark, f"{folder}/out", run_id).collect())


def known(spark, folder):
    return sorted(r.id for r in seen.read_seen(spark, f"{folder}/seen dir=1").collect())


@pytest.mark.parametrize("again", ["first", "other"])
def test_a_run_that_breaks_off_before_its_manifest_is_none(spark, tmp_path, monkeypatch, again):
    def broken(*_):
        write(*_)
        raise RuntimeError("lost")

    write = ingest.write_run_ids
    monkeypatch.setattr(ingest, "write_run_ids", broken)
    with pytest.raises(RuntimeError):
        run(spark, pool(spark, "ab"), tmp_path, "first")
    monkeypatch.undo()
    assert known(spark, tmp_path) == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND|no complete run"):
        ids(spark, tmp_path, "first")
    assert run(spark, pool(spark, "ab"), tmp_path, again).run_id == again
    assert ids(spark, tmp_path, again) == known(spark, tmp_path) == ["a", "b"]
    # The next run brings only what is new.
    run(spark, pool(spark, "abc"), tmp_path, "next")
    assert ids(spark, tmp_path, "next") == ["c"]
    assert known(spark, tmp_path) == ["a", "b", "c"]


def test_imported_ids_count_with_those_of_runs_and_are_compacted(spark, tmp_path):
    state = f"{tmp_path}/seen dir=1"
    spark.createDataFrame([("a",)], "id string").write.parquet(state)
    for i, found in enumerate(["ab", "abc", "bcd"]):
        run(spark, pool(spark, found), tmp_path, f"run {i}")
    assert [ids(spark, tmp_path, f"run {i}") for i in range(3)] == [["b"], ["c"], ["d"]]
    assert known(spark, tmp_path) == ["a", "b", "c", "d"]
    seen.compact_seen(spark, state, f"{tmp_path}/new", 2)
    assert len(list((tmp_path / "new").glob("*.parquet"))) <= 2
    assert sorted(r.id for r in seen.read_seen(spark, f"{tmp_path}/new").collect()) == ["a", "b", "c", "d"]


def test_options_reach_their_step_and_unknown_ones_are_refused(spark):
    import pandas as pd

    table = spark.createDataFrame([("1", "aaaa bb"), ("2", "b")], "id string, description string")
    profile = spark.createDataFrame([("x",)], "text string")

    def factory():
        return lambda texts, wants: pd.Series([float(t.count("bb")) for t in texts])

    step = ScoreStep("cross_encoder_score", "cross_encoder_score", options={"factory": factory, "window": 4})
    scored = scoring.apply_steps(table, profile, [step]).collect()
    whole = scoring.apply_steps(table, profile, [ScoreStep(step.name, step.column, options={"factory": factory})])
    assert [r.cross_encoder_score for r in scored] == [r.cross_encoder_score for r in whole.collect()]
    words = ScoreStep("keyword_match", "keyword_match_score", options={"tech_terms": ["bb"]})
    assert scoring.apply_steps(table, profile, [words]).count() == 2
    for name in scoring.STEPS:
        with pytest.raises(ValueError, match="unknown options"):
            scoring.apply_steps(table, profile, [ScoreStep(name, "x", options={"windows": 3})])
