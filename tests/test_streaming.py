"""Streaming jobs over several batches and restarts."""

import datetime as dt

from pyspark.sql import functions as F

from fitrank.config import FilterRules
from fitrank.streaming import postings as S

NOW = dt.datetime(2024, 1, 31)
SCHEMA = "id string, title string, company string, date_posted timestamp, description string"


def add(spark, folder, *items):
    """Append a file: items are (id, title, hours before now)."""
    data = [(i, t, "acme", NOW - dt.timedelta(hours=h), "python") for i, t, h in items]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, **options):
    schema = spark.createDataFrame([], SCHEMA).schema
    return S.read_posting_stream(spark, folder, schema=schema, **options)


def ids(spark, folder):
    return sorted(r.id for r in spark.read.parquet(folder).select("id").collect())


def test_each_id_once_over_runs(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        new = S.new_by_id(stream(spark, src, maxFilesPerTrigger=1))
        S.write_stream(new, out, state).awaitTermination()

    add(spark, src, ("1", "a", 5), ("2", "b", 5), ("1", "a", 5))
    add(spark, src, ("2", "b", 900), ("3", "c", 900))
    run()
    assert ids(spark, out) == ["1", "2", "3"]
    run()
    assert ids(spark, out) == ["1", "2", "3"]
    add(spark, src, ("3", "c", 1), ("4", "d", 1))
    run()
    assert ids(spark, out) == ["1", "2", "3", "4"]


def test_bounded_forgets_and_drops_late(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))

    def run():
        new = S.new_by_id_bounded(stream(spark, src), "24 hours")
        S.write_stream(new, out, state).awaitTermination()

    add(spark, src, ("1", "a", 100), ("1", "a", 100))
    run()
    add(spark, src, ("2", "b", 10))
    run()
    add(spark, src, ("1", "a", 5), ("9", "late", 200), ("2", "b", 9))
    run()
    assert ids(spark, out) == ["1", "1", "2"]


def test_scored_batches_equal_runs(spark, tmp_path):
    src, out, seen, state = (str(tmp_path / n) for n in ("in", "out", "seen", "state"))
    profile = spark.createDataFrame([("python",)], "text string")
    rules = FilterRules(title_blocklist=("staff",))

    def run():
        S.filter_score_stream(
            stream(spark, src), profile, rules, out, seen, state
        ).awaitTermination()

    add(spark, src, ("1", "dev", 5), ("2", "Staff", 5), ("3", " DEV ", 5))
    run()
    assert ids(spark, out) == ["1"]
    add(spark, src, ("1", "dev", 5), ("3", "other", 5), ("4", "dev", 5), ("4", "dev", 5))
    run()
    assert ids(spark, out) == ["1", "4"]
    assert ids(spark, seen) == ["1", "2", "3", "4"]
    score = spark.read.parquet(out).agg(F.min("keyword_match_score")).first()[0]
    assert score == 0.7


def test_repeated_batch_leaves_the_same(spark, tmp_path):
    """A batch that runs again after a failure does not take its own ids for seen."""
    out, seen = str(tmp_path / "out"), str(tmp_path / "seen")
    profile = spark.createDataFrame([("python",)], "text string")
    handle = S.scored_batches(profile, FilterRules(), out, seen)
    src = str(tmp_path / "in")
    add(spark, src, ("1", "a", 1), ("2", "b", 1))
    first = spark.read.parquet(src)
    handle(first, 0)
    second = first.union(first.withColumns({"id": F.lit("3"), "title": F.lit("c")}).limit(1))
    handle(second, 1)
    handle(second, 1)
    assert ids(spark, out) == ["1", "2", "3"]
    assert ids(spark, seen) == ["1", "2", "3"]


def test_new_checkpoint_over_old_folders_keeps_everything(spark, tmp_path):
    src, out, seen = (str(tmp_path / n) for n in ("in", "out", "seen"))
    profile = spark.createDataFrame([("python",)], "text string")
    known = spark.createDataFrame([("7",)], "id string")

    def run(state):
        S.filter_score_stream(
            stream(spark, src), profile, FilterRules(), out, seen, str(tmp_path / state), known=known
        ).awaitTermination()

    add(spark, src, ("1", "a", 1), ("7", "z", 1))
    run("first")
    add(spark, src, ("2", "b", 1))
    run("second")
    assert ids(spark, out) == ["1", "2"]
    assert ids(spark, seen) == ["1", "2"]


def test_rows_without_id_are_kept(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    add(spark, src, (None, "a", 5), (None, "b", 5), ("1", "c", 5), ("1", "c", 5))
    S.write_stream(S.new_by_id(stream(spark, src)), out, state).awaitTermination()
    titles = sorted(r.title for r in spark.read.parquet(out).collect())
    assert titles == ["a", "b", "c"]


def test_late_rows_go_aside(spark, tmp_path):
    src, out, late, state = (str(tmp_path / n) for n in ("in", "out", "late", "state"))

    def run():
        S.bounded_stream(stream(spark, src), out, late, 24, state).awaitTermination()

    add(spark, src, ("1", "a", 5), ("1", "a", 5))
    run()
    add(spark, src, ("1", "a", 5), ("2", "b", 28), ("3", "c", 30), ("4", "d", 1))
    run()
    assert ids(spark, out) == ["1", "2", "4"] and ids(spark, late) == ["3"]


def test_counts_per_window(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for items in ([("1", "a", 71), ("2", "b", 70), ("3", "c", 40)], [("4", "d", 1), ("5", "late", 900)]):
        add(spark, src, *items)
        S.ingest_counts(stream(spark, src), out, state).awaitTermination()
    got = sorted((r.window_start.day, r.n) for r in S.read_counts(spark, out).collect())
    assert got == [(24, 1), (28, 2), (29, 1), (30, 1)]
    S.count_batches(out, 24, S.stream_key(state))(spark.read.parquet(src).limit(0), 0)
    assert S.read_counts(spark, out).agg(F.sum("n")).first()[0] == 2


def test_the_files_of_a_check_stream_grow_with_its_table(spark, monkeypatch):
    from types import SimpleNamespace

    from checks import stream_checks

    rows = [(str(i), "a", "acme", NOW) for i in range(95)]
    table = spark.createDataFrame(rows, "id string, title string, company string, date_posted timestamp")
    paths = []
    scratch = stream_checks.new_scratch
    monkeypatch.setattr(stream_checks, "new_scratch", lambda s, label: paths.append(scratch(s, label)) or paths[-1])
    monkeypatch.setattr(stream_checks, "FILE_ROWS", 20)
    stream_checks.stream_of(SimpleNamespace(postings=table, spark=spark), 2)
    written = spark.read.parquet(paths[0])
    assert written.count() == 190
    assert len(written.inputFiles()) == 10
