"""Kept state: statistics by batch, the pool laid out by day, the bucketed seen table."""

import datetime
import glob
import json
import os
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitrank.operators import filters, model_batches, tfidf
from fitrank.operators import report as R
from fitrank.schemas import POSTING
from fitrank.sources import json_lists, pool, search_index, statistics
from fitrank.sources.seen_table import SeenTable

TEXTS = ["spark spark kafka", "kafka, java", None, "", "spark the java", "rust"]
DAY = datetime.datetime(2024, 5, 10, 12)


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, description string")


def as_dict(frame):
    return {r.term: r.df for r in frame.collect()}


def test_batches_equal_one_count(spark, tmp_path):
    path = str(tmp_path / "log")
    assert as_dict(statistics.read_statistics(spark, path)) == {}
    for n in range(3):
        assert statistics.log_statistics(docs(spark, TEXTS[2 * n : 2 * n + 2]), path, f"a b/{n}")
    assert not statistics.log_statistics(docs(spark, TEXTS), path, "a b/0")
    kept = statistics.read_statistics(spark, path)
    assert as_dict(statistics.frequencies(kept)) == as_dict(tfidf.document_frequencies(docs(spark, TEXTS)))
    assert as_dict(kept)[""] == len(TEXTS)

    statistics.log_statistics(docs(spark, TEXTS[:2]), path, "gone", sign=-1)
    left = as_dict(statistics.read_statistics(spark, path))
    assert left.pop("") == 4 and left == as_dict(tfidf.document_frequencies(docs(spark, TEXTS[2:])))

    merged = str(tmp_path / "merged")
    statistics.compact_statistics(spark, path, merged, 2)
    assert not statistics.log_statistics(docs(spark, TEXTS), merged, "a b/1")
    assert as_dict(statistics.frequencies(statistics.read_statistics(spark, merged))) == left


def test_a_batch_without_its_mark_is_none(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    statistics.log_statistics(docs(spark, TEXTS[:1]), path, "0")
    with monkeypatch.context() as m:
        m.setattr(statistics, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            statistics.log_statistics(docs(spark, TEXTS[1:]), path, "1")
    assert as_dict(statistics.read_statistics(spark, path))[""] == 1
    statistics.log_statistics(docs(spark, TEXTS[1:]), path, "1")
    assert as_dict(statistics.read_statistics(spark, path))[""] == len(TEXTS)


def test_empty_batches_and_logs(spark, tmp_path):
    path = str(tmp_path / "log")
    statistics.log_statistics(docs(spark, TEXTS).limit(0), path, "none")
    kept = statistics.read_statistics(spark, path)
    assert as_dict(kept) == {}
    assert spark.range(1).select(statistics.corpus_size(kept).alias("n")).first().n == 0


def postings(spark, hours):
    rows = [
        (str(i), f"t{i}", None if h is None else DAY - datetime.timedelta(hours=h))
        for i, h in enumerate(hours)
    ]
    frame = spark.createDataFrame(rows, "id string, title string, date_posted timestamp")
    return frame.withColumn("extra", F.lit(1))


def ids(frame):
    return sorted(r.id for r in frame.select("id").collect())


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/Los_Angeles"])
def test_windows_equal_the_filter(spark, tmp_path, zone):
    path = str(tmp_path)
    rows = postings(spark, [0, 1, 11, 12, 13, 23, 24, 25, 30, 60, 500, None, -3])
    pool.write_pool(rows.where("id < 6"), path, "a")
    pool.write_pool(rows.where("id >= 6"), path, "b/1")
    pool.write_pool(rows.where("id >= 6"), path, "b/1")
    whole = pool.read_pool(spark, path)
    assert ids(whole) == ids(rows) and whole.columns[: len(POSTING.names)] == POSTING.names
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for hours in (0, 1, 12, 24, 48, 1000):
            for as_of in (F.lit(DAY), rows.agg(F.max("date_posted")).scalar()):
                want = ids(filters.filter_window(rows, as_of, hours))
                assert ids(pool.read_window(spark, path, as_of, hours)) == want
        latest = spark.range(1).select(pool.newest(spark, path).alias("t")).first().t
        assert latest == rows.agg(F.max("date_posted")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_files_outside_a_window_are_not_opened(spark, tmp_path):
    path = str(tmp_path)
    pool.write_pool(postings(spark, [0, 1, 100, 200, None]), path, "a")
    for file in glob.glob(f"{path}/load_id=a/posted_on=*/*.parquet"):
        if "posted_on=2024-05-10" not in file:
            folder, name = os.path.split(file)
            for spoilt in (file, f"{folder}/.{name}.crc"):
                with open(spoilt, "wb") as out:
                    out.write(b"no parquet")
    newest = pool.newest(spark, path)
    window = pool.read_window(spark, path, newest, 2)
    assert "posted_on" in window._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]
    assert ids(window) == ["0", "1"]
    with pytest.raises(Exception, match="posted_on="):
        ids(pool.read_pool(spark, path))


def seen_rows(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "id string")


def test_seen_table_over_many_runs(spark, tmp_path):
    table = SeenTable(spark, "seen_runs", f"{tmp_path}/it's", 4, most_files=3)
    assert table.read().count() == 0
    want = set()
    for run in range(12):
        new = [str(run * 5 + i) for i in range(10)]
        table.add(seen_rows(spark, [*new, None, new[0]]))
        want |= set(new)
        assert table.files() <= 4 * 3
    again = SeenTable(spark, "seen_again", f"{tmp_path}/it's", 9)
    got = [r.id for r in again.read().collect()]
    assert sorted(got) == sorted(want)


def test_a_rewrite_that_breaks_off_is_never_read(spark, tmp_path, monkeypatch):
    table = SeenTable(spark, "seen_broken", str(tmp_path / "seen"), 4)
    table.add(seen_rows(spark, "abc"))
    write = SeenTable._write

    def broken(self, *args, **kwargs):
        write(self, *args, **kwargs)
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(SeenTable, "_write", broken)
        with pytest.raises(OSError):
            table.compact()
    assert ids(table.read()) == ["a", "b", "c"]
    table.compact()
    assert ids(table.read()) == ["a", "b", "c"] and table.files() <= 4


def test_seen_table_is_not_shuffled(spark, tmp_path):
    table = SeenTable(spark, "seen_plan", str(tmp_path / "seen"), 8)
    table.add(seen_rows(spark, [str(i) for i in range(0, 100, 3)]))
    rows = postings(spark, range(100))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        new = filters.filter_seen(rows, table.read())
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert "SelectedBucketsCount: 8 out of 8" in plan
        assert ids(new) == sorted(str(i) for i in range(100) if i % 3)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


RECORDS = [
    {"a": "plain", "b": {"c": [1, 2]}},
    {"a": 'br}ace{ "quoted" \\ and ] , [', "b": {"c": []}},
    {"a": "", "b": None},
    {"a": "\\", "b": {"c": [3]}},
    {"a": '\\"}', "b": {"c": None}},
    {"a": "ünï}cödé\n\u2028 {{{", "b": {"c": [4, 5, 6]}},
    {"a": "{}" * 60, "b": {"c": [7]}},
]
RECORD = "a string, b struct<c: array<int>>"


def json_rows(spark, path):
    found = json_lists.read_json_list(spark, str(path), T._parse_datatype_string(RECORD))
    return sorted(json.dumps(r.asDict(True), sort_keys=True) for r in found.collect())


@pytest.mark.parametrize("size", [3, 11, 29, 64, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_lists_are_read_by_many_tasks(spark, tmp_path, size, indent):
    for n, records in enumerate([RECORDS, RECORDS[::-1], [], RECORDS[4:5]]):
        text = json.dumps(records, indent=indent, ensure_ascii=n == 1)
        (tmp_path / f"{n}.json").write_text(text + "\n" * n, encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = json_rows(spark, tmp_path)
        if size == 29:
            assert json_lists.pieces_of(spark, str(tmp_path)).select("file", "block").distinct().count() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(json.dumps(r, sort_keys=True) for r in [*RECORDS, *RECORDS, RECORDS[4]])


@pytest.mark.parametrize("text", ['[{"a":"x"},{"a":"y', '[{"a":"x"},{"b":{"c":[1]', '[{"a":"x"}', '[{"a":"x"},{"b":3}]', '{"a":"x"}'])
def test_broken_lists_are_errors(spark, tmp_path, text):
    (tmp_path / "one.json").write_text(text)
    with pytest.raises(Exception, match="(?i)JSON"):
        json_rows(spark, tmp_path)


REPORT = [
    ("1", "Acme", "Spark and Kafka"), ("2", "acme", None), ("2", "Öl AG", "x"), (None, "Zed", "spark"),
    ("4", "", ""), ("5", "Acme", "Spark and Kafka"), ("6", "a😀b", "p"), ("7", "ab" * 5000, "kafkaspark"),
]


def report(spark):
    flat = spark.createDataFrame(REPORT, "job_id string, company string, summary string")
    none = F.array().cast("array<string>")
    return flat.withColumns(
        {"job_link": F.lit("l"), "recommendation": F.lit(None).cast("string"), "strengths": none, "gaps": none}
    )


def test_searches_by_index_equal_the_scan(spark, tmp_path):
    path, flat = str(tmp_path / "index"), report(spark)
    search_index.write_index(flat, path)
    asked = ["", "a", "AC", "acme", "spark", "kafkas", "ark a", "öl", "😀", "a😀b", "nowhere", "ababababa", "e l "]
    names = ("job_id", "company", "summary")
    want = {}
    for query in asked:
        found = search_index.search_index(spark, path, query)
        assert found.columns == flat.columns
        got = sorted(map(str, found.select(*names).collect()))
        want[query] = R.search(flat, query).select(*names).collect()
        assert got == sorted(map(str, want[query])), query
    assert len(want["spark"]) == 4 and not want["nowhere"]
    table = spark.createDataFrame([(q,) for q in [*asked, "spark", None]], "query string")
    pairs = sorted(map(str, map(tuple, search_index.search_many(spark, path, table).collect())))
    assert pairs == sorted(str((q.lower(), r.job_id)) for q, rows in want.items() if q for r in rows)


def test_a_search_opens_the_folders_of_its_grams_only(spark, tmp_path):
    path = str(tmp_path / "index")
    search_index.write_index(report(spark), path)
    files = search_index.posting_lists(spark, path, ["spa"])
    text = files._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_place" in text and "EqualTo(gram,spa)" in text or "In(gram" in text
    assert {r.gram for r in files.collect()} == {"spa"}
    used = files.select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("_place=")[1].split("/")[0] for r in used}) == 1


def load_matrix(path):
    """A small model: letter counts times a matrix.  It leaves a mark for each time it is loaded."""
    import os
    import uuid

    import numpy as np

    stored = np.load(path)
    open(os.path.join(str(stored["marks"]), f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()

    def predict(texts):
        counts = np.array([[t.count(c) for c in "abcde"] for t in texts], dtype="float64")
        return counts @ stored["matrix"]

    return predict


def test_models_are_loaded_once_for_a_worker(spark, tmp_path):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    marks, file = tmp_path / "marks", tmp_path / "small model.npz"
    marks.mkdir()
    matrix = np.arange(15.0).reshape(5, 3)
    np.savez(file, matrix=matrix, marks=str(marks))
    texts = [None, "", *["abc" * n + "e" for n in range(200)]]
    table = docs(spark, texts).repartition(12)
    name = model_batches.add_model(spark, str(file))
    got = {r.id: r.embedding for r in model_batches.embed_with_model(table, name, load_matrix, 7).collect()}
    assert got[0] is None and got[1] is None and len(got) == len(texts)
    for i, text in enumerate(texts[2:], 2):
        assert got[i] == [float(x) for x in np.array([text.count(c) for c in "abcde"]) @ matrix]
    loads = [mark.name.split("-")[0] for mark in marks.iterdir()]
    assert len(loads) == len(set(loads))


def test_many_salts_give_the_same_scores(spark, monkeypatch):
    texts = [f"spark {'kafka ' * (n % 3)} word{n % 7} java" for n in range(400)]
    profile = spark.createDataFrame([("spark java word3",)], "text string")

    def scores():
        found = tfidf.tfidf_scores(docs(spark, texts), profile)
        return {r.id: round(r.score, 9) for r in found.collect()}

    few = scores()
    for parts in (63, 64, 130, 312):
        with monkeypatch.context() as m:
            m.setattr(tfidf, "_salt_count", lambda _, parts=parts: parts)
            assert scores() == few
    spark.conf.set("spark.sql.shuffle.partitions", "20000")
    try:
        assert tfidf._salt_count(docs(spark, texts)) == 312
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
