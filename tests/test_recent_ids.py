"""Ids in the state store: horizon, late rows, restarts, and a state that does not grow."""

import datetime as dt

from pyspark.sql import functions as F

from fitrank.streaming import postings as S
from fitrank.streaming import recent_ids as R

NOW = dt.datetime(2024, 1, 31)
SCHEMA = "id string, title string, n bigint, tags array<string>, date_posted timestamp"


def add(spark, folder, *items):
    """Append a file: items are (id, title, hours before now or None)."""
    data = [
        (i, t, None if i == "1" else 5, [t], None if h is None else NOW - dt.timedelta(hours=h))
        for i, t, h in items
    ]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


class Job:
    def __init__(self, spark, tmp_path, hours=24):
        self.spark, self.hours = spark, hours
        self.src, self.out, self.state = (str(tmp_path / n) for n in ("in", "out", "state"))
        self.schema = spark.createDataFrame([], SCHEMA).schema

    def run(self, *items):
        """One more file and one more start of the stream, from its checkpoint."""
        add(self.spark, self.src, *items)
        stream = S.read_posting_stream(self.spark, self.src, schema=self.schema)
        query = R.recent_stream(stream, self.out, self.state, self.hours)
        query.awaitTermination()
        return query

    def rows(self, output):
        found = R.read_output(self.spark, self.out, self.schema, output)
        assert found.schema == self.schema
        return sorted(found.select("id", "title").collect(), key=lambda r: (r.id or "", r.title))


def test_new_late_and_forgotten(spark, tmp_path):
    job = Job(spark, tmp_path)
    job.run(("1", "later", 99), ("1", "first", 100), ("2", "b", 101))
    assert job.rows("new") == [("1", "first"), ("2", "b")] and job.rows("late") == []
    job.run(("1", "again", 99), ("3", "c", 10))
    job.run(("1", "back", 5), ("4", "late", 200), ("4", "late", 200), ("3", "again", 9), ("4", "d", 30))
    assert job.rows("new") == [("1", "back"), ("1", "first"), ("2", "b"), ("3", "c"), ("4", "d")]
    assert job.rows("late") == [("4", "late"), ("4", "late")]
    kept = R.read_output(spark, job.out, job.schema).where("title = 'back'").first()
    assert kept.n is None and kept.tags == ["back"] and kept.date_posted == NOW - dt.timedelta(hours=5)


def test_without_id_or_time(spark, tmp_path):
    job = Job(spark, tmp_path)
    job.run((None, "a", 5), (None, "a", 5), ("7", "no time", None), ("8", "x", 5))
    job.run((None, "b", 90), ("7", "again", None), ("7", "dated", 4))
    assert job.rows("new") == [(None, "a"), (None, "a"), ("7", "no time"), ("8", "x")]
    assert job.rows("late") == [(None, "b")]


def test_state_does_not_grow(spark, tmp_path):
    job = Job(spark, tmp_path)
    held = []
    for day in range(6):
        hours = 24 * (20 - 2 * day)
        query = job.run(*[(f"{day}-{i}", "t", hours + i % 3) for i in range(50)])
        held.append(query.recentProgress[-1].stateOperators[0].numRowsTotal)
    assert max(held[1:]) <= held[0] * 2
    assert len(job.rows("new")) == 300 and job.rows("late") == []


def plain_model(turns, horizon):
    """The same rule over lists: (new, late) as (id, title, hours before now)."""
    held, latest, new, late = {}, None, [], []
    for items in turns:
        since = None if latest is None else latest + horizon  # greatest age that is not late
        fresh = {}
        for item in items:
            if since is not None and item[2] > since:
                late.append(item)
            elif item[0] not in held or held[item[0]] > since:
                fresh[item[0]] = max(fresh.get(item[0], item), item, key=lambda x: x[2])
        held.update({i: item[2] for i, item in fresh.items()})
        new += fresh.values()
        latest = min([h for _, _, h in items] + ([] if latest is None else [latest]))
    return sorted(new), sorted(late)


def test_equals_a_plain_model(spark, tmp_path):
    job = Job(spark, tmp_path)
    turns = [
        [(str(k % 13), f"t{turn}-{k}", (k * 7 + turn * 5) % 60 - 20 * turn) for k in range(40)]
        for turn in range(3)
    ]
    for items in turns:
        job.run(*items)

    def plain(output):
        found = R.read_output(spark, job.out, job.schema, output)
        age = (F.lit(NOW).cast("long") - F.unix_seconds("date_posted")) / 3600
        return sorted(map(tuple, found.select("id", "title", age.cast("int")).collect()))

    new, late = plain_model(turns, 24)
    assert len(late) > 5 and plain("new") == new and plain("late") == late
