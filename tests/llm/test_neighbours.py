"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitrank.llm import hnsw
from fitrank.llm.queries import op8_hnsw

from .helpers import rows


def brute(ids, vectors, query, k):
    scores = (vectors * vectors[ids == query][0]).sum(axis=1)
    order = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != query)[:k]
    return [i for _, i in order], [-s for s, _ in order]


def recall(found, ids, vectors, k):
    by_query = {}
    for query, rank, vec_id, score in sorted(found):
        by_query.setdefault(query, []).append((rank, vec_id, score))
    parts = []
    for query, got in by_query.items():
        want, scores = brute(ids, vectors, query, k)
        assert [r for r, _, _ in got] == list(range(1, len(want) + 1))
        assert all(x[2] >= y[2] for x, y in zip(got, got[1:]))
        parts.append(len({i for _, i, _ in got} & set(want)) / len(want))
    return np.mean(parts), len(by_query)


def test_recall_over_the_whole_table(spark):
    path = "/root/testdata/sf0.01"
    table = spark.read.parquet(f"{path}/embeddings.parquet").toPandas()
    ids, vectors = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), float)
    part, queries = recall(rows(op8_hnsw(spark, path)), ids, vectors, 20)
    assert part >= 0.95 and queries == (ids % 20 == 0).sum()


@pytest.mark.parametrize("rows_in_shard", [40, 1000])
def test_shards_and_blocks_of_vectors_of_any_length(spark, monkeypatch, rows_in_shard):
    monkeypatch.setattr(hnsw, "SMALLEST", rows_in_shard)
    monkeypatch.setattr(hnsw, "LARGEST", rows_in_shard)
    monkeypatch.setattr(hnsw, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 6)) * rng.uniform(0.1, 5, size=(300, 1))
    data = [(i, v.tolist(), "s") for i, v in enumerate(vectors)]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, score string")
    part, queries = recall(
        rows(hnsw.search(table, F.col("vec_id") % 10 == 0, 7)), np.arange(300), vectors, 7
    )
    assert part >= 0.95 and queries == 30


def test_copies_ties_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.9, 0.1]), (100, [0.9, 0.1])]
    data += [(101, None), (102, []), (103, [0.0, 0.0]), (104, [nan, 1.0]), (105, [1.0, inf])]
    data += [(106, [1.0, None]), (None, [1.0, 0.0]), (107, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = sorted(rows(hnsw.search(table, F.col("vec_id") % 20 == 0, 3)))
    assert [r[:3] for r in got] == [
        (0, 1, 1), (0, 2, 2), (0, 3, 3),
        (20, 1, 0), (20, 2, 1), (20, 3, 2),
        (100, 1, 0), (100, 2, 1), (100, 3, 2),
    ]
    assert got[0][3] == 1.0 and got[6][3] == 0.9
    few = table.filter("vec_id in (100, 0, 20)")
    assert len(rows(hnsw.search(few, F.col("vec_id") == 0, 5))) == 2
    assert rows(hnsw.search(table.limit(0), F.lit(True), 5)) == []
