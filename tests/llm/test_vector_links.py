"""Sign-hashed near-duplicates and norm-pruned hard negatives, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitrank.llm import norm_pruned, sign_links

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("label", T.IntegerType()),
        # Extra columns whose names occur inside the operators.
        *(T.StructField(name, T.StringType()) for name in ("ball", "bucket", "words", "root", "vector", "length", "score")),
    ]
)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, *"abcdefg") for i, v, label in rows], VECTORS)


def planted(seed, groups, size, lone, noise, dims=24):
    """Groups of near copies of one vector, and vectors of their own."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=dims) + noise * rng.normal(size=(size, dims)) for _ in range(groups)]
    return np.vstack([*parts, rng.normal(size=(lone, dims))])


def linked(ids, matrix, threshold):
    """Brute force: number of links and smallest reachable id of each."""
    unit = matrix / np.linalg.norm(matrix, axis=1)[:, None]
    close = unit @ unit.T >= threshold
    np.fill_diagonal(close, False)
    out = {}
    for start in range(len(ids)):
        seen, todo = {start}, [start]
        while todo:
            for other in np.flatnonzero(close[todo.pop()]).tolist():
                if other not in seen:
                    seen.add(other)
                    todo.append(other)
        out[ids[start]] = (int(close[start].sum()), min(ids[k] for k in seen))
    return out


def answers(frame):
    return {r.vec_id: (r.n_links, r.component_id) for r in frame.collect()}


@pytest.mark.parametrize("noise,block", [(0.05, 16), (0.16, 16), (0.16, 512)])
def test_links_of_near_copies_are_those_of_brute_force(spark, noise, block):
    # With the larger noise groups are wider than a ball and partly fall apart.
    matrix = planted(7, 3, 60, 150, noise)
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(matrix)) * 3 - 100]
    frame = vectors(spark, zip(ids, matrix.tolist(), [1] * len(ids), strict=True))
    found = answers(sign_links.near_duplicates(frame, recall=0.999999, block=block))
    wanted = linked(ids, matrix, 0.95)
    assert found == wanted
    assert any(n for n, _ in wanted.values())


def test_large_groups_of_equal_vectors_need_no_pairs(spark):
    rng = np.random.default_rng(3)
    matrix = np.vstack([np.tile(rng.normal(size=16), (900, 1)), rng.normal(size=(300, 16))])
    frame = vectors(spark, ((i, v, 1) for i, v in enumerate(matrix.tolist())))
    found = answers(sign_links.near_duplicates(frame, block=64))
    assert all(found[i] == (899, 0) for i in range(900))
    assert {i: found[i] for i in range(900, 1200)} == {
        i: answer for i, answer in linked(list(range(1200)), matrix, 0.95).items() if i >= 900
    }


def test_unusable_vectors_link_with_nothing(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (5, one, 1), (3, [2.0, 4.0, 6.0], 1), (3, [2.0, 4.0, 6.0], 1), (9, None, 1), (8, [0.0, 0.0, 0.0], 1),
        (7, [1.0, None, 3.0], 1), (6, [1.0, math.nan, 3.0], 1), (4, [math.inf, 2.0, 3.0], 1), (2, [], 1),
        (None, one, 1), (None, one, 1), (1, [1.0, 2.0, 3.0, 0.0], 1), (0, [1e200, 2e200, 3e200], 1),
    ]
    found = sign_links.near_duplicates(vectors(spark, rows))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found.collect()), key=str)
    alone = [(i, 0, i, True) for i in (1, 2, 4, 6, 7, 8, 9)]
    group = [(0, 2, 0, True), (3, 2, 0, False), (5, 2, 0, False)]
    assert got == sorted([*alone, *group, *[(None, 0, None, True)] * 2], key=str)


def test_links_of_an_empty_table(spark):
    assert sign_links.near_duplicates(vectors(spark, [])).collect() == []


def test_links_below_the_threshold_are_not_made(spark):
    # Unit vectors at given angles in a plane.
    angles = [0, 10, 25, 44, 62.1, 80.3, 120]
    rows = [(i, [math.cos(math.radians(a)), math.sin(math.radians(a))], 1) for i, a in enumerate(angles)]
    found = answers(sign_links.near_duplicates(vectors(spark, rows), recall=1 - 1e-9))
    assert found == linked(list(range(7)), np.array([v for _, v, _ in rows]), 0.95)


def negatives(rows, is_anchor, low=30, high=90, n_pos=5, n_neg=10):
    """Brute force in Python integers."""
    use = {i: (v, label) for i, v, label in rows}
    out = []
    for a, (v, label) in use.items():
        if not is_anchor(a):
            continue
        scores = [
            (-sum(x * y for x, y in zip(v, w)), i, other)
            for i, (w, other) in use.items()
            if i != a and len(w) == len(v)
        ]
        scores.sort()
        for p, positive, _ in [s for s in scores if s[2] == label][:n_pos]:
            fit = [s for s in scores if s[2] != label and low * -p <= 100 * -s[0] <= high * -p]
            out += [(a, positive, k + 1, i, -p, -n) for k, (n, i, _) in enumerate(fit[:n_neg])]
    return sorted(out)


def mined(spark, rows, every=10, **options):
    frame = spark.createDataFrame(rows, "vec_id long, vector array<bigint>, label int")
    return sorted(map(tuple, norm_pruned.mine(frame, F.col("vec_id") % every == 0, **options).collect()))


@pytest.mark.parametrize(
    "kind,first", [("dense", 40), ("sparse", 8192), ("ties", 40), ("few labels", 100), ("negative", 8192)]
)
def test_negatives_are_those_of_brute_force(spark, monkeypatch, kind, first):
    monkeypatch.setattr(norm_pruned, "FIRST", first)
    monkeypatch.setattr(norm_pruned, "STEP", 3)
    monkeypatch.setattr(norm_pruned, "SMALLEST", 64)
    rng = np.random.default_rng(len(kind))
    size, dims = 260, 20
    matrix = rng.integers(-60, 60, (size, dims))
    labels = rng.integers(0, 4, size)
    if kind == "sparse":
        matrix *= rng.random((size, dims)) < 0.1
    elif kind == "ties":
        matrix = rng.integers(0, 2, (size, dims))
    elif kind == "few labels":
        labels = np.where(rng.random(size) < 0.02, 1, 0)
    elif kind == "negative":
        matrix[:, 0] = np.where(labels == 0, 900, -900)
        labels = np.arange(size) % 130
    rows = [(int(i) - 20, v, int(n)) for i, v, n in zip(range(size), matrix.tolist(), labels, strict=True)]
    assert mined(spark, rows) == negatives(rows, lambda i: i % 10 == 0)


def test_negatives_of_large_numbers_and_other_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-(1 << 27), 1 << 27, 3 + i % 2)).tolist(), i % 3) for i in range(80)]
    found = mined(spark, rows)
    assert found == negatives(rows, lambda i: i % 10 == 0)
    assert max(x[4] for x in found) > 1 << 53


def test_rows_without_label_or_vector_take_no_part(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist(), i % 2) for i in range(60)]
    odd = [
        (100, None, 1), (110, [math.nan] * 8, 1), (120, [math.inf] * 8, 0), (130, [None] * 8, 0), (140, [], 1),
        (150, [9.0] * 8, None), (None, [9.0] * 8, 1), (0, rows[0][1], 0),
    ]
    frame = vectors(spark, [*rows, *odd])
    whole = norm_pruned.whole_numbers(frame, F.col("label"), 256)
    found = sorted(map(tuple, norm_pruned.mine(whole, F.col("vec_id") % 10 == 0).collect()))
    numbers = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    assert found == negatives(numbers, lambda i: i % 10 == 0)


def test_negatives_of_an_empty_table_and_of_zero_vectors(spark):
    assert mined(spark, []) == []
    rows = [(i, [0, 0], i % 2) for i in range(8)]
    assert mined(spark, rows, every=4) == negatives(rows, lambda i: i % 4 == 0)
