"""Near-duplicate classes and decontamination against brute force."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import regex
from checks.compare import difference, duckdb_tables
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from fitrank.llm import components, containment, weighted_minhash
from fitrank.llm.queries import ORACLES, op1_weighted_minhash, op3_containment, op7_link_trust
from fitrank.llm.shingles import Shingler, counted, word_table

from .helpers import DATA, documents, given, rows

NO_COMMON = (np.zeros(0, np.uint64), np.zeros(0))


def plain_shingles(text):
    words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
    if 0 < len(words) < 5:
        return Counter([tuple(words)])
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def roots_of(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def brute_classes(texts):
    """Class of each text by the similarity of all pairs; ids are places."""
    sets = [plain_shingles(t) for t in texts]
    holders = defaultdict(set)
    for i, own in enumerate(sets):
        for s in own:
            holders[s].add(i)
    share = {s: len(h) / len(texts) for s, h in holders.items()}
    rare = {s: float(weighted_minhash.idf(np.array([p]))[0]) for s, p in share.items()}
    weights = [{s: (1 + np.log(n)) * rare[s] for s, n in own.items()} for own in sets]
    edges = []
    for i, a in enumerate(weights):
        for j in {j for s in a for j in holders[s] if j > i}:
            b = weights[j]
            both = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
            if both / (sum(a.values()) + sum(b.values()) - both) >= weighted_minhash.THRESHOLD - 1e-9:
                edges.append((i, j))
    first = {}
    for i, text in enumerate(texts):
        if text is not None and first.setdefault(text, i) != i:
            edges.append((first[text], i))
    return roots_of(len(texts), edges)


@settings(max_examples=60, deadline=None)
@cases(st.lists(st.text(alphabet="abÉß9 .\n-日", max_size=40), max_size=6))
def test_shingles_of_many_texts_are_those_of_each(texts):
    shingler = Shingler(word_table())
    owners, hashes, repeats = counted(*shingler(texts))
    for i, text in enumerate(texts):
        want = plain_shingles(text)
        own = owners == i
        assert sorted(want.values()) == sorted(repeats[own].tolist())
        assert set(hashes[own].tolist()) == set(counted(*shingler([text]))[1].tolist())


def test_samples_agree_as_often_as_the_weighted_similarity():
    draw = np.random.default_rng(4)
    hashes = np.sort(draw.integers(0, 2**64, 120, dtype=np.uint64))
    first, second = draw.uniform(0.3, 4, 120), draw.uniform(0.3, 4, 120)
    second[:40] = first[:40]
    want = np.minimum(first, second).sum() / np.maximum(first, second).sum()
    one = weighted_minhash.samples(hashes, np.log(first), np.array([0]), 4000)
    two = weighted_minhash.samples(hashes, np.log(second), np.array([0]), 4000)
    assert abs((one == two).mean() - want) < 0.03


def test_classes_of_all_documents(spark):
    table = given(spark, "documents").orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in table]
    want = brute_classes([r["text"] for r in table])
    got = {r["doc_id"]: (r["class_id"], r["class_size"]) for r in op1_weighted_minhash(spark, DATA).collect()}
    sizes = Counter(want)
    assert got == {i: (ids[w], sizes[w]) for i, w in zip(ids, want, strict=True)}
    assert max(sizes.values()) > 1


def families(seed, groups=12, size=9):
    """Texts around shared passages, at similarities on both sides of the threshold."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(groups):
        passage = [word() for _ in range(60)]
        for n in range(size):
            own = [word() for _ in range(draw.choice([1, 4, 8, 14, 30]))]
            texts.append(" ".join(passage + own if n % 2 else own + passage))
    return texts


@pytest.mark.parametrize("partners", [0, 8, 1000])
def test_mixed_buckets_lose_no_link(spark, monkeypatch, partners):
    monkeypatch.setattr(weighted_minhash, "PARTNERS", partners)
    texts = families(2)
    want = brute_classes(texts)
    got = dict(rows(weighted_minhash.classes(documents(spark, texts)).select("doc_id", "class_id")))
    assert [got[i] for i in range(len(texts))] == want


LONG = " ".join(f"w{i}" for i in range(80))


def few_across(spark, size, schema="bucket bigint, key long, root long"):
    """Buckets with one large component and a few outsiders, and buckets of small components."""
    large = [(0, k, 0) for k in range(size)] + [(0, size + 1, size + 1), (0, size + 2, size + 1)]
    small = [(b, 10 * b + k, 10 * b + k // 2) for b in range(1, 20) for k in range(b % 7)]
    return large + small, spark.createDataFrame(large + small, schema)


def test_pairs_across_components(spark):
    data, rooted = few_across(spark, 300)
    got = sorted(map(tuple, weighted_minhash.crossing(rooted).collect()))
    want = {(a, b) for x, a, r in data for y, b, s in data if x == y and r != s and a < b}
    assert got == sorted(want)


def test_prefix_pairs_across_components(spark):
    """Which pairs are enough is decided by members, not by their components."""
    numbers = random.Random(3)
    data = []
    for bucket, key, root in few_across(spark, 60)[0]:
        total = numbers.choice([1.0, 1.05, 1.1, 2.0])
        data.append((bucket, key, root, total * numbers.uniform(0.8, 1), total))
    schema = "bucket bigint, key long, root long, rest double, total double"
    got = sorted(map(tuple, weighted_minhash.crossing(spark.createDataFrame(data, schema)).collect()))
    enough = (weighted_minhash.THRESHOLD - 1e-6) / (1 + weighted_minhash.THRESHOLD)
    want = {
        (min(a, b), max(a, b))
        for x, a, r, ra, ta in data
        for y, b, s, rb, tb in data
        if x == y and r < s and min(ra, rb) >= enough * (ta + tb)
    }
    assert want and got == sorted(want)


def test_a_large_component_is_not_paired_with_itself(spark):
    """200,000 members and two outsiders make 400,000 pairs; within the component it would be 20 billion."""
    size = 200_000
    large = spark.range(size).selectExpr("0L bucket", "id key", "0L root")
    others = spark.range(size + 1, size + 3).selectExpr("0L bucket", "id key", "id root")
    assert weighted_minhash.crossing(large.unionAll(others)).count() == 2 * size + 1


def test_classes_of_odd_rows(spark):
    texts = [None, None, "", "", "one two", "One, two!", LONG, LONG, LONG + " more", "x " * 50_000, "...", LONG]
    ids = [0, 1, 2, 3, 4, 5, 6, 6, 8, 9, 10, None]
    docs = documents(spark, texts, ids)
    got = sorted(rows(weighted_minhash.classes(docs)), key=str)
    want = [(0, 0, 1), (1, 1, 1), (2, 2, 2), (3, 2, 2), (4, 4, 2), (5, 4, 2), (6, 6, 4), (6, 6, 4), (8, 6, 4)]
    want += [(9, 9, 1), (10, 10, 1), (None, 6, 4)]
    assert got == sorted(want, key=str)
    kept = weighted_minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 4, 6, 9, 10]
    assert rows(weighted_minhash.classes(docs.limit(0))) == []
    assert rows(weighted_minhash.keep_one(docs.limit(0))) == []


def test_common_shingles_are_counted_exactly(spark):
    texts = [LONG + f" end{i}" for i in range(30)] + [f"own text number {i} here" for i in range(970)]
    known, weight = weighted_minhash.common_shingles(
        weighted_minhash.keyed(documents(spark, texts)), len(texts)
    )
    assert len(known) == 76 and np.allclose(weight, weighted_minhash.idf(np.array([0.03])))


@settings(max_examples=8, deadline=None)
@cases(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
def test_components_of_random_edges(spark, edges):
    edges = [(a, b) for a, b in edges if a != b]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a int, b int"))))
    want = roots_of(16, edges)
    assert got == {x: want[x] for x in {x for e in edges for x in e}}


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r for _, r in rows(components.components(edges))} == {0}


@pytest.mark.parametrize("query", [op3_containment, op7_link_trust])
def test_queries_equal_their_sql(spark, query):
    sql = ORACLES[query.__name__]
    assert difference(query(spark, DATA), duckdb_tables(DATA), sql) == ""


def item_table(spark, texts):
    data = [(i, t, "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "item_id bigint, text string, doc_id string")


def test_containment_equals_brute_force(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(4))
    items = [[word() for _ in range(draw.randint(5, 40))] for _ in range(25)] + [["tiny", "one"]]
    texts = []
    for n in range(120):
        own = list(items[n % len(items)])
        for _ in range(draw.choice([0, 0, 1, 2])):
            own[draw.randrange(len(own))] = word()
        texts.append(" ".join([word() for _ in range(draw.randint(0, 300))] + own + [word()]))
    texts += ["Tiny, one.", "tiny one two", ""]
    found = containment.search(documents(spark, texts), item_table(spark, [" ".join(i) for i in items]))
    sets = [set(plain_shingles(t)) for t in texts]
    tiny = len(items) - 1
    assert items[tiny] == ["tiny", "one"]
    want = {(i, tiny, 1) for i, t in enumerate(texts) if regex.search(r"(?i)\btiny,? one\b", t)}
    assert {(len(texts) - 3, tiny, 1), (len(texts) - 2, tiny, 1)} < want
    for j, item in enumerate(items[:tiny]):
        own = set(plain_shingles(" ".join(item)))
        want |= {(i, j, len(own & s)) for i, s in enumerate(sets) if len(own & s) >= 0.8 * len(own)}
    got = rows(found.select("doc_id", "item_id", "n_shared"))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 25


def test_containment_of_odd_rows(spark):
    item = "one two three four five six seven"
    texts = [None, "", "...", f"Before {item.upper()}! after", item, item, "x " * 30_000 + item, "clean text"]
    docs = documents(spark, texts, [0, 1, 2, 3, None, 5, 6, 7])
    items = item_table(spark, [item, item, None, "", "!!"])
    found = rows(containment.search(docs, items).select("doc_id", "item_id"))
    assert sorted(found, key=str) == sorted([(d, i) for d in (3, None, 5, 6) for i in (0, 1)], key=str)
    kept = containment.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 7]
    assert rows(containment.search(docs.limit(0), items)) == []
    assert containment.drop_contaminated(docs, items.limit(0)).count() == len(texts)


def test_containment_plan_is_native(spark):
    docs, items = given(spark, "documents"), given(spark, "benchmark")
    shingles = containment.item_shingles(items)
    lengths = containment.of_document([1, 3], 2)
    plan = containment.candidates(docs.select("text"), shingles, lengths)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not any(word in text for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))


SHORT_ITEMS = ["forty two", "Paris", "to be or", "one two three four", "one two three four five", "...", None]
SHORT_TEXTS = [
    "The answer is forty-two indeed, said the book of many words",
    "forty  two",
    "forty, and then two",
    "twoforty two",
    "Paris!",
    "Paris is a town",
    "whether to be or not to be or what",
    "zero one two three four six",
    "zero one two three four five six",
    "two three four",
    "",
    None,
]


def plain_finds(least):
    found = set()
    for i, text in enumerate(SHORT_TEXTS):
        have = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
        for j, item in enumerate(SHORT_ITEMS):
            want = regex.findall(r"[\p{L}\p{N}]+", (item or "").lower())
            n = len(want)
            inside = any(have[k : k + n] == want for k in range(len(have) - n + 1))
            if want and inside and (n >= least or len(have) == n):
                found.add((i, j))
    return found


@pytest.mark.parametrize("least", [1, 2, 4, 5, 9])
def test_short_items_inside_long_texts(spark, least):
    found = containment.search(documents(spark, SHORT_TEXTS), item_table(spark, SHORT_ITEMS), least)
    got = rows(found.select("doc_id", "item_id"))
    assert len(got) == len(set(got)) and set(got) == plain_finds(min(least, 5))
    assert (0, 0) in plain_finds(2) and (5, 1) in plain_finds(1) - plain_finds(2)


def test_the_sql_finds_the_same_short_items(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(SHORT_TEXTS)))
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(SHORT_ITEMS)))
    got = {tuple(row) for row in con.execute(ORACLES["op3_containment"]).fetchall()}
    assert got == {(i, j, 1, 1, 1.0) for i, j in plain_finds(2)}
