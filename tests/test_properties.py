"""Properties and brute-force comparisons, with keys that hold a third of all rows."""

import datetime as dt
import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.views import Views
from fitrank.config import FilterRules, Lookback, ScoreStep, Search
from fitrank.functions.fixed_values import ENGLISH_STOP_WORDS
from fitrank.operators import filters, lookback, ranking, scoring, tfidf

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 1, 31)
RELAXED = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def skewed_postings(spark, n=600, seed=7):
    """A third of the rows has one title and company, and a third of those has nulls."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        hot = rng.random() < 1 / 3
        title = "dev" if hot else f"t{rng.randrange(60)}"
        company = "acme" if hot else f"c{rng.randrange(5)}"
        if rng.random() < 1 / 9:
            title = company = None
        data.append((f"{i:05d}", title, company, NOW - dt.timedelta(hours=rng.randrange(400))))
    return data, spark.createDataFrame(
        data, "id string, title string, company string, date_posted timestamp"
    ).repartition(7)


def norm(text):
    return (text or "").lower().strip()


@pytest.mark.parametrize("minimum", [0, 1, 40, 120, 170, 10_000])
def test_lookback_equals_a_loop(spark, minimum):
    data, df = skewed_postings(spark)
    hours, kept = 24, {}
    while True:
        for row in sorted(data, key=lambda r: r[0]):
            if row[3] >= NOW - dt.timedelta(hours=hours):
                kept.setdefault((norm(row[1]), norm(row[2])), row[0])
        if minimum <= 0 or len(kept) >= minimum or hours + 24 > 168:
            break
        hours += 24
    # A later pass sees only rows that no earlier pass has fetched, so first come stays first.
    out = lookback.adaptive_lookback(df, F.lit(NOW), Lookback(minimum=minimum)).collect()
    assert sorted(r.id for r in out) == sorted(kept.values())
    assert {r.hours_old for r in out} == {hours}


def test_dedup_equals_brute_force(spark):
    data, df = skewed_postings(spark)
    firsts = {}
    for row in data:
        firsts.setdefault((norm(row[1]), norm(row[2])), row[0])
    out = ranking.dedup_reposts(df, ("id",)).collect()
    assert sorted(r.id for r in out) == sorted(firsts.values())


def test_copies_of_one_posting(spark):
    """A third of the pool are copies of one row, id included."""
    data, df = skewed_postings(spark)
    copies = df.where("id = '00007'").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n")
    pool = df.union(copies).withColumn("description", F.col("id"))
    out = ranking.dedup_reposts(ranking.unique_ids(pool), ("id",)).collect()
    want = ranking.dedup_reposts(df, ("id",)).collect()
    assert sorted(r.id for r in out) == sorted(r.id for r in want)
    assert all(r.description == r.id for r in out)


@pytest.mark.parametrize("n", [1, 5, 400])
def test_topn_equals_brute_force(spark, n):
    """One search holds most hits."""
    data, df = skewed_postings(spark)
    hits = df.withColumn("search_no", F.when(F.col("title") == "dev", 0).otherwise(F.crc32("id") % 3))
    hits = hits.withColumn("results_per_source", F.lit(n))
    by_search = {}
    for r in hits.collect():
        by_search.setdefault(r.search_no, []).append((-r.date_posted.timestamp(), r.id))
    want = sorted(i for rows in by_search.values() for _, i in sorted(rows)[:n])
    for limit in ({"n": n}, {"largest": n}, {}):
        for fan_in in (1, 2, 256):
            got = ranking.topn_per_search(hits.repartition(6), fan_in=fan_in, **limit).collect()
            assert sorted(r.id for r in got) == want


def test_equal_rows_but_for_their_texts_have_an_order(spark):
    """Rows that tie in everything but the text are cut and chosen alike however they are dealt."""
    rows = [(None, "t", "c", "same", f"text {k}", 0) for k in range(40)] + [("1", "t", "c", "same", None, 0)] * 3
    df = spark.createDataFrame(rows, "id string, title string, company string, date_posted string, description string, search_no int")
    got = set()
    for parts in (1, 3, 7):
        dealt = df.repartition(parts)
        top = ranking.topn_per_search(dealt, 5).collect()
        first = ranking.dedup_reposts(dealt, ("date_posted",)).collect()
        assert len(top) == 5 and len(first) == 1 and first[0].description.startswith("text ")
        got.add((tuple(sorted(r.description or "" for r in top)), first[0].description))
        assert ranking.unique_ids(dealt).count() == 41
    assert len(got) == 1
    clash = df.withColumn("_text_hash", F.lit(1)).withColumn("_key_0", F.lit(2)).withColumn("_first", F.lit(3))
    clash = clash.withColumn("_wide_0", F.lit(4))
    kept = ranking.dedup_reposts(clash, ("date_posted",))
    assert kept.columns == clash.columns and kept.first()[-4:] == (1, 2, 3, 4)


def tfidf_by_hand(texts, wanted):
    def terms(text):
        return [t for t in re.findall(r"\b\w\w+\b", (text or "").lower()) if t not in stop]

    stop = set(ENGLISH_STOP_WORDS)
    counts = [Counter(terms(t)) for t in [wanted, *texts]]
    df = Counter(t for c in counts for t in c)
    n = len(counts)
    vectors = [{t: k * (math.log((1 + n) / (1 + df[t])) + 1) for t, k in c.items()} for c in counts]
    lengths = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    return [
        sum(w * vectors[0].get(t, 0) for t, w in v.items()) / (length * lengths[0]) if length and lengths[0] else 0.0
        for v, length in zip(vectors[1:], lengths[1:], strict=True)
    ]


@pytest.mark.parametrize("wanted", ["python spark kafka w1 w2 w2", "", "the of", "unheard"])
def test_tfidf_equals_brute_force(spark, wanted):
    """One word is in every text, one text comes many times, some texts are empty."""
    rng = random.Random(3)
    copy = "python " + " ".join(f"w{rng.randrange(50)}" for _ in range(300))
    texts = [
        copy if i % 3 == 0 else "Python " + " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(80)))
        for i in range(200)
    ]
    texts[5], texts[11], texts[17] = None, "", "the a of"
    df = spark.createDataFrame(list(enumerate(texts)), "id int, description string").repartition(5)
    profile = spark.createDataFrame([(wanted,)], "text string")
    got = {r.id: r.score for r in tfidf.tfidf_scores(df, profile).collect()}
    want = tfidf_by_hand(texts, wanted)
    assert len(got) == len(texts)
    assert all(abs(got[i] - s) < 1e-9 for i, s in enumerate(want))
    assert all(-1e-9 <= s <= 1 + 1e-9 for s in got.values())


def test_keyword_scores_are_shares(spark):
    v = Views(spark, SF)
    out = scoring.keyword_match(v.postings, v.profile)
    low, high = out.agg(F.min("keyword_match_score"), F.max("keyword_match_score")).first()
    assert 0 <= low <= high <= 1


@RELAXED
@given(st.lists(st.floats(0.1, 10), min_size=2, max_size=2), st.floats(0.01, 100))
def test_composite_ignores_the_scale_of_weights(spark, weights, factor):
    df = spark.createDataFrame([(0.25, 0.9), (1.0, 0.0)], "a double, b double")

    def run(scale):
        steps = [ScoreStep(c, c, w * scale) for c, w in zip("ab", weights, strict=True)]
        return [r.final_score for r in scoring.composite_score(df, steps).collect()]

    assert run(1) == pytest.approx(run(factor))


def test_filters_commute(spark):
    v = Views(spark, SF)
    steps = [
        lambda d: filters.filter_seen(d, v.seen),
        lambda d: filters.filter_title_blocklist(d, ["Staff", "hot"]),
        lambda d: filters.filter_remote(d, True),
    ]
    rules = FilterRules(title_blocklist=("Staff", "hot"), is_remote=True)
    want = sorted(r.id for r in filters.filter_chain(v.postings, rules, v.seen).select("id").collect())
    for order in permutations(steps):
        df = v.postings
        for step in order:
            df = step(df)
        assert sorted(r.id for r in df.select("id").collect()) == want


def test_funnel_ends_like_the_chain(spark):
    v = Views(spark, SF)
    rules = FilterRules(title_blocklist=("Staff",), is_remote=True, disabled=frozenset({"seen"}))
    steps = filters.filter_funnel(v.postings, rules, v.seen).orderBy("step_no").collect()
    assert [s.filter_name for s in steps] == ["title_blocklist", "remote", "reposts"]
    kept = filters.filter_chain(v.postings, rules)
    assert steps[-1].rows_before == kept.count()
    assert steps[-1].rows_after == ranking.dedup_reposts(kept, ("id",)).count()
    none = filters.filter_funnel(v.postings.limit(0), rules, v.seen).collect()
    assert {(s.rows_before, s.rows_after) for s in none} == {(0, 0)}


def test_searches_without_restrictions_take_all(spark):
    data, df = skewed_postings(spark, 100)
    df = df.withColumns({"location": F.lit(None).cast("string"), "is_remote": F.lit(None).cast("boolean")})
    every = [Search(n, "", "", True, 10_000, 10, "") for n in range(3)]
    assert ranking.join_searches(df, every, F.lit(NOW)).count() == 300
