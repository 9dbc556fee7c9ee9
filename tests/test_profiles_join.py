"""The best postings of many profiles, against scores of all pairs in Python."""

import math
import random
from collections import Counter

import pytest

from fitrank.operators import profiles_join

STOP = ("the", "and")


def terms(text):
    return Counter(w for w in (text or "").lower().split() if len(w) > 1 and w not in STOP)


def brute(postings, profiles, k):
    n = len(postings)
    counted = {i: terms(t) for i, t in postings if i is not None}
    df = Counter(w for _, t in postings for w in terms(t))

    def unit(counts):
        raw = {w: c * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in counts.items()}
        length = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / length for w, x in raw.items()}

    vectors = {i: unit(c) for i, c in counted.items()}
    out = []
    for p, text in profiles:
        wanted = unit(terms(text))
        scores = {i: sum(wanted[w] * x for w, x in v.items() if w in wanted) for i, v in vectors.items()}
        best = sorted((-round(s, 9), i) for i, s in scores.items() if s > 0)[:k]
        out += [(p, rank, i, round(-s, 6)) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def top(spark, postings, profiles, k):
    docs = spark.createDataFrame(postings, "id string, description string")
    asked = spark.createDataFrame(profiles, "profile_id int, text string")
    found = profiles_join.top_postings(docs, asked, k, stop_words=STOP)
    return sorted((r.profile_id, r.rank, r.id, round(r.score, 6)) for r in found.collect())


def corpus(seed, count, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    odds = [1 / (i + 1) for i in range(words)]  # few frequent words, many rare ones
    return [" ".join(rng.choices(vocabulary, odds, k=rng.randint(1, 30))) for _ in range(count)]


@pytest.mark.parametrize("seed_rows", [profiles_join.SEED, 2, 0])
def test_best_postings_are_those_of_all_pairs(spark, monkeypatch, seed_rows):
    monkeypatch.setattr(profiles_join, "SEED", seed_rows)
    postings = [(str(i), t) for i, t in enumerate(corpus(1, 150))]
    postings += [("a", None), ("b", ""), ("c", "the and"), (None, "w1 w2 w50"), ("d", postings[3][1])]
    profiles = list(enumerate([*corpus(2, 25), "", None, "unknown words", "w0", "the"]))
    assert top(spark, postings, profiles, 5) == brute(postings, profiles, 5)


def test_fewer_postings_than_wanted_and_empty_tables(spark):
    postings = [("1", "red fox"), ("2", "red hen"), ("3", "blue hen")]
    profiles = [(1, "red hen"), (2, "green")]
    assert top(spark, postings, profiles, 20) == brute(postings, profiles, 20)
    assert top(spark, [], profiles, 3) == []
    assert top(spark, postings, [], 3) == []


def test_thresholds_leave_most_pairs_unmet(spark, monkeypatch):
    # One frequent word is in all postings; each profile has a rare word of its own.
    postings = [(str(i), f"common common rare{i % 50} other{i}") for i in range(500)]
    profiles = [(i, f"common rare{i}") for i in range(10)]
    written = {}
    scratch = profiles_join.new_scratch
    monkeypatch.setattr(profiles_join, "new_scratch", lambda spark, label: written.setdefault(label, scratch(spark, label)))
    assert top(spark, postings, profiles, 5) == brute(postings, profiles, 5)
    assert spark.read.parquet(written["pairs"]).count() == 100  # of 5,000 pairs that share a word


def test_vectors_hold_the_terms_of_profiles_only_and_pairs_meet_few_of_them(spark, monkeypatch):
    # A posting has 40 words that no profile has; the texts are split into words once.
    postings = [(str(i), f"common rare{i % 5} " + " ".join(f"own{i}x{j}" for j in range(40))) for i in range(60)]
    profiles = [(i, f"common rare{i} unknown") for i in range(5)]
    written, split = {}, []
    scratch, frequencies = profiles_join.new_scratch, profiles_join.term_frequencies
    monkeypatch.setattr(profiles_join, "new_scratch", lambda spark, label: written.setdefault(label, scratch(spark, label)))
    monkeypatch.setattr(profiles_join, "term_frequencies", lambda *a: split.append(a[1]) or frequencies(*a))
    assert top(spark, postings, profiles, 5) == brute(postings, profiles, 5)
    assert spark.read.parquet(written["vectors"]).count() == 120  # of 2,520 terms of postings
    assert spark.read.parquet(written["frequencies"]).count() == 2406
    assert split == ["description", "text"]
