"""Collocations by the de Bruijn graph, against brute force over plain counts."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fitrank.llm import phrase_graph
from tests.llm.helpers import documents

SMALL = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def brute(texts, langs, least, top):
    out = []
    for lang in sorted({lang or "und" for lang in langs}):
        n, f = 0, Counter()
        for text, own in zip(texts, langs, strict=True):
            if (own or "und") != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(SMALL)):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                for i in range(len(words)):
                    for size in range(1, min(5, len(words) - i) + 1):
                        f[tuple(words[i : i + size])] += 1
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    if a >= candidates[p[i : i + size]]:
                        dropped.add(p[i : i + size])
        rows = []
        for p, a in candidates.items():
            if p not in dropped:
                cuts = [(1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        rows.sort()
        for rank, (score, a, phrase, left, right) in enumerate(rows[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return out


def mined(spark, texts, langs, least, top=2000, **options):
    docs = documents(spark, texts, langs=langs).repartition(5)
    return sorted(map(tuple, phrase_graph.mine(docs, least, top, **options).collect()))


def prose(seed, count, words=12, length=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeöЖ語", k=rng.randint(1, 4))) for _ in range(words)]
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!"]
    passage = " ".join(rng.choices(vocabulary, k=15))
    texts = []
    for _ in range(count):
        parts = [rng.choice(vocabulary).title() + rng.choice(marks) for _ in range(rng.randint(0, length))]
        parts.insert(len(parts) // 2, f". {passage} . " if rng.random() < 0.5 else "")
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("seed,least,top,limit,held", [(1, 6, 2000, 4 << 20, 2_000_000), (2, 3, 7, 200, 50)])
def test_phrases_are_those_of_brute_force(spark, seed, least, top, limit, held):
    texts = [*prose(seed, 80), *prose(seed + 9, 60, words=40)]
    langs = [random.Random(i).choice(["de", "en", None, "und"]) for i in range(len(texts))]
    found = mined(spark, texts, langs, least, top, limit=limit, held=held)
    assert found == sorted(brute(texts, langs, least, top))


def test_no_cut_is_made_by_chance_places_only(spark, monkeypatch):
    # With very few places all pairs look frequent, and counts stay the same.
    texts = prose(4, 60)
    langs = ["en"] * len(texts)
    wanted = sorted(brute(texts, langs, 5, 50))
    monkeypatch.setattr(phrase_graph, "PLACES", 6)
    assert mined(spark, texts, langs, 5, 50) == wanted


def test_repeated_words_and_passages(spark):
    texts = ["the the the the the the the", "a b a b a b a b a b", "x y z w v u t s r q"] * 4 + ["x y z", None, "", " \t\n.,"]
    langs = ["en"] * len(texts)
    assert mined(spark, texts, langs, 3) == sorted(brute(texts, langs, 3, 2000))


def test_paths_are_compacted(spark):
    line = " ".join(f"w{i}" for i in range(40))
    docs = documents(spark, [line] * 3 + [f"{line} end"] * 2)
    grams, _ = phrase_graph.edges(docs, 2)
    paths = phrase_graph.compacted(phrase_graph.flows(grams, 2)).collect()
    assert sorted((r.path, r["count"]) for r in paths) == sorted([(line, 5), ("w36 w37 w38 w39 end", 2)])


def test_long_pieces_are_counted_whole(spark):
    texts = ["ab cd " * 200_000, "z" * 2_000_000, " " * 2_000_000, "," * 500_000]
    (row,) = [r for r in mined(spark, texts, ["en"] * 4, 100_000) if r[2] == "ab cd ab cd ab"]
    assert row[3] == 199_998
    assert row[6] == 400_001


def test_scores_beyond_64_bits_are_exact(spark):
    counts = spark.createDataFrame(
        [("en", "a", 1, 10**12 + 7), ("en", "b", 1, 10**12 + 9), ("en", "a b", 2, 10**12 - 11)],
        "lang string, phrase string, size int, count bigint",
    )
    totals = spark.createDataFrame([("en", 10**15 + 1)], "lang string, n bigint")
    (row,) = phrase_graph.scored(counts, totals).collect()
    assert row.score == 1000 * (10**12 - 11) * (10**15 + 1) // ((10**12 + 7) * (10**12 + 9))


def test_an_empty_table(spark):
    assert mined(spark, [], [], 2) == []


def test_rows_of_the_gram_step_follow_the_input(spark, monkeypatch):
    # Nearly all random pairs are rare in 40 texts and frequent in 200 of them.
    def rows_made(count, parts):
        rng = random.Random(5)
        pairs = [["of the"] * 100 + [f"a{rng.randrange(30)} b{rng.randrange(30)}" for _ in range(50)] for _ in range(count)]
        docs = documents(spark, [". ".join(x) for x in pairs]).repartition(parts)
        made, plain = [], type(docs).mapInArrow

        def noted(*args, **options):
            made.append(plain(*args, **options))
            return made[-1]

        with monkeypatch.context() as patch:
            patch.setattr(type(docs), "mapInArrow", noted)
            grams, _ = phrase_graph.edges(docs, 8)
        pairs_counted = {r.gram: r["count"] for r in grams.filter("size = 2").collect()}
        assert pairs_counted["of the"] == 100 * count
        return made[-1].count(), sum(pairs_counted.values())

    small, large = rows_made(40, 1), rows_made(200, 5)
    assert small[0] == small[1] and large[0] == large[1]  # one row for each place of a frequent pair
    assert large[0] <= 200 * 300  # one for each word at most
    assert large[0] <= 12 * small[0]


def arrow_batch(texts):
    return pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts})


def test_batches_of_grams_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(phrase_graph, "SENT_BYTES", 10_000)
    words = [c * 900 for c in "abcdefghij"] * 8
    every_pair = np.full(1 << (phrase_graph.PLACES - 5), 0xFFFFFFFF, np.uint32)
    batches = list(phrase_graph.longest_grams(iter([arrow_batch([" \t".join(words)])]), every_pair, 1 << 19))
    found = [gram for batch in batches for gram in batch.column("gram").to_pylist()]
    assert found == [" ".join(words[i : i + phrase_graph.ORDER]) for i in range(len(words) - 1)]
    assert max(len("".join(batch.column("gram").to_pylist())) for batch in batches) <= 10_000 + 5 * 901


def test_counted_words_are_passed_on_by_bytes(monkeypatch):
    monkeypatch.setattr(phrase_graph, "HELD_BYTES", 10_000)
    texts = [" ".join(f"{c}{i % 7}" * 200 for c in "abcde") for i in range(50)]
    batches = list(phrase_graph.part_counts(iter([arrow_batch(texts)]), 1000, 1_000_000))
    words = [(w, n) for b in batches for w, n in zip(b["word"].to_pylist(), b["count"].to_pylist()) if w]
    assert len(words) > 35  # in several parts
    counts = Counter()
    for word, n in words:
        counts[word] += n
    assert counts == Counter(word for text in texts for word in text.split())
