"""The trained operators: held-out accuracy, defined results, and the arithmetic behind them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fitrank.llm import compression_quality, hypervector_language
from fitrank.llm.queries import op6_hypervector_language, op9_compression_quality

from .helpers import DATA, documents, given, rows

BIGGER = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out_rows(spark):
    got = op6_hypervector_language(spark, BIGGER)
    docs = spark.read.parquet(f"{BIGGER}/documents.parquet")
    right = (
        got.join(docs.select("doc_id", "lang"), "doc_id")
        .filter("held_out")
        .agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"))
        .first()
    )
    assert right[0] > 0.97 and right[1] > 200
    assert got.count() == docs.count()
    assert got.filter("score < 0 or score > 1 or score is null").isEmpty()


def language_docs(spark):
    english = "the house and the garden with a tree and the birds in it " * 3
    german = "das haus und der garten mit einem baum und die vögel darin " * 3
    texts = [english, german, english, german, None, "", "12 34 !!", "und der baum", "the birds", "the birds"]
    langs = ["en", "de", "en", "de", "en", "en", None, None, None, None]
    return documents(spark, texts, [0, 1, 2, 3, 4, 5, 6, 7, None, None], langs)


def test_language_of_odd_rows(spark):
    docs = language_docs(spark)
    profiles = hypervector_language.learn(docs, F.lit(True))
    assert profiles.languages == ["de", "en"]
    got = sorted(rows(hypervector_language.identify(docs, profiles).select("doc_id", "lang_pred")), key=str)
    want = [(0, "en"), (1, "de"), (2, "en"), (3, "de"), (4, "und"), (5, "und"), (6, "und"), (7, "de")]
    assert got == sorted([*want, (None, "en"), (None, "en")], key=str)
    kept = hypervector_language.accepted(docs, profiles)
    assert kept.columns == docs.columns and kept.count() == 7


def test_texts_in_unknown_languages_go(spark):
    import random

    draw = random.Random(3)
    labelled = spark.read.parquet(f"{BIGGER}/documents.parquet").select("doc_id", "text", "lang")

    def written(letters, words):
        return " ".join("".join(draw.choices(letters, k=draw.randint(2, 9))) for _ in range(words))

    latin = "abcdefghijklmnopqrstuvwxyz"
    strange = [written(script, words) for script in ("абвгдежзиклмнопрсту", "αβγδεζηθικλμνξοπρ")
               for words in (1, 3, 10, 100, 2000) for _ in range(20)]
    strange += [written(latin, words) for words in (40, 100, 2000) for _ in range(20)]
    strange += ["kot je rybę w kuchni babci bardzo spokojnie a potem śpi na krześle przy oknie"]
    clean = ["the", "Avec.", "und", "All rights reserved.", "the quick brown fox jumps over the lazy dog",
             "the birds and the house " * 500, "The The The The " * 100]
    texts = [(-1 - i, text, None) for i, text in enumerate([*strange, *clean])]
    docs = labelled.union(spark.createDataFrame(texts, labelled.schema))
    profiles = hypervector_language.learn(docs, F.lit(True))
    kept = {r["doc_id"] for r in hypervector_language.accepted(docs, profiles).collect()}
    assert not [text for i, text, _ in texts[: len(strange)] if i in kept]
    assert not [text for i, text, _ in texts[len(strange) :] if i not in kept]
    assert labelled.filter(F.col("text").rlike(r"\p{L}") & ~F.col("doc_id").isin(kept)).isEmpty()


@pytest.mark.parametrize("available", [0, 1, 3000, 10_000, 10**7, 10**10, 10**13, 10**15])
def test_samples_have_their_size_at_every_scale(spark, available):
    from fitrank.llm import batches

    for module in (hypervector_language, compression_quality):
        assert module.hash_share is batches.hash_share
    share = spark.range(1).select(batches.hash_share(5000, available)).first()[0]
    assert abs(share / 2**62 * available - min(5000, available)) < 1e-3
    below = spark.range(20_000).select(F.col("id").alias("doc_id")).filter(
        batches.hash_place("x") < batches.hash_share(5000, 20_000)
    )
    assert 4700 < below.count() < 5300


def test_nothing_to_learn_from(spark):
    docs = language_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    profiles = hypervector_language.learn(docs, F.lit(True))
    assert {r[1:] for r in rows(hypervector_language.identify(docs, profiles))} == {("und", 0.0)}
    assert hypervector_language.accepted(docs, profiles).count() == 7
    assert rows(hypervector_language.identify(docs.limit(0), profiles)) == []


def test_bundle_is_the_sum_of_bound_vectors():
    is_letter = np.unpackbits(np.frombuffer(hypervector_language.letter_table(), np.uint8)).astype(bool)
    texts = ["Ab, ba!", "", "é"]
    got = hypervector_language.bundles(texts, is_letter, 128)

    def vector(char):
        if char == " ":
            return hypervector_language.letter_vectors(np.zeros(1, np.uint32), 128)[0]
        return hypervector_language.letter_vectors(np.array([ord(char)], np.uint32), 128)[0]

    for text, found in zip([" ab ba ", "", " é "], got, strict=True):
        want = np.zeros(128)
        for a, b, c in zip(text, text[1:], text[2:]):
            want += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        assert (found == want).all()


def test_quality_accuracy_on_held_out_rows(spark):
    got = op9_compression_quality(spark, BIGGER)
    labels = spark.read.parquet(f"{BIGGER}/labels.parquet")
    right = (
        got.join(labels, "doc_id")
        .filter("held_out")
        .agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.avg("quality"))
        .first()
    )
    assert right[0] > 0.92 and right[0] > right[1]
    assert got.count() == spark.read.parquet(f"{BIGGER}/documents.parquet").count()
    assert got.filter("score < 0 or score > 1 or score is null").isEmpty()


def test_quality_of_odd_rows(spark):
    docs = given(spark, "documents").select("doc_id", "text", F.lit("x").alias("score"))
    labels = given(spark, "labels")
    model = compression_quality.learn(docs, labels, F.lit(True))
    odd = documents(spark, [None, "", "x", "x", "word " * 100_000], [None, 1, 2, 2, 3])
    got = rows(compression_quality.score(odd, model))
    assert len(got) == 5 and all(0 <= r[2] <= 1 for r in got)
    by_id = {r[0]: r[2] for r in got}
    assert by_id[None] == by_id[1]
    assert rows(compression_quality.score(odd.limit(0), model)) == []


@pytest.mark.parametrize(("condition", "want"), [("quality = 1", 1), ("quality = 0", 0), ("false", 0.5)])
def test_one_label_or_none(spark, condition, want):
    docs = given(spark, "documents").limit(20)
    model = compression_quality.learn(docs, given(spark, "labels").filter(condition), F.lit(True))
    assert all(abs(r[2] - want) < 1e-9 for r in rows(compression_quality.score(docs, model)))
    assert DATA


def test_all_labelled_rows_teach_and_set_the_least_scores(spark):
    texts = F.when(F.col("id") % 2 == 0, "abra kadabra").otherwise("the other words of it")
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), texts.alias("text"), F.lit("xx").alias("lang"))
    profiles = hypervector_language.learn(docs, F.lit(True))
    table = np.unpackbits(np.frombuffer(hypervector_language.letter_table(), np.uint8)).astype(bool)
    two = hypervector_language.bundles(["abra kadabra", "the other words of it"], table, 1024)
    assert (profiles.prototypes[0] == 6_000 * two.sum(axis=0)).all()

    # The quantile of a size is that of all its labelled texts: 12,000 here, not a sample of them.
    asked = []
    taken = hypervector_language.least_scores

    def noted(score, grams, labelled, dimensions):
        asked.append(labelled.count())
        return taken(score, grams, labelled, dimensions)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(hypervector_language, "least_scores", noted)
        assert hypervector_language.accepted(docs, profiles).count() == 12_000
    assert asked == [12_000]
