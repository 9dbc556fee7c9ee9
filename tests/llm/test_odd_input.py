"""Very long unbroken texts and clashing column names, for operators and stages of the pipeline."""

import time

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fitrank.llm import bpe_codec, surrogates

from .helpers import DATA, documents, rows

UNITS = ["a", " ", "\n", "-", "7", "0f9a", "aGVsbG8_", "語", "ab cd ", "Xy-", "1.1", "a:", " \n", "\x1c", "'"]
INSIDE = [
    "key", "key__", "again__", "score__", "lang_pred__", "grams__", "own__", "key_a__", "key_b__", "doc_id__",
    "n_entities__", "root", "class_id", "first", "bucket", "shingle", "column_3", "surrogate", "kind", "canon",
]


@pytest.mark.parametrize("unit", UNITS)
def test_long_runs_are_encoded_as_the_library_does(unit):
    encoding = bpe_codec.load_encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = unit * (60_000 // len(unit))
    assert bpe_codec.encode_text(encoding, text, 500, 500) == encoding.encode_ordinary(text)
    text = unit * (5_000_000 // len(unit.encode()))
    assert encoding.decode(bpe_codec.encode_text(encoding, text)) == text


@pytest.mark.parametrize("tail", ["", "@", " a@b.org"])
@pytest.mark.parametrize("unit", UNITS)
def test_entities_of_long_runs_are_found_in_linear_time(unit, tail):
    begun = time.perf_counter()
    found = surrogates.entities(unit * (1_000_000 // len(unit)) + tail)
    assert time.perf_counter() - begun < 20
    if tail.endswith("org") and unit in (" ", "\n", "ab cd "):
        assert [e.kind for e in found] == ["email"]


def test_stages_keep_columns_that_are_named_like_their_own(spark):
    texts = ["the house and the tree are in the garden", "the house and the tree are in the garden", "e x@y.org b c d e f"]
    docs = documents(spark, texts, [1, 2, 3], ["en"] * 3).select("doc_id", "text", "lang")
    docs = docs.select("*", *(F.concat(F.lit(name), F.col("doc_id").cast("string")).alias(name) for name in INSIDE))
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", *INSIDE], name
    got = rows(docs)
    assert sorted(r[0] for r in got) == [1, 3]
    assert all(r[3:] == tuple(f"{name}{r[0]}" for name in INSIDE) for r in got)


def test_the_pipeline_takes_long_unbroken_texts(spark):
    texts = [unit * (300_000 // len(unit)) for unit in UNITS] + ["a plain text of some words"]
    docs = documents(spark, texts, langs=["en"] * len(texts))
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in docs.collect())
