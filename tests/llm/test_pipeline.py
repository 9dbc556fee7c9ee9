"""The pipeline, stage by stage."""

import hashlib

import corpus_pipeline as pipeline
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from fitrank.llm import bpe_codec, surrogates
from fitrank.llm.queries import SURROGATE_KEY
from fitrank.llm.scratch import settle

from .helpers import DATA, documents, given, rows
from .test_duplicates import brute_classes, plain_shingles


def test_run_equals_the_stages_done_plainly(spark):
    table = given(spark, "documents").orderBy("doc_id").collect()
    docs = [(r["doc_id"], r["text"]) for r in table if regex.search(r"\p{L}", r["text"] or "")]
    firsts = brute_classes([t for _, t in docs])
    docs = [d for i, d in enumerate(docs) if firsts[i] == i]
    items = [set(plain_shingles(r["text"])) for r in given(spark, "benchmark").collect()]
    docs = [
        (i, t)
        for i, t in docs
        if not any(len(own & set(plain_shingles(t))) >= 0.8 * len(own) for own in items if own)
    ]
    found = pipeline.run(spark, DATA).collect()
    assert sorted(r["doc_id"] for r in found) == [i for i, _ in docs]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoding = bpe_codec.load_encoding(path, public_tokenizers.PATTERN)
    texts = dict(docs)
    for row in found:
        text = surrogates.replaced(texts[row["doc_id"]], SURROGATE_KEY, {}, {})[0]
        assert row["token_ids"] == encoding.encode_ordinary(text)
        assert row["n_tokens"] == len(row["token_ids"])
        assert row["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_stages_return_the_columns_of_documents(spark):
    texts = [None, "", "12 34", "some english words here", "some english words here", "e x@y.org b c d e"]
    docs = documents(spark, texts, [0, 1, 2, 3, None, 5]).withColumn("n_chars", F.length("text"))
    for name, stage in pipeline.STAGES[:-1]:
        new = stage(spark, docs, DATA)
        assert new.columns == docs.columns, name
        empty = stage(spark, docs.limit(0), DATA)
        assert empty.columns == docs.columns and rows(empty) == []
        docs = new
    assert sorted(r["doc_id"] for r in docs.collect()) == [3, 5]
    assert docs.filter(F.length("text") != F.col("n_chars")).isEmpty()


def test_long_texts_reach_python_in_small_batches(spark):
    sizes = "size bigint"
    docs = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("abcdefgh"), 5_000).alias("text"))  # 24 MB

    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["size"])

    kept = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    found = [r.size for r in settle(docs.mapInArrow(run, sizes), "sizes").collect()]
    assert 24_000_000 < sum(found) < 25_000_000 and max(found) < 6_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == kept
