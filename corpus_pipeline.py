"""The pipeline over ``documents``: language, near-duplicates, benchmark, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written and read again
as the documents of the next one.  All stages but the last return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fitrank.llm import bpe_codec, containment, hypervector_language, surrogates, weighted_minhash
from fitrank.llm.queries import surrogate_key, table, tokenizer_path
from fitrank.llm.scratch import settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled rows; texts without letters go."""
    return hypervector_language.accepted(docs, hypervector_language.learn(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the smallest id."""
    return weighted_minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return containment.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data; ``n_chars`` is that of the new text."""
    replaced = surrogates.replace(docs, surrogate_key(spark), None)
    if "n_chars" not in docs.columns:
        return replaced
    kind = docs.schema["n_chars"].dataType
    return replaced.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document and the hash of the bytes that they decode to."""
    import public_tokenizers

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    return bpe_codec.round_trip(docs, path, public_tokenizers.PATTERN).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        "token_ids",
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", replace_personal_data),
    ("tokens", encode_tokens),
]

ORACLE_SQL = None  # no stage but decontamination can be said in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
