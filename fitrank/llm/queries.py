"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitrank.llm import (
    bpe_codec,
    compression_quality,
    containment,
    hnsw,
    hypervector_language,
    link_trust,
    mincut_html,
    norm_pruned,
    phrase_graph,
    sign_links,
    surrogates,
    token_count,
    weighted_minhash,
)

TOKEN_LIMIT = 1024
QUALITY_CUT = 0.3
SURROGATE_KEY = b"a key for the test tables only"
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret key that the session names in ``spark.fitrank.surrogate.key``."""
    named = spark.conf.get("spark.fitrank.surrogate.key", None)
    return named.encode() if named else SURROGATE_KEY


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.classes(table(spark, sf_dir, "documents"))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_count.count_tokens(
        table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.search(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    replaced = surrogates.replace(table(spark, sf_dir, "documents"), surrogate_key(spark), "n_entities")
    return replaced.select("doc_id", "text", "n_entities")


def op5_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut_html.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def id_remainder(modulus: int, id_column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def op6_hypervector_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(4) == 2
    profiles = hypervector_language.learn(docs, ~held_out)
    return hypervector_language.identify(docs, profiles).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score"
    )


def op7_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_remainder(5) == 0
    model = compression_quality.learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return compression_quality.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"),
    )


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe_codec.round_trip(
        table(spark, sf_dir, "documents"),
        tokenizer_path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias(
            "ids_sha256"
        ),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op11_sign_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sign_links.near_duplicates(table(spark, sf_dir, "embeddings"))


def op12_norm_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = norm_pruned.whole_numbers(table(spark, sf_dir, "embeddings"), label, 256)
    return norm_pruned.mine(rows, vec_id % 100 == 0)


def op13_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_weighted_minhash": op1_weighted_minhash,
    "op2_token_count": op2_token_count,
    "op3_containment": op3_containment,
    "op4_surrogates": op4_surrogates,
    "op5_mincut_html": op5_mincut_html,
    "op6_hypervector_language": op6_hypervector_language,
    "op7_link_trust": op7_link_trust,
    "op8_hnsw": op8_hnsw,
    "op9_compression_quality": op9_compression_quality,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_sign_links": op11_sign_links,
    "op12_norm_pruned": op12_norm_pruned,
    "op13_phrase_graph": op13_phrase_graph,
}
ORACLES = {
    "op3_containment": containment.ORACLE,
    "op7_link_trust": link_trust.oracle(URL_RULES),
    "op11_sign_links": sign_links.ORACLE,
    "op12_norm_pruned": norm_pruned.ORACLE,
    "op13_phrase_graph": phrase_graph.ORACLE,
}
