"""Small tables for the tests of this folder."""

from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        # Extra columns whose names occur inside the operators.
        T.StructField("key", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("bucket", T.LongType()),
    ]
)


def documents(spark, texts, ids=None, langs=None):
    ids = range(len(texts)) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    rows = [(i, t, lang, "k", "s", 7) for i, t, lang in zip(ids, texts, langs, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def given(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def rows(frame):
    return [tuple(r) for r in frame.collect()]
