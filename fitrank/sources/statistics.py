"""Corpus statistics that are kept up to date batch by batch.

A log holds the change of the document frequencies that each batch of documents makes.  Changes are
sums, so they merge in any order, and a new batch is the only text that is read: the corpus is never
split again.  The empty term, which every document holds once, carries the number of documents.

A batch is one folder of changes and then one marker that commits it.  Readers take marked batches
only; a batch that broke off is written again under its id, and a marked one is left as it is, so a
repeated call counts nothing twice.  Documents that leave the corpus are logged with ``sign`` -1.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitrank.functions.fixed_values import ENGLISH_STOP_WORDS
from fitrank.functions.text import is_scored_term, term_counts

CHANGES = "term string, df long, batch_id string"
MARKS = "covers array<string>, batch_id string"


def changes_of(
    docs: DataFrame,
    text: str = "description",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    sign: int = 1,
) -> DataFrame:
    """(term, df): what the documents add to the frequencies.  One row per term leaves each task."""
    term = F.col("term")
    pairs = docs.select(F.inline(term_counts(F.col(text))))
    kept = pairs.where((term == "") | is_scored_term(term, stop_words))
    return kept.groupBy("term").agg((F.count(F.lit(1)) * sign).alias("df"))


def _marks(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(MARKS).json(f"{path}/batches")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MARKS)


def _commit(spark: SparkSession, path: str, batch_id: str, covers: Column) -> None:
    mark = spark.range(1).select(covers.alias("covers")).coalesce(1)
    mark.write.mode("overwrite").json(f"{path}/batches/batch_id={quote(batch_id, safe='')}")


def log_statistics(
    docs: DataFrame,
    path: str,
    batch_id: str,
    text: str = "description",
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    sign: int = 1,
) -> bool:
    """Add a batch to the log; False, and nothing is read or written, if the log holds it already.

    Every batch must be logged with the same stop words.  Null texts are documents without a term.
    """
    spark = docs.sparkSession
    if not _marks(spark, path).where(F.array_contains("covers", batch_id)).isEmpty():
        return False
    folder = f"{path}/terms/batch_id={quote(batch_id, safe='')}"
    changes_of(docs, text, stop_words, sign).write.mode("overwrite").parquet(folder)
    _commit(spark, path, batch_id, F.array(F.lit(batch_id)))
    return True


def read_statistics(spark: SparkSession, path: str) -> DataFrame:
    """(term, df) over all complete batches; the empty term has the number of documents."""
    marked = _marks(spark, path).select("batch_id")
    if marked.isEmpty():
        return spark.createDataFrame([], "term string, df long")
    changes = spark.read.schema(CHANGES).parquet(f"{path}/terms")
    merged = changes.join(marked, "batch_id", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    return merged.where(F.col("df") != 0)


def frequencies(statistics: DataFrame) -> DataFrame:
    """(term, df) as ``tfidf_scores`` takes them."""
    return statistics.where(F.col("term") != "")


def corpus_size(statistics: DataFrame) -> Column:
    """The number of documents, as a scalar subquery; 0 for an empty log."""
    documents = F.sum(F.when(F.col("term") == "", F.col("df")))
    return statistics.agg(F.coalesce(documents, F.lit(0)).alias("n_docs")).scalar()


def compact_statistics(spark: SparkSession, path: str, into: str, files: int) -> None:
    """Merge all complete batches into one batch of a new log of ``files`` files.

    The new log knows which batches it covers, so none of them can be added to it again.  The old one
    isn't touched.
    """
    batch_id = f"merged-{uuid.uuid4().hex}"
    covered = _marks(spark, path).select(F.explode("covers").alias("one"))
    merged = read_statistics(spark, path).repartition(files, "term").sortWithinPartitions("term")
    merged.write.mode("overwrite").parquet(f"{into}/terms/batch_id={batch_id}")
    _commit(spark, into, batch_id, covered.agg(F.collect_set("one")).scalar())
