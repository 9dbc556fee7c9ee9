"""A kept report that is searched for any part of its texts without reading all of it.

``rpt_search`` looks into every row.  Here each different text is filed under all its runs of one, two
and three characters, as rows (gram, key) in folders by the hash of the gram and sorted by gram in
them, so a search opens one folder for each of its grams and skips the row groups of others there.  The
texts that hold all grams are candidates; they are verified by ``contains`` on the rows of the report,
which are filed by key.

Rows with equal texts share one key, so null and repeated ids are kept as they are.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitrank.operators.keyword_join import runs, text_key
from fitrank.operators.report import search_text

GRAM = 3
FOLDERS = 64
KEY, PLACE = "_key", "_place"


def folder_of(value: Column) -> Column:
    return (F.crc32(value) % FOLDERS).cast("int")


def write_index(flat: DataFrame, path: str) -> None:
    """File a flat report; written again it replaces what the path held."""
    keyed = flat.withColumn(KEY, text_key(search_text()))
    rows = keyed.withColumn(PLACE, folder_of(F.col(KEY)))
    by_place = rows.hint("rebalance", PLACE).sortWithinPartitions(PLACE, KEY)
    by_place.write.mode("overwrite").partitionBy(PLACE).parquet(f"{path}/rows")
    texts = keyed.select(KEY, search_text().alias("text")).dropDuplicates([KEY])
    grams = F.concat(*[runs(F.col("text"), size) for size in range(1, GRAM + 1)])
    lists = texts.select(F.explode(grams).alias("gram"), KEY).withColumn(
        PLACE, folder_of(F.encode("gram", "UTF-8"))
    )
    filed = lists.hint("rebalance", PLACE).sortWithinPartitions(PLACE, "gram")
    filed.write.mode("overwrite").partitionBy(PLACE).parquet(f"{path}/grams")


def grams_of(query: str) -> list[str]:
    """The grams under which a text is looked up that holds the query."""
    if len(query) < GRAM:
        return [query]
    return sorted({query[at : at + GRAM] for at in range(len(query) - GRAM + 1)})


def posting_lists(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    """(gram, key) of the given grams, from their folders alone."""
    places = {zlib.crc32(gram.encode("utf-8")) % FOLDERS for gram in grams}
    lists = spark.read.parquet(f"{path}/grams")
    return lists.where(F.col(PLACE).isin(sorted(places)) & F.col("gram").isin(grams))


def search_index(spark: SparkSession, path: str, query: str) -> DataFrame:
    """The rows of the report that ``search`` would keep; an empty query keeps all."""
    rows = spark.read.parquet(f"{path}/rows")
    query = query.lower()
    if query:
        grams = grams_of(query)
        counts = posting_lists(spark, path, grams).groupBy(KEY).agg(F.count("gram").alias("n"))
        found = counts.where(F.col("n") == len(grams)).select(KEY, folder_of(F.col(KEY)).alias(PLACE))
        rows = rows.join(found, [PLACE, KEY], "left_semi").where(search_text().contains(query))
    return rows.drop(KEY, PLACE)


def search_many(spark: SparkSession, path: str, queries: DataFrame) -> DataFrame:
    """(``query``, ``job_id``) for a table of queries, each once for every row of the report it is in.

    A query meets the list of its rarest gram and the pairs are verified.  Queries are compared in lower
    case; null and empty ones are left out, repeated ones count once.
    """
    asked = queries.select(F.lower("query").alias("query")).where(F.col("query") != "").distinct()
    size = F.least(F.char_length("query"), F.lit(GRAM))
    own = F.transform(
        F.sequence(F.lit(1), F.char_length("query") - size + 1), lambda at: F.substring("query", at, size)
    )
    grams = asked.select("query", F.explode(F.array_distinct(own)).alias("gram"))
    lists = spark.read.parquet(f"{path}/grams").select("gram", KEY)
    lengths = lists.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").count()
    rarest = (
        grams.join(lengths, "gram", "left")
        .groupBy("query")
        .agg(F.min(F.struct("count", "gram")).alias("least"), F.count_if(F.col("count").isNull()).alias("none"))
        .where(F.col("none") == 0)
        .select("query", F.col("least.gram").alias("gram"))
    )
    pairs = rarest.join(lists, "gram").select("query", KEY)
    rows = spark.read.parquet(f"{path}/rows").select(KEY, "job_id", search_text().alias("text"))
    return pairs.join(rows, KEY).where(F.col("text").contains(F.col("query"))).select("query", "job_id")
