"""Benchmark decontamination: size-partitioned MinHash containment search for short test items.

Texts are sets of shingles of five words; words are runs of letters and digits, in lower case.  An
item is found in a document if the document holds at least 80 % of the item's shingles.

A MinHash signature of a long document says nothing about the ten shingles of a short item: with
20,000 words the two sets have a Jaccard similarity of 0.0005.  So sketches are taken of the items
only, and looked up among all shingles of a document.  Items are partitioned by size; the sketch of
an item is its k smallest shingle hashes, k by its partition.  As the k smallest of a random hash
order are a random sample of the item, the part of them that a document holds estimates the
containment; and as k is greater than the number of shingles that may be missing, every pair at or
above the threshold shares at least one of them.  So the search loses nothing, with one hash for
each shingle instead of a signature.  Candidates are then verified on all shingles.

Rows are known by the hash of their text, not by their ids, so null and repeated ids are right and
copies of a text share the work.  Main path: DataFrame functions only.

An item of fewer than five words is one shingle, the run of all its words, and is looked up among all
runs of that length.  Documents make such runs only for the lengths that occur among the items, in the
same pass.  An item of fewer than ``least`` words (two, unless told otherwise) says too little to be
searched in longer texts: it is found in documents that consist of just its words.

Defined results: null texts and texts without a word have no shingle and are in no result; items of
one text are all reported; repeated rows of a document are reported each; texts of any length are
read whole, with one row of 8 bytes for each shingle; no documents or no items give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fitrank.llm.batches import columns_apart
from fitrank.llm.scratch import settle

WORDS = 5
THRESHOLD = 0.8
LEAST_WORDS = 2  # of an item that is searched inside longer texts
NOT_WORD = r"[^\p{L}\p{N}]+"
KEY = ("key_a", "key_b")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(text, F.lit("b")).alias("key_b")]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda word: word != "")


def runs_of(words: Column, length: int) -> Column:
    """The hash of each run of so many words, in order, with repeats; none if there are fewer."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(words) - (length - 1)),
        lambda at: F.xxhash64(*(F.get(words, at + (i - 1)) for i in range(length))),
    )
    return F.when(F.size(words) >= length, runs).otherwise(F.array().cast("array<bigint>"))


def whole_run(words: Column, least: int) -> Column:
    """The hash of all words of a text that has fewer than ``least`` of them."""
    whole = F.array(F.xxhash64(F.lit("whole"), F.array_join(words, " ")))
    short = (F.size(words) > 0) & (F.size(words) < least)
    return F.when(short, whole).otherwise(F.array().cast("array<bigint>"))


def shingle_rows(texts: DataFrame, shingles: Callable[[Column], Column]) -> DataFrame:
    """A row with ``shingle`` for each shingle of each ``text``; the other columns are kept."""
    # The words are an own column that isn't computed again for each use.
    split = texts.withColumn("words", words_of(F.col("text"))).drop("text")
    return split.select(
        *[c for c in split.columns if c != "words"],
        F.explode(shingles(F.col("words"))).alias("shingle"),
    )


def of_item(least: int) -> Callable[[Column], Column]:
    """The shingles of an item: runs of five words, or one run of all its words."""

    def shingles(words: Column) -> Column:
        found = runs_of(words, WORDS)
        for length in range(least, WORDS):
            found = F.when(F.size(words) == length, runs_of(words, length)).otherwise(found)
        return F.when(F.size(words) < least, whole_run(words, least)).otherwise(found)

    return shingles


def of_document(lengths: list[int], least: int) -> Callable[[Column], Column]:
    """The shingles of a document: runs of five words and of the lengths of the short items."""

    def shingles(words: Column) -> Column:
        runs = [runs_of(words, length) for length in (WORDS, *lengths) if length >= least]
        if any(length < least for length in lengths):
            runs.append(whole_run(words, least))
        return F.concat(*runs) if len(runs) > 1 else runs[0]

    return shingles


def short_lengths(items: DataFrame) -> list[int]:
    """The numbers of words below five that occur among the items: at most four numbers."""
    n_words = F.size(words_of(F.col("text").cast("string")))
    short = items.select(n_words.alias("n")).filter(F.col("n").between(1, WORDS - 1))
    return sorted(row.n for row in short.distinct().collect())


def item_shingles(items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``item_key``, ``shingle``, ``n_shingles`` of each different item text, and whether the
    shingle is in the item's ``sketch``."""
    keyed = items.filter(F.col("text").isNotNull()).select(
        F.xxhash64("text").alias("item_key"), F.col("text").cast("string").alias("text")
    )
    rows = shingle_rows(keyed, of_item(least)).distinct()
    by_hash = Window.partitionBy("item_key").orderBy("shingle")
    sized = rows.withColumns(
        {
            "place": F.row_number().over(by_hash),
            "n_shingles": F.count("*").over(Window.partitionBy("item_key")),
        }
    )
    # Partition p holds the sizes from 2^p to 2^(p+1) - 1; its sketches fit its largest items.
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n_shingles")) + 1) - 1
    length = F.floor((1 - THRESHOLD) * largest + 1e-9) + 1
    return sized.select(
        "item_key", "shingle", "n_shingles", (F.col("place") <= length).alias("sketch")
    )


def candidates(texts: DataFrame, items: DataFrame, shingles: Callable[[Column], Column]) -> DataFrame:
    """The pairs of text key and item key that share a shingle of the item's sketch."""
    sketches = items.filter("sketch").select("shingle", "item_key")
    keyed = texts.select(*text_key(F.col("text")), "text")
    return shingle_rows(keyed, shingles).join(sketches, "shingle").select(*KEY, "item_key").distinct()


def verified(
    texts: DataFrame, items: DataFrame, pairs: DataFrame, shingles: Callable[[Column], Column]
) -> DataFrame:
    """The candidate pairs with ``n_shared`` and ``n_shingles``, at the threshold or above."""
    wanted = pairs.select(*KEY).distinct()
    keyed = texts.select(*text_key(F.col("text")), "text").join(wanted, list(KEY), "left_semi")
    shared = (
        shingle_rows(keyed, shingles)
        .join(items.select("shingle", "item_key", "n_shingles"), "shingle")
        .groupBy(*KEY, "item_key", "n_shingles")
        .agg(F.countDistinct("shingle").alias("n_shared"))
    )
    enough = F.col("n_shared") >= F.col("n_shingles") * THRESHOLD - 1e-9
    return shared.join(pairs, [*KEY, "item_key"], "left_semi").filter(enough)


def found_texts(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Keys of texts with the items found in them: ``key_a``, ``key_b``, ``item_key``, counts."""
    if least < 1:
        raise ValueError("least is a number of words from one")
    least = min(least, WORDS)
    texts = docs.select(docs["text"].cast("string").alias("text")).filter(F.col("text").isNotNull())
    wanted = settle(item_shingles(items, least), "items")
    shingles = of_document(short_lengths(items), least)
    pairs = settle(candidates(texts, wanted, shingles), "pairs")
    return settle(verified(texts, wanted, pairs, shingles), "found")


def search(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_shared``, ``n_shingles`` and ``containment`` of all finds."""
    found = found_texts(docs, items, least)
    named = items.select("item_id", F.xxhash64("text").alias("item_key"))
    ids = docs.select("doc_id", *text_key(docs["text"].cast("string")))
    return (
        ids.join(found, list(KEY))
        .join(named, "item_key")
        .select(
            "doc_id",
            "item_id",
            "n_shared",
            "n_shingles",
            (F.col("n_shared") / F.col("n_shingles")).alias("containment"),
        )
    )


@columns_apart("text")
def drop_contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    found = found_texts(docs, items, least).select(*KEY).distinct()
    hashes = text_key(docs["text"].cast("string"))
    names = [f"{name}__" for name in KEY]
    keyed = docs.withColumns(dict(zip(names, hashes, strict=True)))
    same = [keyed[n] == found[k] for n, k in zip(names, KEY, strict=True)]
    return keyed.join(found, same, "left_anti").select(*[keyed[c] for c in docs.columns])


ORACLE = f"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text),
        '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
tested AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
        lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
doc_sets AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - {WORDS - 2}),
    lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) AS s FROM words WHERE len(w) >= {WORDS}),
item_sets AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - {WORDS - 2}),
    lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) AS s FROM tested WHERE len(w) >= {WORDS}),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM item_sets GROUP BY item_id)
SELECT doc_id, d.item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM (SELECT doc_id, i.item_id, count(*) AS n_shared FROM doc_sets d JOIN item_sets i ON d.s = i.s
    GROUP BY doc_id, i.item_id) d JOIN sizes z ON d.item_id = z.item_id
WHERE n_shared >= n_shingles * {THRESHOLD} - 1e-9
UNION ALL
SELECT doc_id, item_id, 1, 1, 1.0 FROM words d JOIN tested t ON len(t.w) BETWEEN 1 AND {WORDS - 1}
    AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(t.w, ' ') || ' ')
    AND (len(t.w) >= {LEAST_WORDS} OR len(d.w) = len(t.w))"""
