"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

1. Equal texts are one node, known by the MD5 of the text.
2. Shingles that are in more than ``COMMON`` of all rows get their exact document frequency.  Whatever
   is that frequent over all must be half as frequent in some slice of rows, or the slices where it
   is could not make up for the others; so slices report what is, and only shingles whose reported
   sum can still reach the bound are counted over all rows.  There are at most (mean number of shingles
   of a text) / ``COMMON`` of them, however many rows there are; this table goes to the tasks.
3. A shingle weighs (1 + ln tf) * idf.  The idf falls with the logarithm of the document frequency,
   from 1 for shingles at ``COMMON`` or below to ``FLOOR`` for one that is in all rows.  The floor
   keeps large groups of near copies together, whose shared shingles are common only within them.
4. Each node gets ``BANDS`` buckets of ``ROWS`` weighted samples each.  Two texts at similarity 0.8
   share one with probability 0.9994.  In a bucket all members are paired with the most central one
   only, never with each other.
5. Pairs are verified: the weighted Jaccard similarity of their whole texts must reach the threshold.
   Links make components.
6. Where members of a bucket are still in different components, they are paired across components,
   if that gives up to ``PARTNERS`` pairs for each member.  Buckets that would give more hold texts
   that share a passage.  Their nodes are paired by prefix: with a text's shingles ordered from those
   in few of these texts to those in many, two texts at the threshold share one of those shingles
   of either that come before the last 80 % of its weight.  This finds every such pair, while a
   shared passage comes last and pairs nobody.

Defined results: null texts are classes of their own; equal texts are one class, also those without
a word, which are linked to no other text; null and repeated ids are kept row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fitrank.llm.batches import as_batch, columns_apart, text_slices
from fitrank.llm.components import components
from fitrank.llm.scratch import settle, small_batches
from fitrank.llm.shingles import Shingler, counted, mixed, word_table

THRESHOLD = 0.8
COMMON = 0.01
FLOOR = 0.9
BANDS, ROWS = 14, 4
PARTNERS = 8
SLICE = 3 << 19
BLOCK = 1 << 15  # shingles sampled at once, so that the arrays stay in the processor's cache

Common = tuple[np.ndarray, np.ndarray]  # hashes of common shingles, sorted, and their idf


def keyed(docs: DataFrame) -> DataFrame:
    """``key`` and ``text`` of the rows that have a text."""
    text = docs["text"].cast("string")
    return docs.select(F.unhex(F.md5(text)).alias("key"), text.alias("text")).filter(
        F.col("text").isNotNull()
    )


def common_shingles(texts: DataFrame, rows: int) -> Common:
    """The shingles that are in more than COMMON of the rows, with their idf."""
    table = word_table()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(table)
        for _, slice_texts in text_slices(batches, "text", SLICE):
            owners, hashes = shingler(slice_texts)
            least = len(slice_texts) * COMMON / 2
            # Only what falls into a full cell of a small count table can be frequent here.
            cells = hashes >> np.uint64(44)
            full = np.bincount(cells.astype(np.int64), minlength=1 << 20)[cells] > least
            _, hashes, _ = counted(owners[full], hashes[full])
            hashes, counts = np.unique(hashes, return_counts=True)
            some = counts > least
            yield as_batch(
                {
                    "shingle": pa.array(hashes[some].view(np.int64)),
                    "rows": pa.array(counts[some].astype(np.int64)),
                }
            )

    reported = (
        texts.select("text")
        .mapInArrow(report, "shingle bigint, rows bigint")
        .groupBy("shingle")
        .agg(F.sum("rows").alias("rows"))
        .filter(F.col("rows") > rows * COMMON / 2)
    )
    with small_batches(texts.sparkSession):
        reported = reported.toPandas()  # at most 2 * (mean number of shingles) / COMMON rows
    wanted = np.sort(reported["shingle"].to_numpy(np.int64).view(np.uint64))
    if len(wanted) == 0:
        return wanted, np.zeros(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total = Shingler(table), np.zeros(len(wanted), np.int64)
        for _, slice_texts in text_slices(batches, "text", SLICE):
            owners, hashes = shingler(slice_texts)
            known = wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes
            _, hashes, _ = counted(owners[known], hashes[known])
            total += np.bincount(np.searchsorted(wanted, hashes), minlength=len(wanted))
        yield as_batch({"shingle": pa.array(wanted.view(np.int64)), "rows": pa.array(total)})

    exact = (
        texts.select("text")
        .mapInArrow(count, "shingle bigint, rows bigint")
        .groupBy("shingle")
        .agg(F.sum("rows").alias("rows"))
        .filter(F.col("rows") > rows * COMMON)
    )
    with small_batches(texts.sparkSession):
        exact = exact.toPandas()
    hashes = exact["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], idf(exact["rows"].to_numpy(np.float64)[order] / max(rows, 1))


def idf(share: np.ndarray) -> np.ndarray:
    """Weight of a shingle that is in this share of the rows."""
    rarity = np.log(1 / np.clip(share, COMMON, 1)) / np.log(1 / COMMON)
    return FLOOR + (1 - FLOOR) * rarity


def weights(hashes: np.ndarray, repeats: np.ndarray, common: Common) -> np.ndarray:
    known, rarity = common
    out = 1 + np.log(repeats)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        out *= np.where(known[at] == hashes, rarity[at], 1.0)
    return out


def samples(hashes: np.ndarray, log_weights: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """``count`` consistent weighted samples, as hashes, of each set; sets begin at ``starts``.

    For each sample a shingle draws r and c from Gamma(2, 1) and b from [0, 1) by its own hash.  With
    t = floor(ln w / r + b), the shingle with the smallest ln c - r (t - b + 1) is drawn, with its t.
    """
    lengths = np.diff(starts, append=len(hashes))
    out = np.empty((count, len(starts)), np.uint64)
    weights32 = log_weights.astype(np.float32)
    drawn, moved = np.empty_like(hashes), np.empty_like(hashes)
    for k in range(count):
        np.multiply(hashes, np.uint64(((2 * k + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)), out=drawn)
        np.bitwise_xor(drawn, np.right_shift(drawn, np.uint64(32), out=moved), out=drawn)
        np.multiply(drawn, np.uint64(0xBF58476D1CE4E5B9), out=drawn)
        np.bitwise_xor(drawn, np.right_shift(drawn, np.uint64(29), out=moved), out=drawn)
        # Four uniform numbers of 16 bits; -ln of the product of two has the Gamma(2, 1) distribution.
        uniform = drawn.view(np.uint16).astype(np.float32).reshape(-1, 4)
        uniform += np.float32(0.5)
        uniform *= np.float32(2.0**-16)
        r = -np.log(uniform[:, 0] * uniform[:, 1])
        c = -np.log(uniform[:, 2] * uniform[:, 3])
        np.multiply(drawn, np.uint64(0xD1342543DE82EF95), out=moved)
        b = (moved >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(weights32 / r + b)
        value = np.log(c) - r * (t - b + 1)
        least = np.minimum.reduceat(value, starts)
        at = np.flatnonzero(value == np.repeat(least, lengths))
        at = at[np.searchsorted(at, starts)]
        out[k] = mixed(hashes[at] ^ mixed(t[at].astype(np.int64).view(np.uint64) + np.uint64(k)))
    return out


def buckets(shingler: Shingler, texts: list[str], common: Common) -> list[np.ndarray | None]:
    """The band buckets of each text; None without a word."""
    owners, hashes, repeats = counted(*shingler(texts))
    log_weights = np.log(weights(hashes, repeats, common))
    sets = np.flatnonzero(np.diff(owners, prepend=-1))
    out: list[np.ndarray | None] = [None] * len(texts)
    at = 0
    while at < len(sets):
        low = sets[at]
        end = max(at + 1, int(np.searchsorted(sets, low + BLOCK)))
        high = sets[end] if end < len(sets) else len(hashes)
        drawn = samples(hashes[low:high], log_weights[low:high], sets[at:end] - low, BANDS * ROWS)
        for band in range(BANDS):
            bucket = np.full(end - at, band + 1, np.uint64)
            for row in drawn[band * ROWS : (band + 1) * ROWS]:
                bucket = mixed(bucket) ^ row
            drawn[band] = mixed(bucket)
        for i, owner in enumerate(owners[sets[at:end]]):
            out[owner] = drawn[:BANDS, i].view(np.int64)
        at = end
    return out


def similarities(shingler: Shingler, left: list[str], right: list[str], common: Common) -> np.ndarray:
    """Weighted Jaccard similarity of each pair; 0 where a text has no word."""
    out = np.zeros(len(left))
    owners, hashes, repeats = counted(*shingler([*left, *right]))
    weight = weights(hashes, repeats, common)
    n = len(left)
    order = np.lexsort((owners // n, hashes, owners % n)) if n else np.zeros(0, np.int64)
    pair, hashes, weight = owners[order] % n if n else owners, hashes[order], weight[order]
    same = np.flatnonzero((pair[1:] == pair[:-1]) & (hashes[1:] == hashes[:-1]))
    shared = np.bincount(pair[same], np.minimum(weight[same], weight[same + 1]), minlength=n)
    total = np.bincount(pair, weight, minlength=n)
    some = total > 0
    out[some] = shared[some] / (total[some] - shared[some])
    return out


def banded(texts: DataFrame, common: Common) -> DataFrame:
    """``key`` and ``buckets`` of each different text."""
    table = word_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(table)
        for part, slice_texts in text_slices(batches, "text", SLICE):
            found = pa.array(buckets(shingler, slice_texts, common), pa.list_(pa.int64()))
            yield as_batch({"key": part.column("key"), "buckets": found})

    return (
        texts.mapInArrow(run, "key binary, buckets array<bigint>")
        .filter(F.col("buckets").isNotNull())
        .dropDuplicates(["key"])
    )


def stars(shared: DataFrame) -> DataFrame:
    """Edges ``a`` < ``b`` of each member of a ``bucket`` with its most central member.

    That is the member whose buckets have the most members in all.  In a group of copies that were
    each changed at other places it is the text they come from, to which each is more similar than
    to the others.
    """
    central = shared.groupBy("key").agg(F.sum("size").alias("weight"))
    weighted = settle(shared.select("bucket", "key").join(central, "key"), "weighted")
    middle = weighted.groupBy("bucket").agg(F.max(F.struct("weight", "key")).alias("middle"))
    return (
        weighted.join(middle.select("bucket", F.col("middle.key").alias("middle")), "bucket")
        .filter(F.col("key") != F.col("middle"))
        .select(F.least("key", "middle").alias("a"), F.greatest("key", "middle").alias("b"))
        .distinct()
    )


def prefixes(texts: DataFrame, common: Common) -> DataFrame:
    """``key`` and ``bucket``, a row for each shingle of the prefix that is in several of the texts,
    with the weight of the text from there on (``rest``) and in all (``total``)."""
    table = word_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(table)
        for part, slice_texts in text_slices(batches, "text", SLICE):
            owners, hashes, repeats = counted(*shingler(slice_texts))
            weight = weights(hashes, repeats, common)
            total = np.bincount(owners, weight, minlength=len(slice_texts))
            yield as_batch(
                {
                    "key": part.column("key").take(pa.array(owners)),
                    "bucket": pa.array(hashes.view(np.int64)),
                    "weight": pa.array(weight),
                    "total": pa.array(total[owners]),
                }
            )

    schema = "key binary, bucket bigint, weight double, total double"
    weighed = settle(texts.select("key", "text").mapInArrow(run, schema), "weighed")
    holders = weighed.groupBy("bucket").agg(F.count("*").alias("texts")).filter("texts > 1")
    own = Window.partitionBy("key")
    # What only one text has comes first, and pairs nobody; then the rarer of the others.
    later = own.orderBy(F.desc("texts"), F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    rest = F.sum("weight").over(later)
    return (
        weighed.join(holders, "bucket")
        .withColumn("rest", rest)
        .filter(F.col("rest") >= (THRESHOLD - 1e-6) * F.col("total"))
        .select("key", "bucket", "rest", "total")
    )


def sizes_across(rooted: DataFrame) -> DataFrame:
    """``bucket``, ``size`` and how many pairs it has across components, if any."""
    return (
        rooted.groupBy("bucket", "root")
        .agg(F.count("*").alias("n"))
        .groupBy("bucket")
        .agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("n")).alias("within"))
        .select("bucket", "size", ((F.col("size") ** 2 - F.col("within")) / 2).alias("across"))
        .filter("across > 0")
    )


def crossing(rooted: DataFrame) -> DataFrame:
    """Pairs ``a`` < ``b`` of different components in a bucket.

    The components of a bucket are paired first and their members joined to those pairs, so no
    component is compared with itself and the work grows with the pairs that are made.

    Of buckets by prefix only those whose weights from there on, which are all that the texts can
    share if this is the first shingle they share, are enough for the threshold; components none
    of whose members can have enough are not paired.
    """
    by_prefix = "rest" in rooted.columns
    enough = (THRESHOLD - 1e-6) / (1 + THRESHOLD)
    groups = rooted.select("bucket", "root").distinct()
    if by_prefix:
        most = (F.max("rest").alias("rest"), F.min("total").alias("total"))
        groups = rooted.groupBy("bucket", "root").agg(*most)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select([F.col(c).alias(c if c == "bucket" else f"{c}_{name}") for c in df.columns])

    def sufficient(df: DataFrame) -> DataFrame:
        if not by_prefix:
            return df
        return df.filter(f"least(rest_a, rest_b) >= {enough} * (total_a + total_b)")

    roots = side(groups, "a").join(side(groups, "b"), "bucket").filter("root_a < root_b")
    across = sufficient(roots).select("bucket", "root_a", "root_b")
    left = across.join(side(rooted, "a"), ["bucket", "root_a"])
    pairs = sufficient(left.join(side(rooted, "b"), ["bucket", "root_b"]))
    return pairs.select(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).distinct()


def linked(pairs: DataFrame, texts: DataFrame, common: Common) -> DataFrame:
    """The pairs whose weighted Jaccard similarity reaches the threshold; ``texts`` once by key."""
    table = word_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(table)
        for part, left in text_slices(batches, "text_a", SLICE, "text_b"):
            like = similarities(shingler, left, part.column("text_b").to_pylist(), common)
            yield part.select(["a", "b"]).filter(pa.array(like >= THRESHOLD - 1e-9))

    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``key`` and ``root`` of the texts that are linked to another text."""
    texts = keyed(docs)
    common = common_shingles(texts, docs.count())
    bands = settle(banded(texts, common), "bands")
    members = bands.select("key", F.explode("buckets").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = settle(members.join(sizes, "bucket"), "shared")
    # The texts move once; all later steps use the few that share a bucket.
    some = settle(
        texts.join(shared.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]),
        "texts",
    )
    pairs = settle(stars(shared), "pairs")
    links = settle(linked(pairs, some, common), "links")
    roots = components(links).withColumnRenamed("node", "key")

    def rooted(own: DataFrame) -> DataFrame:
        named = own.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        return settle(named, "rooted")

    in_buckets = rooted(shared.select("key", "bucket"))
    across = settle(sizes_across(in_buckets), "across")
    fits = F.col("across") <= F.col("size") * PARTNERS
    near = crossing(in_buckets.join(across.filter(fits).select("bucket"), "bucket"))
    rest = in_buckets.join(across.filter(~fits).select("bucket"), "bucket").select("key").distinct()
    by_prefix = prefixes(some.join(settle(rest, "rest"), "key", "left_semi"), common)
    far = crossing(rooted(by_prefix))
    new = settle(near.unionAll(far).distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
    new_links = settle(linked(new, some, common), "links")
    if new_links.isEmpty():
        return roots
    return components(links.unionAll(new_links)).withColumnRenamed("node", "key")


def classed_rows(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` (null without a text) and ``root``, the key of the class."""
    roots = near_duplicates(docs)
    rows = docs.select("doc_id", F.unhex(F.md5(docs["text"].cast("string"))).alias("key"))
    return rows.join(roots, "key", "left").select(
        "doc_id", "key", F.coalesce("root", "key").alias("root")
    )


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``class_id`` (the smallest id of its class) and ``class_size``, for every row."""
    rows = settle(classed_rows(docs), "rows")
    named = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(named.filter(F.col("root").isNotNull()), "root", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


@columns_apart("doc_id", "text")
def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, that with the smallest id, with all columns of the documents."""
    rows = settle(classed_rows(docs), "rows").filter(F.col("key").isNotNull())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    winners = rows.groupBy("root").agg(first.alias("first")).select(
        F.col("first.key").alias("key__"), F.col("first.doc_id").alias("doc_id__")
    )
    text_rows = docs.withColumn("key__", F.unhex(F.md5(docs["text"].cast("string"))))
    with_text = text_rows.filter(F.col("key__").isNotNull())
    won = with_text.join(winners, "key__").filter(F.col("doc_id").eqNullSafe(F.col("doc_id__")))
    single = won.dropDuplicates(["key__"])
    return single.select(*docs.columns).unionAll(docs.filter(docs["text"].isNull()))
