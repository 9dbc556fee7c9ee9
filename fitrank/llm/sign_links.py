"""Near-duplicate vectors by random-hyperplane signs in several tables.

1. A vector's signature in a table is the signs of its products with the table's ``bits`` random
   hyperplanes.  Vectors of equal signature share a bucket.  ``bits`` grows with the logarithm of the
   number of vectors, so that unrelated vectors stay about ``BUCKET`` to a bucket; the number of tables
   is what finds a pair at the threshold with probability ``RECALL`` (0.999), and closer pairs more often.
2. Where a bucket has more than ``block`` vectors, one of them is its pivot.  Vectors within half the
   threshold's angle of one pivot are a ball.  By the triangle inequality of angles all of a ball are
   linked, without a look at its pairs; each vector is in one ball at most.
3. Other pairs of a bucket are met in tasks, in cells of bounded size: a bucket, or two parts of a large
   one.  Two parts of one ball are never met.  A pair is looked at in the first table that it shares, so
   it is counted once.  Pairs whose signatures differ in more bits than ``SPREADS`` standard deviations
   beyond what the threshold lets expect are passed over (one in 10^9 links).
4. The vectors of the cells that still hold a pair are joined, and the pair's cosine is computed in
   double precision.  A task gives counts by vector and links to one member of each group it has joined;
   pairs are never written.
5. Connected components of those links and of the balls.

Defined results: a row for every vector of an id that isn't null; of several vectors of one id the
smallest counts.  Null, empty, zero and non-finite vectors link with nothing and are kept; so are rows
without an id, one by one, with a null component.  Vectors of different lengths are not compared.
An empty table gives no rows; extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitrank.llm.batches import as_batch
from fitrank.llm.components import components
from fitrank.llm.scratch import settle
from fitrank.llm.vector_rows import finite, matrix, one_for_each_id

THRESHOLD = 0.95
RECALL = 0.999
BUCKET = 64
BLOCK = 512
FILTER_WORDS = 4
SPREADS = 6
PIVOTS = 2
PAIRS = 1 << 18  # pairs that a task looks at at once
REST = -(1 << 63)  # the class of what is in no large ball


class Signs:
    """How many tables of how many bits, and where a table's bits stand in the packed words."""

    def __init__(self, rows: int, threshold: float, recall: float):
        self.same = 1 - math.acos(threshold) / math.pi  # chance that a link agrees in one sign
        self.bits = min(max(math.ceil(math.log2(max(rows, 1) / BUCKET)), 4), 30)
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - self.same**self.bits))
        self.in_word = 64 // self.bits
        self.words = max(-(-self.tables // self.in_word), FILTER_WORDS)

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The packed signs of each vector, one row of words each."""
        length = vectors.shape[1]
        vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=0)
        rng = np.random.default_rng([length, self.bits])
        out = np.zeros((len(vectors), self.words), np.uint64)
        for word in range(self.words):
            planes = rng.standard_normal((length, self.bits * self.in_word))
            places = np.uint64(1) << np.arange(planes.shape[1], dtype=np.uint64)
            out[:, word] = ((vectors @ planes > 0) * places).sum(axis=1, dtype=np.uint64)
        return out

    def sent(self, table):
        """Words that table ``table`` needs: its own, those before it, and enough to filter."""
        return np.maximum(table // self.in_word + 1, FILTER_WORDS)

    def most_different(self, table: np.ndarray) -> np.ndarray:
        count = self.sent(table) * self.in_word * self.bits
        return count * (1 - self.same) + SPREADS * np.sqrt(count * self.same * (1 - self.same))

    def shared_before(self, unlike: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Do the pairs, given by their unlike bits, share a bucket of a table before this one?"""
        out = np.zeros(len(unlike), bool)
        mask = np.uint64((1 << self.bits) - 1)
        for earlier in range(int(table.max(initial=0))):
            shift = np.uint64(earlier % self.in_word * self.bits)
            out |= ((unlike[:, earlier // self.in_word] >> shift) & mask == 0) & (earlier < table)
        return out


def signatures(rows: DataFrame, signs: Signs) -> DataFrame:
    """``vec_id, length, words``: the packed signs of each row of ``vec_id, vector``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                words = signs.of(matrix(part.column("vector"))).view(np.int64)
                offsets = np.arange(len(words) + 1, dtype=np.int32) * signs.words
                yield as_batch(
                    {
                        "vec_id": part.column("vec_id"),
                        "length": part.column("length"),
                        "words": pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.ravel())),
                    }
                )

    return rows.mapInArrow(run, "vec_id bigint, length int, words array<bigint>")


def in_tables(signed: DataFrame, signs: Signs) -> DataFrame:
    """One row for each vector and table: ``vec_id, length, ball, table, bucket, words``."""
    word = F.get("words", F.floor(F.col("table") / signs.in_word).cast("int"))
    shift = (F.col("table") % signs.in_word) * signs.bits
    own = F.call_function("shiftrightunsigned", word, shift.cast("int")).bitwiseAND(
        F.lit((1 << signs.bits) - 1).cast("bigint")
    )
    sent = F.greatest(F.floor(F.col("table") / signs.in_word).cast("int") + 1, F.lit(FILTER_WORDS))
    return signed.withColumn("table", F.explode(F.sequence(F.lit(0), F.lit(signs.tables - 1)))).select(
        "vec_id",
        "length",
        "ball",
        "table",
        (F.col("table").cast("bigint") * (1 << 32) + own).alias("bucket"),
        F.slice("words", F.lit(1), sent).alias("words"),
    )


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each row with the same row; scaled first, so that no square can overflow or vanish."""
    left = left / np.abs(left).max(axis=1, keepdims=True, initial=0)
    right = right / np.abs(right).max(axis=1, keepdims=True, initial=0)
    product = np.einsum("ij,ij->i", left, right)
    return product / np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right))


def balls(rows: DataFrame, tables: DataFrame, large: DataFrame, threshold: float) -> DataFrame:
    """``vec_id, ball``: vectors of large buckets within half the threshold's angle of a pivot."""
    place = ["length", "bucket"]
    near = tables.select("vec_id", *place).join(large.select(*place, "pivot"), place)
    chosen = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("pivot"), "pivot"))), 1, PIVOTS)
    pairs = near.groupBy("vec_id").agg(F.explode(chosen).alias("at")).select("vec_id", "at.pivot")
    vectors = rows.select("vec_id", "vector")
    pivots = vectors.join(large.select(F.col("pivot").alias("vec_id")).distinct(), "vec_id").select(
        F.col("vec_id").alias("pivot"), F.col("vector").alias("centre")
    )
    least = math.cos(math.acos(threshold) / 2) + 1e-9  # beyond what rounding can change

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths):
                part = batch.filter(pa.array(lengths == length))
                close = cosines(matrix(part.column("vector")), matrix(part.column("centre"))) >= least
                yield part.select(["vec_id", "pivot"]).filter(pa.array(close))

    met = pairs.join(vectors, "vec_id").join(pivots, "pivot")
    close = met.select("vec_id", "pivot", F.size("vector").alias("length"), "vector", "centre")
    return (
        close.mapInArrow(within, "vec_id bigint, pivot bigint").groupBy("vec_id").agg(F.min("pivot").alias("ball"))
    )


def cells(tables: DataFrame, large: DataFrame, block: int) -> DataFrame:
    """Rows of tables by the cells in which they are met: ``x, y`` are the two parts, ``side`` the own."""
    place = ["length", "bucket"]
    plain = tables.join(large, place, "left_anti").select(
        "*", *(F.lit(0).cast("bigint").alias(name) for name in "xy"), F.lit(0).alias("side")
    )
    crowded = settle(tables.join(large.select(*place), place), "crowded")
    sizes = crowded.groupBy(*place, "ball").count()
    own_class = F.when(F.col("count") * 2 >= block, F.col("ball")).otherwise(F.lit(None))
    classes = sizes.select(*place, F.coalesce(own_class, F.lit(REST)).alias("kind"), "count")
    classes = settle(
        classes.groupBy(*place, "kind").agg(F.ceil(F.sum("count") / block).cast("int").alias("parts")), "classes"
    )
    others = classes.select(*place, F.col("kind").alias("other"), F.col("parts").alias("other_parts"))
    meets = classes.join(others, place).filter(
        (F.col("kind") != F.col("other")) | (F.col("kind") == REST)
    )
    big_balls = classes.select(*place, F.col("kind").alias("ball"), F.col("kind"))
    placed = crowded.join(big_balls, [*place, "ball"], "left").withColumn("kind", F.coalesce("kind", F.lit(REST)))
    met = placed.join(meets, [*place, "kind"]).withColumn(
        "part", F.pmod(F.xxhash64("vec_id", F.lit("part")), F.col("parts")).cast("int")
    ).withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    mine, theirs = F.struct("kind", "part"), F.struct(F.col("other").alias("kind"), F.col("other_part").alias("part"))
    low, high = F.least(mine, theirs), F.greatest(mine, theirs)
    met = met.select(
        *tables.columns, F.xxhash64(low).alias("x"), F.xxhash64(high).alias("y"),
        (mine > theirs).cast("int").alias("side"),
    )
    return plain.unionByName(met)


CELL = ["length", "bucket", "x", "y"]


def whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole cells from batches that are sorted by cell."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = np.stack([batch.column(name).to_numpy().astype(np.int64) for name in CELL], axis=1)
        begun = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        if kept:
            last = [kept[-1].column(name)[-1].as_py() for name in CELL]
            if last != keys[0].tolist():
                yield pa.Table.from_batches(kept).combine_chunks()
                kept = []
        cut = int(begun[-1]) if len(begun) else 0
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)]).combine_chunks()
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks()


def met_pairs(rows: pa.Table, signs: Signs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows of each pair that may be a link and is first met here, in bounded numbers."""
    size = rows.num_rows
    keys = np.stack([rows[name].to_numpy().astype(np.int64) for name in CELL], axis=1)
    begin = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
    lengths = np.diff(begin, append=size)
    ends = np.repeat(begin + lengths, lengths)
    side, table = rows["side"].to_numpy(), rows["table"].to_numpy()
    second = np.repeat(begin + lengths - np.add.reduceat(side, begin), lengths)  # where side 1 begins
    two = keys[:, 2] != keys[:, 3]
    start = np.where(two, second, np.arange(size) + 1)
    count = np.where(two & (side == 1), 0, ends - start)
    widths = signs.sent(table)
    words = np.zeros((size, signs.words), np.uint64)
    flat = rows["words"].combine_chunks().flatten().to_numpy().view(np.uint64)
    words[np.arange(signs.words) < widths[:, None]] = flat
    ball = rows["ball"].fill_null(REST).to_numpy()
    most = signs.most_different(table)
    total = np.cumsum(count)
    at = 0
    while at < size:
        until = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")), at + 1)
        some = count[at:until]
        i = np.repeat(np.arange(at, until), some)
        j = np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some) + start[i]
        at = until
        unlike = words[i, 0] ^ words[j, 0]
        different = np.bitwise_count(unlike).astype(np.int32)
        for word in range(1, FILTER_WORDS):
            different += np.bitwise_count(words[i, word] ^ words[j, word])
        few = different <= signs.most_different(np.zeros(1, np.int64))[0]
        i, j = i[few], j[few]
        apart = (ball[i] != ball[j]) | (ball[i] == REST)
        i, j = i[apart], j[apart]
        unlike = words[i] ^ words[j]
        new = (np.bitwise_count(unlike).sum(axis=1) <= most[i]) & ~signs.shared_before(unlike, table[i])
        if new.any():
            yield i[new], j[new]


def grouped(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each place is joined to."""
    roots = np.arange(size)
    while True:
        low = np.minimum(roots[i], roots[j])
        new = roots.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == roots).all():
            return roots
        roots = new


ROW = "vec_id bigint, length int, table int, bucket bigint, words array<bigint>, ball bigint, x bigint, y bigint, side int"


def links(vectors: DataFrame, met: DataFrame, signs: Signs, threshold: float) -> DataFrame:
    """``vec_id, links, root``: counted links of a vector in a task, and a member of its group there."""
    order = [*CELL, "side", "vec_id"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            used = np.zeros(rows.num_rows, bool)
            for i, j in met_pairs(rows, signs):
                used[i] = used[j] = True
            yield from rows.filter(pa.array(used)).combine_chunks().to_batches()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_cells(batches):
            ids, lengths = rows["vec_id"].to_numpy(), rows["length"].to_numpy()
            flat = rows["vector"].combine_chunks().flatten().to_numpy()
            begin = np.cumsum(lengths) - lengths
            for i, j in met_pairs(rows, signs):
                close = np.zeros(len(i), bool)
                for length in np.unique(lengths[i]):
                    some = np.flatnonzero(lengths[i] == length)
                    step = max((1 << 22) // int(length), 1)
                    for part in (some[k : k + step] for k in range(0, len(some), step)):
                        span = np.arange(length)
                        left, right = flat[begin[i[part]][:, None] + span], flat[begin[j[part]][:, None] + span]
                        close[part] = cosines(left, right) >= threshold
                i, j = i[close], j[close]
                used, places = np.unique(np.concatenate([i, j]), return_inverse=True)
                if len(used):
                    roots = grouped(len(used), places[: len(i)], places[len(i) :])
                    yield as_batch(
                        {
                            "vec_id": pa.array(ids[used]),
                            "links": pa.array(np.bincount(places, minlength=len(used))),
                            "root": pa.array(ids[used][roots]),
                        }
                    )

    met = met.select(*(field.split()[0] for field in ROW.split(", ")))
    found = met.repartition(*CELL).sortWithinPartitions(*order).mapInArrow(candidates, ROW)
    found = settle(found, "candidates")
    whole = found.join(vectors.select("vec_id", "vector"), "vec_id").select(*found.columns, "vector")
    return whole.repartition(*CELL).sortWithinPartitions(*order).mapInArrow(
        verified, "vec_id bigint, links bigint, root bigint"
    )


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block: int = BLOCK,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector; ``threshold`` from 0 to 1, excluded."""
    every = vectors.select(
        vectors[id_column].cast("bigint").alias("vec_id"),
        vectors[vector_column].cast("array<double>").alias("vector"),
    )
    usable = finite("vector") & F.exists("vector", lambda x: x != 0)
    rows = one_for_each_id(
        every.filter(F.col("vec_id").isNotNull() & usable).select("vec_id", F.size("vector").alias("length"), "vector"),
        "vec_id",
    )
    signs = Signs(rows.count(), threshold, recall)
    signed = settle(signatures(rows, signs).withColumn("ball", F.lit(None).cast("bigint")), "signs")
    tables = in_tables(signed, signs)
    pivot = F.min_by("vec_id", F.xxhash64("vec_id"))
    large = settle(
        tables.groupBy("length", "bucket")
        .agg(F.count("*").alias("members"), pivot.alias("pivot"))
        .filter(F.col("members") > block),
        "large",
    )
    if large.limit(1).count():
        balled = settle(balls(rows, tables, large, threshold), "balls")
        met = cells(in_tables(signed.drop("ball").join(balled, "vec_id", "left"), signs), large, block)
        others = balled.groupBy("ball").agg((F.count("*") - 1).alias("links"))
        in_balls = balled.join(others, "ball").select("vec_id", "links", F.col("ball").alias("root"))
    else:
        met = tables.select(
            "*", *(F.lit(0).cast("bigint").alias(name) for name in "xy"), F.lit(0).alias("side")
        )
        in_balls = None
    found = links(rows, met, signs, threshold)
    found = settle(found.unionByName(in_balls) if in_balls else found, "links")
    pairs = found.filter(F.col("vec_id") != F.col("root")).select(F.col("vec_id").alias("a"), F.col("root").alias("b"))
    joined = components(pairs)
    none = lambda kind: F.lit(None).cast(kind)
    result = (
        found.select("vec_id", "links", none("bigint").alias("root"))
        .unionByName(joined.select(F.col("node").alias("vec_id"), none("bigint").alias("links"), "root"))
        .groupBy("vec_id")
        .agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    )
    ids = every.select("vec_id")
    ids = ids.filter(F.col("vec_id").isNotNull()).distinct().unionAll(ids.filter(F.col("vec_id").isNull()))
    component = F.coalesce("root", "vec_id")
    return ids.join(result, "vec_id", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
unit AS (
  SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS norm FROM v
  WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (a.norm * b.norm) >= {THRESHOLD}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(least.b, vec_id)) AS kept
FROM v LEFT JOIN degree ON degree.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
