"""Hard negatives by threshold joins over an inverted index that norms cut short (L2AP style).

Anchors meet all rows in a grid of shards of rows and blocks of anchors.  In a task the dimensions are
ordered by energy and taken in groups.  The inverted index holds, for each group, the rows that have a
component in it; of a row it omits the last dimensions, whose norm times the anchor's is below every
threshold, so that they alone can't reach one.  Partial scores are accumulated group by group, and rows
and pairs are dropped when the partial score and the product of the remaining norms stay below the
anchor's threshold.  What is left is scored whole, in integers.

The same join is run twice: for the positives of each anchor, then for the windows that their scores
open.  Where nothing is known of an anchor, its threshold starts high and is lowered until its windows
are full or can't gain.  That happens on a hash sample of at most ``FIRST`` rows.  The worst score of a
full window there is a valid threshold for all rows, as more rows only raise it.  Between that sample and
all rows there are samples ``STEP`` times as large each, so that the rows above a threshold stay few.

Scores are exact: products of doubles where all partial sums are below 2^53, else 64-bit integers, which
wrap beyond 2^63; windows are exact for scores below 10^17.  Nothing is capped but what a window returns.

Defined results: rows with a null id or label, an empty vector, a null vector, or a null or non-finite
component take no part; zero vectors do.  Of several rows of one id the smallest counts.  Vectors of
different lengths aren't compared.  Positives of the same score share their window's rows.  An empty
table, and an anchor without positives or negatives, give no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitrank.llm.batches import HASH_BITS
from fitrank.llm.scratch import settle
from fitrank.llm.vector_rows import finite, matrix, one_for_each_id

GROUP = 8  # dimensions that are indexed together
FIRST, STEP = 8192, 32  # rows of the first sample, and how much larger each next one is
SHARD_FACTOR, SMALLEST, LARGEST = 16, 2048, 65_536  # rows of a shard grow with the root of all rows
ANCHOR_BLOCK = 65_536
SCORES = 1 << 22  # partial scores that a task holds at once
LOWER = 0.6
SLACK = 1e-9  # norms are rounded, so bounds are relaxed by this share


class Index:
    """Rows of a shard by groups of dimensions, for scores with anchors."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        energy = (rows.astype(np.float64) ** 2).sum(axis=0)
        order = np.argsort(-energy, kind="stable")
        rows, anchors = rows[:, order], anchors[:, order]
        most = float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * rows.shape[1]
        kind = np.float64 if most < 2**53 else np.int64
        self.rows, self.anchors = rows.astype(kind), anchors.astype(kind)
        self.cuts = [*range(0, rows.shape[1], GROUP), rows.shape[1]]
        self.row_rest, self.anchor_rest = self.rest(rows), self.rest(anchors)

    def rest(self, vectors: np.ndarray) -> np.ndarray:
        """Norms from each cut to the end, one row for each cut."""
        squares = vectors.astype(np.float64) ** 2
        sums = np.array([squares[:, a:b].sum(axis=1) for a, b in zip(self.cuts, self.cuts[1:])])
        back = np.cumsum(sums[::-1], axis=0)[::-1]
        return np.sqrt(np.vstack([back, np.zeros(len(vectors))])) * (1 + SLACK)

    def join(self, own: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchor, row and score of the pairs of some anchors that reach their thresholds."""
        parts = []
        step = max(SCORES // max(len(self.rows), 1), 1)
        for at in range(0, len(own), step):
            parts += self.joined(own[at : at + step], thresholds[at : at + step])
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate([part[i] for part in parts]) for i in range(3))

    def joined(self, own: np.ndarray, thresholds: np.ndarray):
        lengths = self.anchor_rest[0, own]
        # Below this norm the end of a row can't reach any threshold by itself.
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.min(np.where(thresholds > 0, thresholds / lengths, 0), initial=np.inf)
        indexed = (self.row_rest >= least).sum(axis=0) if least > 0 else np.full(len(self.rows), len(self.cuts))
        indexed = np.minimum(indexed, len(self.cuts) - 1)  # groups of each row in the index
        alive = np.flatnonzero(indexed > 0)
        partial = np.zeros((len(own), len(alive)), self.rows.dtype)
        anchors = self.anchors[own]
        for group, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            listed = np.flatnonzero(indexed[alive] > group)
            values = self.rows[alive[listed], a:b]
            some = values.any(axis=1)
            if some.all() and len(listed) == len(alive):
                partial += anchors[:, a:b] @ values.T
            elif some.any():
                partial[:, listed[some]] += anchors[:, a:b] @ values[some].T
            if group % 2 and group + 2 < len(self.cuts) and len(alive):
                # What a row can still gain is bounded by the remaining norms.
                left = self.row_rest[np.minimum(group + 1, indexed[alive]), alive]
                gain = self.anchor_rest[group + 1, own][:, None] * left
                # A row whose index ended before has all of its omitted end to gain.
                ended = indexed[alive] <= group
                if ended.any():
                    gain[:, ended] = self.anchor_rest[indexed[alive[ended]]][:, own].T * left[ended]
                reach = (partial + gain >= thresholds[:, None]).any(axis=0)
                if reach.sum() < len(alive) * 3 // 4:
                    alive, partial = alive[reach], np.ascontiguousarray(partial[:, reach])
        ends = indexed[alive]
        for at in range(0, len(own), 64):
            part = slice(at, at + 64)
            gain = self.anchor_rest[:, own[part]].T[:, ends] * self.row_rest[ends, alive]
            who, where = np.nonzero(partial[part] + gain >= thresholds[part, None])
            for k in range(0, len(who), 1 << 16):
                i, j = who[k : k + (1 << 16)] + at, alive[where[k : k + (1 << 16)]]
                scores = np.einsum("ij,ij->i", anchors[i], self.rows[j]).astype(np.int64)
                good = scores >= thresholds[i]
                if good.any():
                    yield own[i[good]], j[good], scores[good]


def first_of(order_by: tuple[np.ndarray, ...], group: np.ndarray, count: int) -> np.ndarray:
    """Places of the first ``count`` of each group, in group order."""
    order = np.lexsort((*order_by[::-1], group))
    sorted_group = group[order]
    begin = np.flatnonzero(np.append(True, sorted_group[1:] != sorted_group[:-1])[: len(order)])
    rank = np.arange(len(order)) - np.repeat(begin, np.diff(begin, append=len(order)))
    return order[rank < count]


def lowered(index: Index, floors: np.ndarray, starts: np.ndarray, bottoms: np.ndarray, pick):
    """Join with thresholds that are lowered for the anchors whose windows ``pick`` finds unfilled.

    Floors are thresholds known to be enough; NaN where none is known.  ``pick`` gives the places of
    the pairs to return, and for each anchor whether it has enough.
    """
    at = np.where(np.isnan(floors), starts, floors)
    open_anchors = np.flatnonzero(at <= index.anchor_rest[0] * index.row_rest[0].max(initial=0) + 1)
    parts = []
    while len(open_anchors):
        who, row, score = index.join(open_anchors, at[open_anchors])
        chosen, enough = pick(who, row, score)
        done = enough | ~np.isnan(floors) | (at <= bottoms)
        keep = chosen[done[who[chosen]]]
        parts.append((who[keep], row[keep], score[keep]))
        open_anchors = open_anchors[~done[open_anchors]]
        lower = np.where(at > 1, at * LOWER, bottoms)
        at = np.where(done, at, np.maximum(lower, bottoms))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *(part[i] for part in parts)]) for i in range(3))


def both_sides(rows: pa.Table, anchors: pa.Table):
    x, a = matrix(rows["vector"], np.int64), matrix(anchors["vector"], np.int64)
    index = Index(x, a)
    ids, own = rows["vec_id"].to_numpy(), anchors["anchor_id"].to_numpy()
    labels = np.concatenate([rows["label"].to_numpy(), anchors["label"].to_numpy()])
    reach = index.anchor_rest[0] * index.row_rest[0].max(initial=0)
    floors = anchors["floor"].to_numpy().astype(np.float64)  # NaN for null; a score or below
    return index, ids, own, labels[: len(x)], labels[len(x) :], reach, floors


HITS = {"anchor_id": pa.int64(), "positive_score": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}
HIT = "anchor_id bigint, positive_score bigint, vec_id bigint, score bigint"


def positives_in(rows: pa.Table, anchors: pa.Table, wanted: int) -> pa.Table:
    """The best rows of an anchor's label in a shard, but the anchor itself."""
    if not rows.num_rows or not anchors.num_rows:
        return pa.table({name: pa.array([], kind) for name, kind in HITS.items()})
    index, ids, own, row_labels, labels, reach, floors = both_sides(rows, anchors)

    def pick(who, row, score):
        fit = np.flatnonzero((row_labels[row] == labels[who]) & (ids[row] != own[who]))
        best = fit[first_of((-score[fit], ids[row[fit]]), who[fit], wanted)]
        return best, np.bincount(who[best], minlength=len(own)) >= wanted

    who, row, score = lowered(index, floors, reach / 2, -reach - 1, pick)
    columns = [own[who], np.zeros(len(who), np.int64), ids[row], score]
    return pa.table({name: pa.array(x, kind) for (name, kind), x in zip(HITS.items(), columns)})


def negatives_in(rows: pa.Table, anchors: pa.Table, wanted: int, low: int, high: int) -> pa.Table:
    """The best rows of other labels in a shard in the window of each positive score."""
    if not rows.num_rows or not anchors.num_rows:
        return pa.table({name: pa.array([], kind) for name, kind in HITS.items()})
    index, ids, own, row_labels, labels, reach, floors = both_sides(rows, anchors)
    lists = anchors["positive_scores"].to_pylist()
    width = max(map(len, lists))
    scores = np.array([[*some, *[-1] * (width - len(some))] for some in lists], np.int64)
    # Windows in whole scores; those of negative scores are empty, and so is the filling.
    bottom, top = -(-low * scores // 100), high * scores // 100
    empty = scores < 0
    lowest = np.where(empty, np.inf, bottom).min(axis=1)
    start = np.where(empty, -np.inf, top).max(axis=1) * 0.95
    window_of = np.arange(width)

    def pick(who, row, score):
        other = np.flatnonzero(row_labels[row] != labels[who])
        places, windows = [], []
        for k in window_of:
            own_score = score[other]
            inside = ~empty[who[other], k] & (own_score >= bottom[who[other], k]) & (own_score <= top[who[other], k])
            fit = other[inside]
            places.append(fit[first_of((-score[fit], ids[row[fit]]), who[fit], wanted)])
            windows.append(np.full(len(places[-1]), k))
        chosen, window = np.concatenate(places), np.concatenate(windows)
        counts = np.zeros((len(own), width), np.int64)
        np.add.at(counts, (who[chosen], window), 1)
        return chosen, ((counts >= wanted) | empty).all(axis=1)

    floors = np.where(np.isnan(floors), np.nan, np.maximum(floors, np.where(np.isinf(lowest), 0, lowest)))
    usable = ~np.isinf(lowest)
    start, lowest = np.where(usable, start, reach * 2 + 2), np.where(usable, lowest, 0)
    who, row, score = lowered(index, floors, start, lowest, pick)
    # A pair may be in several windows; it is known by its score, and windows by theirs.
    out: dict[str, list] = {name: [] for name in HITS}
    pairs = np.unique(np.stack([who, row, score]), axis=1) if len(who) else np.zeros((3, 0), np.int64)
    who, row, score = pairs
    for k in window_of:
        fit = np.flatnonzero(~empty[who, k] & (score >= bottom[who, k]) & (score <= top[who, k]))
        best = fit[first_of((-score[fit], ids[row[fit]]), who[fit], wanted)]
        for name, x in zip(HITS, (own[who[best]], scores[who[best], k], ids[row[best]], score[best])):
            out[name].append(x)
    return pa.table({name: pa.array(np.concatenate(out[name]), kind) for name, kind in HITS.items()})


def grid(rows: DataFrame, count: int, anchors: DataFrame, anchor_count: int, run) -> DataFrame:
    """``run`` of each shard of rows with each block of anchors."""
    size = min(max(SHARD_FACTOR * count**0.5, SMALLEST), LARGEST)
    shards, blocks = max(1, -(-count // int(size))), max(1, -(-anchor_count // ANCHOR_BLOCK))
    own = lambda name, parts: F.pmod(F.xxhash64(name, F.lit("place")), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = rows.withColumn("shard", own("vec_id", shards)).withColumn("block", every(blocks))
    right = anchors.withColumn("block", own("anchor_id", blocks)).withColumn("shard", every(shards))
    place = ["length", "shard", "block"]
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(run, HIT)


def best_hits(hits: DataFrame, wanted: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= wanted)


def sample_sizes(count: int) -> list[int]:
    sizes = [FIRST]
    while sizes[-1] < count:
        sizes.append(sizes[-1] * STEP)
    return [*sizes[:-1], count]


def threshold_join(rows: DataFrame, count: int, anchors: DataFrame, anchor_count: int, run, wanted: int, floors):
    """The best hits of each window over all rows, by way of the samples; ``floors`` reads thresholds
    (``anchor_id, floor``) off the hits of a sample."""
    floor = anchors.select("anchor_id", F.lit(None).cast("bigint").alias("floor"))
    place = F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << HASH_BITS))
    for size in sample_sizes(count):
        share = (1 << HASH_BITS) * size // max(count, 1)
        some = rows.filter(place < F.lit(share).cast("bigint")) if size < count else rows
        known = anchors.join(floor, "anchor_id", "left")
        hits = settle(best_hits(grid(some, size, known, anchor_count, run), wanted), "hits")
        floor = floors(hits)
    return hits


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` has ``vec_id``, ``label`` (a whole number) and ``vector`` (an array of whole numbers);
    ``is_anchor`` is an expression of ``vec_id``.  Negatives score from ``low`` to ``high`` hundredths
    of their positive.
    """
    rows = one_for_each_id(
        rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0)).select(
            F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.size("vector").alias("length"), "vector"
        ),
        "vec_id",
    )
    count = rows.count()
    anchors = settle(rows.filter(is_anchor).withColumnRenamed("vec_id", "anchor_id"), "anchors")
    anchor_count = anchors.count()

    def full_floor(hits: DataFrame) -> DataFrame:
        worst = hits.groupBy("anchor_id").agg(F.min("score").alias("floor"), F.count("*").alias("found"))
        return worst.filter(F.col("found") == positives).select("anchor_id", "floor")

    def find_positives(x: pa.Table, y: pa.Table) -> pa.Table:
        return positives_in(x, y, positives)

    found = threshold_join(rows, count, anchors, anchor_count, find_positives, positives, full_floor)
    windows = found.groupBy("anchor_id").agg(F.sort_array(F.collect_set("score"), False).alias("positive_scores"))
    windows = settle(anchors.join(windows, "anchor_id"), "windows")

    def window_floor(hits: DataFrame) -> DataFrame:
        full = hits.groupBy("anchor_id", "positive_score").agg(F.min("score").alias("worst"), F.count("*").alias("found"))
        each = windows.select("anchor_id", F.explode("positive_scores").alias("positive_score"))
        each = each.filter(F.col("positive_score") >= 0).join(full, ["anchor_id", "positive_score"], "left")
        hundredths = F.col("positive_score").cast("decimal(19,0)") * F.lit(low) / F.lit(100)
        return each.groupBy("anchor_id").agg(
            F.min(F.when(F.col("found") == negatives, F.col("worst")).otherwise(F.ceil(hundredths).cast("bigint"))).alias("floor")
        )

    def find_negatives(x: pa.Table, y: pa.Table) -> pa.Table:
        return negatives_in(x, y, negatives, low, high)

    hits = threshold_join(rows, count, windows, anchor_count, find_negatives, negatives, window_floor)
    return found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(
        hits.withColumnRenamed("score", "negative_score").withColumnRenamed("vec_id", "negative_id"),
        ["anchor_id", "positive_score"],
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_numbers(vectors: DataFrame, label: Column, scale: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, label, vector`` with each component x as floor(scale * x); unusable vectors go."""
    return (
        vectors.select(
            vectors[id_column].cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"),
            vectors[vector_column].cast("array<double>").alias("vector"),
        )
        .filter(finite("vector"))
        .withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale)))))
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank,
       s.other AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""
