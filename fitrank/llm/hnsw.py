"""Nearest neighbours by largest inner product: a navigable small-world graph in each shard.

Vectors are dealt to shards by a hash of their content.  Each shard becomes a hierarchical graph,
stored as rows with flat arrays of neighbours.  A block of queries searches a shard in one task; the
results of all shards are merged, and the scores are inner products of the original vectors in double
precision.  Inner products become cosines by one more component, which gives all vectors of a shard
one length, so the graph may be used for vectors of any length.

Equal vectors are one node of the graph and equal queries are searched once.  Of the ids of equal
vectors the smallest k + 1 are kept, as more can't be among the results of any query.  The size of
shards grows with the root of the number of vectors, up to ``LARGEST`` rows for the memory of a task.

Defined results: null ids, and vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors of different lengths are not compared; equal scores are ordered by
id; the own id is no candidate; repeated rows count once.
"""

from __future__ import annotations

from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fitrank.llm.scratch import settle

LINKS = 16  # links of a node in upper layers, twice as many in the lowest
BREADTH_BUILD = 80
BREADTH_SEARCH = 120
SHARD_FACTOR = 64  # rows of a shard for each square root of a row
SMALLEST, LARGEST = 4096, 131_072
QUERY_BLOCK = 32_768


class Graph:
    """A hierarchical navigable small-world graph over the rows of a matrix of unit vectors."""

    def __init__(self, vectors: np.ndarray, levels: np.ndarray):
        self.vectors, self.levels = vectors, levels
        self.seen = np.zeros(len(vectors), np.int64)
        self.stamp = 0
        self.entry, self.top = -1, -1
        self.layers: list[dict[int, np.ndarray]] = []
        room = LINKS * 3
        self.low = np.zeros((len(vectors), room), np.int32)
        self.low_count = np.zeros(len(vectors), np.int32)

    def neighbours(self, node: int, layer: int) -> np.ndarray:
        if layer == 0:
            return self.low[node, : self.low_count[node]]
        return self.layers[layer].get(node, EMPTY)

    def search(self, target: np.ndarray, entries: list[tuple[float, int]], breadth: int, layer: int):
        """The best ``breadth`` nodes found, as (similarity, node), unsorted."""
        self.stamp += 1
        seen, stamp, vectors = self.seen, self.stamp, self.vectors
        open_nodes = [(-s, n) for s, n in entries]
        open_nodes.sort()
        found = sorted(entries)
        for _, node in entries:
            seen[node] = stamp
        while open_nodes:
            far, node = heappop(open_nodes)
            if -far < found[0][0] and len(found) >= breadth:
                break
            near = self.neighbours(node, layer)
            near = near[seen[near] != stamp]
            if len(near) == 0:
                continue
            seen[near] = stamp
            likes = vectors[near] @ target
            if len(found) >= breadth:
                better = likes > found[0][0]
                near, likes = near[better], likes[better]
            for like, other in zip(likes.tolist(), near.tolist()):
                if len(found) < breadth:
                    heappush(found, (like, other))
                elif like > found[0][0]:
                    heapreplace(found, (like, other))
                else:
                    continue
                heappush(open_nodes, (-like, other))
        return found

    def spread_out(self, nodes: np.ndarray, likes: np.ndarray, count: int) -> np.ndarray:
        """Up to ``count`` nodes, best first, each closer to the target than to those before it;
        the closest of the others fill up."""
        order = np.argsort(-likes, kind="stable")
        nodes, likes = nodes[order], likes[order]
        if len(nodes) <= count:
            return nodes
        among = self.vectors[nodes] @ self.vectors[nodes].T
        covered = np.full(len(nodes), -np.inf, np.float32)
        chosen, left = [], []
        for i in range(len(nodes)):
            if likes[i] > covered[i]:
                chosen.append(i)
                if len(chosen) == count:
                    break
                np.maximum(covered, among[i], out=covered)
            else:
                left.append(i)
        return nodes[(chosen + left)[:count]]

    def link(self, node: int, other: int, layer: int):
        """Add ``other`` to the neighbours of ``node``; thin them out when there is no room left."""
        if layer == 0:
            count = self.low_count[node]
            if count == self.low.shape[1]:
                near = np.append(self.low[node], np.int32(other))
                kept = self.spread_out(near, self.vectors[near] @ self.vectors[node], 2 * LINKS)
                self.low[node, : len(kept)] = kept
                self.low_count[node] = len(kept)
            else:
                self.low[node, count] = other
                self.low_count[node] = count + 1
            return
        near = np.append(self.neighbours(node, layer), np.int32(other))
        if len(near) > 2 * LINKS:
            near = self.spread_out(near, self.vectors[near] @ self.vectors[node], LINKS)
        self.layers[layer][node] = near

    def descend(self, target: np.ndarray, down_to: int) -> list[tuple[float, int]]:
        best = [(float(self.vectors[self.entry] @ target), self.entry)]
        for layer in range(self.top, down_to, -1):
            best = self.search(target, best, 1, layer)
        return best

    def insert(self, node: int):
        level, target = int(self.levels[node]), self.vectors[node]
        while len(self.layers) <= level:
            self.layers.append({})
        if self.entry < 0:
            self.entry, self.top = node, level
            return
        best = self.descend(target, level)
        for layer in range(min(level, self.top), -1, -1):
            best = self.search(target, best, BREADTH_BUILD, layer)
            near = np.array([n for _, n in best], np.int32)
            likes = np.array([s for s, _ in best], np.float32)
            for other in self.spread_out(near, likes, LINKS).tolist():
                self.link(node, other, layer)
                self.link(other, node, layer)
        if level > self.top:
            self.entry, self.top = node, level

    def nearest(self, target: np.ndarray, breadth: int) -> np.ndarray:
        found = self.search(target, self.descend(target, 0), breadth, 0)
        return np.array([n for _, n in found], np.int64)


EMPTY = np.zeros(0, np.int32)


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors whose cosine with a query, lengthened by a zero, orders as the inner product."""
    squares = (vectors.astype(np.float64) ** 2).sum(axis=1)
    rest = np.sqrt(np.maximum(squares.max() - squares, 0))
    return (np.column_stack([vectors, rest]) / np.sqrt(squares.max())).astype(np.float32)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of lists of one length as a matrix of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def build(shard: pa.Table) -> pa.Table:
    """The rows of a shard as nodes: vector, ids, number, level, neighbours of each layer."""
    vectors = matrix(shard["vector"])
    rng = np.random.default_rng(len(vectors))
    levels = np.floor(-np.log(1 - rng.random(len(vectors))) / np.log(LINKS)).astype(np.int32)
    graph = Graph(lengthened(vectors), levels)
    for node in range(len(vectors)):
        graph.insert(node)
    flat = [
        [graph.neighbours(node, layer).tolist() for layer in range(int(levels[node]) + 1)]
        for node in range(len(vectors))
    ]
    return pa.table(
        {
            "size": shard["size"],
            "shard": shard["shard"],
            "node": pa.array(np.arange(len(vectors)), pa.int32()),
            "vector": shard["vector"],
            "ids": shard["ids"],
            "links": pa.array(flat, pa.list_(pa.list_(pa.int32()))),
        }
    )


def restored(nodes: pa.Table) -> tuple[Graph, np.ndarray, list[list[int]]]:
    """The graph, the original vectors and the ids of stored nodes."""
    nodes = nodes.sort_by("node")
    vectors = matrix(nodes["vector"])
    links = nodes["links"].to_pylist()
    graph = Graph(lengthened(vectors), np.array([len(own) - 1 for own in links]))
    graph.layers = [{} for _ in range(int(graph.levels.max()) + 1)]
    for node, own in enumerate(links):
        graph.low[node, : len(own[0])] = own[0]
        graph.low_count[node] = len(own[0])
        for layer, near in enumerate(own[1:], 1):
            graph.layers[layer][node] = np.array(near, np.int32)
    graph.entry = int(graph.levels.argmax())
    graph.top = int(graph.levels[graph.entry])
    return graph, vectors, nodes["ids"].to_pylist()


def searched(nodes: pa.Table, queries: pa.Table, k: int, breadth: int) -> pa.Table:
    """The best k + 1 ids of a shard for each query of a block."""
    out: dict[str, list] = {"key_a": [], "key_b": [], "vec_id": [], "score": []}
    if nodes.num_rows and queries.num_rows:
        graph, vectors, ids = restored(nodes)
        targets = matrix(queries["vector"])
        # All queries of the length of one; a zero for the added component.
        lengths = np.sqrt((targets**2).sum(axis=1))
        unit = np.column_stack([targets / lengths[:, None], np.zeros(len(targets))])
        keys = zip(queries["key_a"].to_pylist(), queries["key_b"].to_pylist(), strict=True)
        for (key_a, key_b), target, look in zip(keys, targets, unit.astype(np.float32), strict=True):
            near = graph.nearest(look, max(breadth, k + 1))
            scores = (vectors[near] * target).sum(axis=1)
            best = sorted(
                (-score, own) for score, n in zip(scores.tolist(), near.tolist()) for own in ids[n]
            )[: k + 1]
            out["key_a"] += [key_a] * len(best)
            out["key_b"] += [key_b] * len(best)
            out["vec_id"] += [own for _, own in best]
            out["score"] += [-score for score, _ in best]
    types = {"key_a": pa.int64(), "key_b": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
    return pa.table({name: pa.array(out[name], kind) for name, kind in types.items()})


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id``, ``vector``, ``size`` and the keys of the content, of vectors that take part."""
    vector = F.col("vector")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        vectors.select(
            vectors[id_column].cast("long").alias("vec_id"),
            vectors[vector_column].cast("array<double>").alias("vector"),
        )
        .filter(F.col("vec_id").isNotNull() & vector.isNotNull())
        .filter(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0))
        .select(
            "vec_id",
            "vector",
            F.size(vector).alias("size"),
            F.xxhash64(vector).alias("key_a"),
            F.xxhash64(vector, F.lit("b")).alias("key_b"),
        )
        .distinct()
    )


def shard_rows(count: int) -> int:
    return int(min(max(SHARD_FACTOR * count**0.5, SMALLEST), LARGEST))


def index(rows: DataFrame, k: int) -> tuple[DataFrame, int]:
    """The stored graph and the number of shards; ``rows`` as from ``usable``."""
    same = Window.partitionBy("size", "key_a", "key_b").orderBy("vec_id")
    # The limit on the rank is applied in each task before the shuffle, so that a vector with very
    # many copies brings k + 1 rows from each task.
    kept = rows.withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    distinct = settle(
        kept.groupBy("size", "key_a", "key_b").agg(
            F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids")
        ),
        "vectors",
    )
    count = distinct.count()
    shards = max(1, -(-count // shard_rows(count)))
    shard = F.pmod(F.xxhash64("key_a", F.lit("shard")), F.lit(shards)).cast("int")
    graph = (
        distinct.select("size", shard.alias("shard"), "vector", "ids")
        .groupBy("size", "shard")
        .applyInArrow(
            build,
            "size int, shard int, node int, vector array<double>, ids array<bigint>, "
            "links array<array<int>>",
        )
    )
    return settle(graph, "graph"), shards


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    breadth: int = BREADTH_SEARCH,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k nearest of each query row.

    ``is_query`` is an expression of ``vec_id``.
    """
    rows = settle(usable(vectors, id_column, vector_column), "usable")
    graph, shards = index(rows, k)
    queries = rows.filter(is_query)
    different = queries.groupBy("size", "key_a", "key_b").agg(F.first("vector").alias("vector"))
    different = settle(different, "queries")
    blocks = max(1, -(-different.count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("key_a", F.lit("block")), F.lit(blocks)).cast("int")
    place = ["size", "shard", "block"]
    left = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = different.withColumn("block", block).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )

    def run(nodes: pa.Table, own: pa.Table) -> pa.Table:
        return searched(nodes, own, k, breadth)

    found = (
        left.groupBy(*place)
        .cogroup(right.groupBy(*place))
        .applyInArrow(run, "key_a bigint, key_b bigint, vec_id bigint, score double")
    )
    # At most k + 1 rows from each shard come together for a query vector.
    order = Window.partitionBy("key_a", "key_b").orderBy(F.desc("score"), "vec_id")
    merged = (
        found.withColumn("nth", F.row_number().over(order))
        .filter(F.col("nth") <= k + 1)
        .groupBy("key_a", "key_b")
        .agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best"))
    )
    answered = queries.select(F.col("vec_id").alias("query_id"), "key_a", "key_b").join(
        merged, ["key_a", "key_b"]
    )
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("place", "hit")).select(
        "query_id",
        (F.col("place") + 1).alias("rank"),
        F.col("hit.vec_id").alias("vec_id"),
        F.col("hit.score").alias("score"),
    )
