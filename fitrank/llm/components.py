"""Connected components of an edge table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitrank.llm.scratch import settle


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for the nodes of ``a``-``b`` edges.

    Each round gives every node the smallest root of its neighbours and then the root of its root,
    so far nodes come together in few rounds.  Every round is written and read back; the driver sees
    one count.  The sums by node are partly made before the shuffle, and a node with very many edges
    is left to adaptive skew handling of the joins.
    """
    both = settle(
        edges.select(F.col("a").alias("near"), F.col("b").alias("node"))
        .unionAll(edges.select(F.col("b").alias("near"), F.col("a").alias("node")))
        .distinct(),
        "edges",
    )
    roots = settle(
        both.groupBy("node").agg(F.min("near").alias("near")).select(
            "node", F.least("node", "near").alias("root")
        ),
        "roots",
    )
    while True:
        offered = (
            both.join(roots.withColumnRenamed("node", "near"), "near")
            .groupBy("node")
            .agg(F.min("root").alias("offer"))
        )
        lower = roots.join(offered, "node").select(
            "node", "root", F.least("root", "offer").alias("next")
        )
        jump = roots.select(F.col("node").alias("next"), F.col("root").alias("top"))
        stepped = settle(
            lower.join(jump, "next").select("node", "root", F.least("next", "top").alias("next")),
            "roots",
        )
        changed = stepped.filter(F.col("root") != F.col("next")).limit(1).count()
        roots = stepped.select("node", F.col("next").alias("root"))
        if not changed:
            return roots
