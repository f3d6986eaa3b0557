"""Connected components of an undirected graph as alternating star joins (large star, small star).

No component gathers in one task: each round sends every edge once by an end, with partial
aggregation, and is written to the shared folder, so the lineage stays short. Joins are by sorting:
packed files of ids would pass the size check for a broadcast that takes many times their bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from scanloom.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return (
        both.hint("merge").join(least, "a")
        .filter(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    handed = down.hint("merge").join(least, "a").filter(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return handed.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for the nodes of ``edges`` (``a``, ``b``) that
    are not the smallest of their component; loops and repeated edges do no harm."""
    edges = stage(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        now = tuple(
            edges.agg(
                F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).cast("string")
            ).first()
        )
        if now == before or now[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        edges = stage(_small_star(_large_star(edges)), "edges")
