"""Connected components of links, distributed.

Each round replaces every node's links by links to the smallest node that it or
a neighbour knows, until each component is a star around its smallest node; the
rounds grow with the logarithm of a component's width. No node's links are ever
gathered: minima are aggregated before the shuffle, and what meets a hot node in
a join is one row a link, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize, release

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    found = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return found["n"], int(found["h"])


def components(links: DataFrame) -> DataFrame:
    """links: a, b of one orderable type, any order, repeats allowed. Returns (node, root): every linked node but the roots, and the smallest node that it reaches."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "links")
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        new = both.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b")
        own = least.where("a <> least").select("a", F.col("least").alias("b"))
        last, edges = edges, materialize(new.unionByName(own).distinct(), "links")
        release(last)
        after = _state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
