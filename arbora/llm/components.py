"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, durable


def _star(pairs: DataFrame, keep: Scratch) -> DataFrame:
    """(u, v) -> the same with m, the least of u and its neighbours.

    The minima are kept as a table: its size decides between a broadcast and a join whose hot
    partitions adaptive execution splits.
    """
    return pairs.join(keep(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))), "u")


def _large(edges: DataFrame, keep: Scratch) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both, keep).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame, keep: Scratch) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _star(down, keep)
    return stars.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(stars.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (u, v) of comparable ids -> (node, component), the least id reachable, for every node of an edge.

    Each round is two grouped minima joined back to the edges, so a hub's neighbours are never
    gathered in one place. The number of rounds
    grows with the logarithm of the longest chain; each round is written to the checkpoint folder and
    removed after the next. An edge with a null end is left out, loops and repeated edges change
    nothing, and no edges give no rows.
    """
    digest = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))]
    with Scratch(edges.sparkSession, "components") as keep:
        edges = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        before = edges.agg(*digest).first()
        for _ in range(max_rounds):
            if not before[0]:
                break
            edges = keep(_small(_large(edges, keep), keep).distinct())
            keep.drop(before=1)
            after = edges.agg(*digest).first()
            if tuple(after) == tuple(before):
                break
            before = after
        else:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
        # stars now: every v is a root
        return durable(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
