"""Connected components as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.scratch import materialize, release


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and its neighbours; a hub's rows stay spread, as AQE splits the join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    return linked.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): each node of an edge with the least node it reaches.

    Alternates large-star and small-star, so rounds grow with the logarithm of the
    graph and hubs are never gathered. Each round is a written table. Self-loops
    name their node as its own component; null ends are ignored; edge direction
    and repeats don't matter. No edges: no rows.
    """
    given = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = materialize(given.distinct(), "edges")
    pairs, before = nodes.where("u <> v"), None
    while True:
        last, pairs = pairs, materialize(_small_star(_large_star(pairs).distinct()).distinct(), "star")
        release(last)
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    loops = nodes.where("u = v").select(F.col("u").alias("node"))
    alone = loops.join(pairs.select(F.col("u").alias("node")), "node", "left_anti")
    roots = pairs.select(F.col("v").alias("node")).distinct()
    every = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    single = roots.union(alone).distinct().select("node", F.col("node").alias("component"))
    return every.unionByName(single)
