"""Connected components of an undirected graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return r[0], r[1]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node of
    its component.  ``edges`` has two non-null columns ``a`` and ``b`` of the
    same ordered type; loops and repeated edges are ignored.

    Alternates the two star steps: a node first links its larger neighbours to
    the smallest node it knows, then its smaller neighbours and itself.  Each
    step is an aggregation by node (pre-aggregated before the shuffle),
    written, and a join back onto the edges, in which Spark can split a hot
    node; no step gathers the neighbours of a node.  The edge set shrinks to
    one edge per node."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = scratch.put(edges, "edges")
    state = _state(cur)
    while True:
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.put(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        step = scratch.put(large, "large")
        down = scratch.put(step.groupBy("a").agg(F.min("b").alias("m")), "down")
        small = step.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt = scratch.put(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "small")
        now = _state(nxt)
        scratch.drop(cur, low, step, down)
        cur = nxt
        if now == state:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
