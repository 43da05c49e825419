"""Connected components of a graph of document ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Rounds grow with the logarithm of a component's size; more than these would be a fault.
ROUNDS = 200
#: Parts that the neighbours of a node are dealt to.
PARTS = 16


def _least(edges: DataFrame) -> DataFrame:
    """For each node with larger neighbours, the least among itself and all its neighbours."""
    up = edges.select(F.col("a").alias("n"), F.col("b").alias("m"), F.lit(False).alias("head"))
    down = edges.select(F.col("b").alias("n"), F.col("a").alias("m"), F.lit(True).alias("head"))
    return up.unionByName(down).groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least"), F.max("head").alias("head")).filter("head").drop("head")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); the component is its least node.

    In a round, each node's larger neighbours are linked to its least neighbour, then
    its smaller ones and itself.  Least neighbours are aggregated before the shuffle and
    joined back to a node's neighbours in PARTS parts, as a node may have very many.
    Edges from a node to itself and null ends are dropped; no edges give no rows.  What
    has not settled after ROUNDS rounds is an error, never a result."""
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    seen = None
    for _ in range(ROUNDS + 1):
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        spread = _least(edges).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        dealt = edges.select("a", F.col("b").alias("n"), F.pmod(F.xxhash64("a"), F.lit(PARTS)).cast("int").alias("part"))
        large = dealt.join(spread, ["n", "part"]).select("a", F.col("least").alias("b")).filter("a > b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = written(large.join(small, "a").select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y")))).alias("e")).select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).filter("a > b").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return found.unionByName(roots)
