"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, cut_table

#: Rounds that hook by the smallest node itself; later ones hook by a hash, which also shortens sorted chains.
PLAIN_ROUNDS = 2


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of all nodes of edges (a, b longs), component being its smallest node; a table, in scratch if given.

    Each round hooks every node to its least neighbour (or itself), follows the pointers once more
    and contracts the edges. Links between near-duplicates are mostly stars around small nodes, which
    one round settles; from the third round on neighbours are compared by hash, so chains of falling
    hashes, and with them the rounds, are logarithmic in the number of nodes whatever their order.
    Hot nodes meet only map-side combined minima and joins that the engine can split.
    Self-loops keep their node; an empty table gives an empty table; nulls are dropped.
    """
    with Scratch(edges.sparkSession, "components") as own:
        cut = own.table
        live = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
        left, path, turn = cut(live), None, 0
        while path is None or not left.isEmpty():
            rank = (lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))) if turn >= PLAIN_ROUNDS else (lambda c: F.struct(F.lit(0).alias("h"), F.col(c).alias("n")))
            both = left.union(left.select("b", "a"))
            hook = cut(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("v"), F.least("m", rank("a"))["n"].alias("p")))
            far = hook.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jump = cut(hook.join(far, "p").select("v", "q"))
            if path is None:
                path = jump.select(F.col("v").alias("node"), F.col("q").alias("at"))
            else:
                path = path.join(jump.withColumnRenamed("v", "at"), "at", "left").select("node", F.coalesce("q", "at").alias("at"))
            step = left.join(jump.withColumnRenamed("v", "a"), "a").select(F.col("q").alias("a"), "b")
            step = step.join(jump.withColumnRenamed("v", "b"), "b").select("a", F.col("q").alias("b"))
            left = cut(step.where("a <> b").distinct())
            turn += 1
        # under plain hooks the last pointer is the smallest node
        out = path.select("node", F.col("at").alias("component"))
        if turn > PLAIN_ROUNDS:
            least = path.groupBy("at").agg(F.min("node").alias("component"))
            out = path.join(least, "at").select("node", "component")
        return scratch.table(out) if scratch else cut_table(out, "components")
