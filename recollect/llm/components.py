"""Connected components of a graph given as a table of links, by hooking and contraction.

In each round, every node hooks to its least neighbour if that is less than itself. A node that
neither hooks nor is hooked to hooks to its least neighbour all the same: that one is greater and
has hooked elsewhere, so no ring arises, and each tree holds two nodes or more. Pointers then jump
until nothing moves, and trees become single nodes. So each round at least halves the nodes, and
a chain of n links takes one round of log2(n) jumps if its ids rise or fall.

Nothing is collected: the driver only learns whether something is left to do. Each step writes
its table to the shared folder, so lost executors cost one step's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import release, stored


def _over(up: DataFrame) -> DataFrame:
    return up.select(F.col("node").alias("mid"), F.col("up").alias("top"))


def _hooked(edges: DataFrame) -> DataFrame:
    """node and up for each node of the links (a < b)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # partial minima leave the map side, so a node with very many links sends few rows
    least = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")), "least")
    targets = least.where("least < node").select(F.col("least").alias("target")).distinct()
    rows = least.join(targets, F.col("node") == F.col("target"), "left")
    up = stored(rows.select("node", F.when((F.col("least") < F.col("node")) | F.col("target").isNull(), F.col("least")).otherwise(F.col("node")).alias("up")), "up")
    release(least)
    return up


def _jumped(up: DataFrame) -> DataFrame:
    """Every node at its tree's root."""
    while True:
        over = _over(up)
        next_ = stored(up.join(over, up["up"] == over["mid"], "left").select("node", F.coalesce("top", "up").alias("up"), F.coalesce(F.col("top") != F.col("up"), F.lit(False)).alias("moved")), "up")
        release(up)
        if next_.where("moved").isEmpty():
            return next_
        up = next_.select("node", "up")
        up._recollect_path = next_._recollect_path


def components(links: DataFrame) -> DataFrame:
    """links: columns a, b (long). Returns node, component: each linked node with the least node it reaches.

    Loops and repeated links are allowed; a link with a null end links nothing. A node without a
    link to another has no row; an empty table gives an empty result.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label: DataFrame | None = None
    while not edges.isEmpty():
        up = _jumped(_hooked(edges))
        a, b = up.select(F.col("node").alias("na"), F.col("up").alias("ua")), up.select(F.col("node").alias("nb"), F.col("up").alias("ub"))
        moved = edges.join(a, edges["a"] == a["na"]).join(b, edges["b"] == b["nb"]).where("ua <> ub")
        fewer = stored(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        if label is None:
            label = up
        else:
            over = _over(up)
            newer = stored(label.join(over, label["up"] == over["mid"], "left").select("node", F.coalesce("top", "up").alias("up")), "label")
            release(label)
            release(up)
            label = newer
        release(edges)
        edges = fewer
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = label.groupBy(F.col("up").alias("root")).agg(F.min("node").alias("component"))
    return label.join(least, F.col("up") == F.col("root")).select("node", "component")
