"""Connected components of a link table by repeated hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermalcube.session import checkpointed

#: Links that a task takes; Spark would write a shuffle file for each of its partitions, however few they are.
LINKS_AT_ONCE = 1 << 13


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) of every node of a link, root the smallest node reachable.

    Each round hangs every node below its smallest neighbour, shortens the paths until all nodes hang at
    roots, and puts links of roots in place of links, those within a tree and repeated ones left out. A
    tree has two nodes at least, so a round halves the nodes that have links; paths are shortened in
    steps that grow with the logarithm of their length. So most links are read in the first round only.
    Every step is one checkpoint in the shared folder; the driver sees one row of it. Tasks are as many
    as the links ask for. Links with a null end and links of a node to itself are left aside.
    """
    pairs = _distinct(links.select(F.col(left).alias("u"), F.col(right).alias("v")))
    tasks = pairs.count() // LINKS_AT_ONCE + 1
    pairs = pairs.coalesce(tasks)
    placed = None
    while pairs.take(1):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")).select("u", "p")
        parents = _shortened(checkpointed(hooked.coalesce(tasks)), tasks)
        if placed is None:
            placed = parents
        else:
            above = parents.select(F.col("u").alias("p"), F.col("p").alias("g"))
            placed = checkpointed(placed.join(above, "p", "left").select("u", F.coalesce("g", "p").alias("p")).coalesce(tasks))
        lifted = pairs.join(parents, "u").select("v", F.col("p").alias("u")).coalesce(tasks)
        lifted = lifted.join(parents.withColumnRenamed("u", "v"), "v").select("u", F.col("p").alias("v"))
        pairs = _distinct(lifted.coalesce(tasks)).coalesce(tasks)
    if placed is None:
        return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return placed.select(F.col("u").alias("node"), F.col("p").alias("root"))


def _distinct(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) of different nodes once, the smaller one first."""
    ordered = pairs.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return checkpointed(ordered.distinct())


def _shortened(parents: DataFrame, tasks: int) -> DataFrame:
    """(u, p) with p the root of the tree of u, from parents p that are smaller than u or, of a root, u itself."""
    while True:
        above = parents.select(F.col("u").alias("p"), F.col("p").alias("g"))
        lifted = parents.join(above, "p").select("u", F.col("g").alias("p"), (F.col("g") < F.col("p")).alias("moved"))
        step = checkpointed(lifted.coalesce(tasks))
        parents = step.select("u", "p")
        if not step.filter("moved").take(1):
            return parents
