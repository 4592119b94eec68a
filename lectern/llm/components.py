"""Connected components by alternating large-star and small-star steps.

Each step points nodes at the least neighbour they know, so that a component ends
as one star around its least node after about log(size) steps. All of it is grouped
minima, which combine before the shuffle, and joins, whose hot hubs adaptive
execution splits; nothing is gathered in one place. Steps end as soon as only stars
are left, and edges found later are taken between stars, not between their nodes:
what the driver keeps of a run grows with the number of its plans and tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def _all_stars(edges: DataFrame) -> bool:
    """Whether each node that has a lesser one, of edges (greater, lesser), has no other edge."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("greater")).union(
        edges.select("b", F.lit(0))
    )
    several = ends.groupBy("node").agg(F.sum("greater").alias("greater"), F.count("*").alias("n"))
    return several.where("greater > 0 AND n > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """`node` and `component`, its least node, for every end of the edges (a, b).

    Loops and repeated edges do no harm.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stored(down.distinct(), "cc-edges")
    while not _all_stars(current):
        current = stored(_small_star(_large_star(current)).where("a <> b").distinct(), "cc-edges")
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return leaves.union(roots)


def joined_components(found: DataFrame, edges: DataFrame) -> DataFrame:
    """What `components` gives for the edges of `found` and further ones together.

    Ends that `found` doesn't have are components of their own so far.
    """
    root = lambda end: F.coalesce(F.col(f"of_{end}"), F.col(end)).alias(end)
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    ends = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(root("a"), root("b"))
    moved = components(ends).toDF("component", "least")
    fresh = edges.select("a").union(edges.select("b")).distinct().toDF("node").join(found, "node", "left_anti")
    every = found.union(fresh.select("node", F.col("node").alias("component")))
    least = F.coalesce("least", "component").alias("component")
    return stored(every.join(moved, "component", "left").select("node", least), "cc-joined")
