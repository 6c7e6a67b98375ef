"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over distinct edges (x > y). Large: every larger neighbour of a node is tied to the smallest of its
    neighbourhood; small: every smaller one. Minima are found by partial aggregation and joined back, so that
    a hub's edges never have to meet in one task."""
    both = edges.select(F.col("x").alias("n"), F.col("y").alias("v"))
    if large:
        both = both.union(edges.select(F.col("y").alias("n"), F.col("x").alias("v")))
    least = both.groupBy("n").agg(F.min("v").alias("m")).withColumn("m", F.least("n", "m"))
    met = both.join(least, "n")
    if large:
        out = met.where("v > n").select(F.col("v").alias("x"), F.col("m").alias("y"))
    else:
        out = met.select(F.col("v").alias("x"), F.col("m").alias("y")).union(least.select(F.col("n").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of `edges` (x, y: long); component is the smallest node reachable.

    Loops and repeated or reversed edges don't matter; no edges give no rows. Each round is a written table; the
    number of rounds grows with the logarithm of the longest path, and only two numbers a round reach the driver."""
    now = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct()
    now, seen = scratch.keep(now), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        after, seen = scratch.keep(_star(_star(now, True), False)), mark
        scratch.drop(now)
        now = after
    return now.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("component")).union(now.select("y", "y").distinct())


def joined(tied: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) after `edges` (x, y) are added to a graph whose components are `tied`, a kept table. Only edges between different
    components are looked at, as edges of components; where there are none, `tied` is returned."""
    own = lambda c: tied.select(F.col("node").alias(c), F.col("component").alias(f"{c}_to"))
    new = edges.join(own("x"), "x", "left").join(own("y"), "y", "left")
    new = scratch.keep(new.select(F.coalesce("x_to", "x").alias("x"), F.coalesce("y_to", "y").alias("y")).where("x <> y").distinct())
    if not new.take(1):
        return tied
    moved = scratch.keep(components(new, scratch))
    to = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    before = tied.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return scratch.keep(before.union(moved.join(tied, "node", "left_anti").select("node", "component")))
