"""Connected components of an edge table by contraction towards smaller ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.plans.storage import materialise


def _roots(edges: DataFrame, most_rounds: int) -> DataFrame:
    """(v, root): every vertex points to its smallest neighbour below it; pointers are doubled until they end in roots."""
    up = edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("up"))  # a < b, so pointers only fall
    at = materialise(up, "cc-up")
    for _ in range(most_rounds):
        nxt = at.select(F.col("v").alias("at"), F.col("up").alias("top"))
        jumped = at.join(nxt, at.up == nxt.at, "left").select("v", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
        jumped = materialise(jumped, "cc-up")
        if jumped.filter("moved").isEmpty():
            return at.select("v", F.col("up").alias("root"))
        at = jumped.select("v", "up")
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 64) -> DataFrame:
    """(id, component) of every vertex of ``edges``, component being the smallest id in it.

    Each round merges every vertex that has a smaller neighbour into the root of its pointers, then relabels the
    edges, drops those within a root and repeats of others: a component's edges shrink round by round, and a
    chain of any length folds in one round. Minima are partial before each shuffle, so a hub's
    edges do not meet in one task; every round is written to the shared folder.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    labels = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("id"), F.col("a").alias("component"))
    left = pairs.filter("a <> b")
    for _ in range(most_rounds):
        if left.isEmpty():
            return labels
        root = _roots(left, most_rounds)
        labels = materialise(labels.join(root, labels.component == root.v, "left").select("id", F.coalesce("root", "component").alias("component")), "cc-labels")
        ra, rb = root.select(F.col("v").alias("a"), F.col("root").alias("ra")), root.select(F.col("v").alias("b"), F.col("root").alias("rb"))
        new = left.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")).filter("x <> y")
        left = materialise(new.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc-edges")
    raise RuntimeError("components did not settle")
