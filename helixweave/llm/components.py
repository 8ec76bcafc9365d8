"""Connected components of a table of links: roots hook to their smallest neighbour, chains of roots are cut short, links move to the roots, until none is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Staging

#: Rounds halve the roots at least every second time, so 2 * 63 are never reached by distinct longs.
ROUNDS, JUMPS = 126, 64


def components(links: DataFrame, stage: Staging | None = None, name: str = "components") -> DataFrame:
    """links: a, b (long). Result: node, label (the smallest node of its component), for every node of a link.

    Each round is a written table in the shared folder, deleted when the next one stands. A round links every root to
    its smallest neighbour, follows these to their ends by doubling, and keeps only links between different roots:
    what is left shrinks by a factor whatever the length of chains. A hub's links meet in partial minima or in joins
    that the planner may split.
    """
    stage = stage or Staging(links.sparkSession)
    put = lambda df, what: stage.put(df, f"{name}/{what}", free=False)
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = put(both.where("a <> b").distinct(), "links")
    labels = None
    for k in range(ROUNDS):
        roots = put(both.groupBy(F.col("a").alias("root")).agg(F.least("root", F.min("b")).alias("to")), f"{k}-0")
        for j in range(1, JUMPS):
            beyond = roots.select(F.col("root").alias("to"), F.col("to").alias("beyond"))
            new = put(roots.join(beyond, "to").select("root", F.col("beyond").alias("to"), (F.col("beyond") < F.col("to")).alias("moved")), f"{k}-{j}")
            stage.drop(roots)
            roots = new
            if new.where("moved").isEmpty():
                break
        else:
            raise RuntimeError(f"components: chains of roots didn't end after {JUMPS} doublings")
        old = labels
        if labels is None:
            labels = put(roots.select(F.col("root").alias("node"), F.col("to").alias("label")), f"labels{k}")
        else:
            moved = roots.select(F.col("root").alias("label"), "to")
            labels = put(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), f"labels{k}")
            stage.drop(old)
        left = both.join(roots.select(F.col("root").alias("a"), F.col("to").alias("x")), "a").join(roots.select(F.col("root").alias("b"), F.col("to").alias("y")), "b")
        moved = put(left.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"links{k}")
        stage.drop(both, roots)
        both = moved
        if both.isEmpty():
            stage.drop(both)
            return labels
    raise RuntimeError(f"components: links were left after {ROUNDS} rounds")
