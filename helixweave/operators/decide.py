"""Decisions about reads from their chains (read, chain, score, anchors)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixweave.functions.bits import mapq

def rank_window():
    return Window.partitionBy("read").orderBy(F.desc("score"), "chain")


def ranked(chains: DataFrame, ratio: float = 0.3, most: int = 10) -> DataFrame:
    """The best chains of each read: at most `most`, and not below ratio of the best."""
    top = chains.withColumn("rank", (F.row_number().over(rank_window()) - 1).cast("long")).where(F.col("rank") < most)
    best = F.max("score").over(Window.partitionBy("read"))
    return top.withColumn("best", best).where(F.col("score") >= ratio * F.col("best")).drop("best")


def with_mapq(chains: DataFrame) -> DataFrame:
    """chains with mapq: the next chain's score counts as the second."""
    second = F.coalesce(F.lead("score").over(rank_window()), F.lit(0.0))
    return chains.withColumn("second", second).withColumn("mapq", mapq(F.col("score"), F.col("second"), F.col("anchors"))).drop("second")


def standout(chains: DataFrame) -> DataFrame:
    """read, n_chains, best score and mapq, anchors, standout (how far the best is above the mean)."""
    agg = chains.groupBy("read").agg(F.count("*").alias("n_chains"), F.avg("mapq").alias("mq"), F.avg("score").alias("mc"),
                                     F.max_by(F.struct("score", "mapq", "anchors", "chain"), F.struct("score", -F.col("chain"))).alias("b"))
    q, c = F.col("b.mapq").cast("double"), F.col("b.score")
    above = lambda mean, x: F.when(x > 0, F.greatest(F.lit(0.0), 1.0 - mean / x)).otherwise(0.0)
    value = 0.35 * F.least(q / 30.0, F.lit(1.0)) + 0.05 * above(F.col("mq"), q) + 0.6 * above(F.col("mc"), c)
    return agg.select("read", "n_chains", F.col("b.chain").alias("chain"), c.alias("score"), F.col("b.mapq").alias("mapq"), F.col("b.anchors").alias("anchors"), value.alias("standout"))


def decided(best: DataFrame, threshold: float = 0.45, min_anchors: int = 5, floor: float = 100.0) -> DataFrame:
    """best with decision: G one chain with enough anchors, S stands out, F above the fallback floor, U unmapped."""
    return best.withColumn("decision", F.when((F.col("n_chains") == 1) & (F.col("anchors") >= min_anchors), "G").when(
        (F.col("n_chains") > 1) & (F.col("standout") >= threshold), "S").when((F.col("n_chains") > 1) & (F.col("score") >= floor), "F").otherwise("U"))
