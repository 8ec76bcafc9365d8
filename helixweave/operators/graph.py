"""Strand expansion, linear coordinates and components of path-annotated graphs."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixweave.functions.bits import revcomp
from helixweave.store import fresh_folder, row_numbers, written


def expand_nodes(nodes: DataFrame) -> DataFrame:
    """Two directed nodes of each segment: 2 ord forward, 2 ord + 1 reverse."""
    sides = F.array(F.struct((F.col("ord") * 2).alias("node_id"), F.col("seq")), F.struct((F.col("ord") * 2 + 1).alias("node_id"), revcomp(F.col("seq")).alias("seq")))
    return nodes.select("len", F.explode(sides).alias("x")).select("x.node_id", "x.seq", "len")


def directed(steps: DataFrame) -> DataFrame:
    """path, step, node_id of the forward walks."""
    return steps.select("path", "step", (F.col("node") * 2 + F.col("rev").cast("long")).alias("node_id"))


def links(steps: DataFrame) -> DataFrame:
    """u, v: directed nodes that follow each other on a path."""
    w = Window.partitionBy("path").orderBy("step")
    return directed(steps).select(F.col("node_id").alias("u"), F.lead("node_id").over(w).alias("v")).where("v is not null").distinct()


def expand_edges(edges: DataFrame) -> DataFrame:
    """Each edge and its mirror image, once."""
    both = F.array(F.struct("u", "v"), F.struct(F.col("v").bitwiseXOR(1).alias("u"), F.col("u").bitwiseXOR(1).alias("v")))
    return edges.select(F.explode(both).alias("x")).select("x.u", "x.v").distinct()


def expand_paths(steps: DataFrame) -> DataFrame:
    """path_id 2p forward, 2p + 1 the same walk backwards on the other strand."""
    last = F.max("step").over(Window.partitionBy("path"))
    sides = F.array(F.struct((F.col("path") * 2).alias("path_id"), F.col("step"), F.col("node_id")),
                    F.struct((F.col("path") * 2 + 1).alias("path_id"), (F.col("last") - F.col("step")).alias("step"), F.col("node_id").bitwiseXOR(1).alias("node_id")))
    return directed(steps).withColumn("last", last).select(F.explode(sides).alias("x")).select("x.*")


def linearized(steps: DataFrame, lengths: DataFrame) -> DataFrame:
    """path, step, node, coord: bases before each step. lengths: ord, len; steps on unknown nodes drop out."""
    w = Window.partitionBy("path").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    known = steps.join(lengths.select(F.col("ord").alias("node"), "len"), "node")
    return known.select("path", "step", "node", "rev", "len", F.coalesce(F.sum("len").over(w), F.lit(0)).alias("coord"))


def path_lengths(lin: DataFrame, k: int) -> DataFrame:
    """Bases of each path; 0 for paths shorter than k, whose anchors are never expanded."""
    total = F.sum("len")
    return lin.groupBy("path").agg(F.count("*").alias("n_steps"), F.when(total >= k, total).otherwise(0).alias("length"))


def path_sequences(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """path, seq: the bases along each path."""
    known = steps.join(nodes.select(F.col("ord").alias("node"), "seq"), "node")
    side = F.when(F.col("rev"), revcomp(F.col("seq"))).otherwise(F.col("seq"))
    ordered = F.sort_array(F.collect_list(F.struct("step", side.alias("s"))))
    return known.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "").alias("seq"))


def components(edges: DataFrame) -> DataFrame:
    """node, label (smallest node of its component) of a table of links u, v. Labels move to neighbours and on to the
    label's label until none changes; each round is a written table, so plans stay short and survive lost executors."""
    where = fresh_folder(edges.sparkSession, "components")
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{where}/links")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("label"))
    for k in itertools.count():
        seen = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("seen"))
        low = labels.join(seen, "node").select("node", "label", F.least("label", "seen").alias("low"))
        beyond = labels.select(F.col("node").alias("low"), F.col("label").alias("beyond"))
        new = low.join(beyond, "low", "left").select("node", F.least("low", "beyond").alias("label"), (F.least("low", "beyond") < F.col("label")).alias("moved"))
        new = written(new, f"{where}/{k}")
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            return labels


def numbered(labels: DataFrame) -> DataFrame:
    """node, component: 0 for the largest, ties by smallest node."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    return labels.join(row_numbers(sizes, [F.desc("size"), F.asc("label")], "component"), "label").select("node", "component", "size")


def path_links(steps: DataFrame) -> DataFrame:
    """u, v: segments that follow each other on a path, strands aside; a path of one step links its segment to itself."""
    w = Window.partitionBy("path").orderBy("step")
    return steps.select(F.col("node").alias("u"), F.coalesce(F.lead("node").over(w), F.col("node")).alias("v")).distinct()


def zero_based(layout: DataFrame, labels: DataFrame) -> DataFrame:
    """node, label, x less the smallest x of the node's component."""
    at = layout.join(labels, "node")
    low = at.groupBy("label").agg(F.min("x").alias("low"))
    return at.join(low, "label").select("node", "label", (F.col("x") - F.col("low")).alias("x"))


def initial_layout(nodes: DataFrame, steps: DataFrame | None = None, lin: DataFrame | None = None) -> DataFrame:
    """node, x to start a layout with: with lin, the place on the smallest path that holds the node; else segments one after another in order of ord."""
    if lin is not None:
        return lin.groupBy("node").agg(F.min_by("coord", F.struct("path", "step")).cast("double").alias("x"))
    w = Window.partitionBy("block").orderBy("ord")
    # running sums by blocks of ordinals: what meets in one task is a sum for each block
    cut = nodes.select("ord", "len", F.floor(F.col("ord") / 100_000).alias("block"))
    sums = cut.groupBy("block").agg(F.sum("len").alias("s"))
    base = sums.select("block", (F.sum("s").over(Window.orderBy("block")) - F.col("s")).alias("base"))
    return cut.withColumn("own", F.sum("len").over(w) - F.col("len")).join(F.broadcast(base), "block").select(F.col("ord").alias("node"), (F.col("own") + F.col("base")).cast("double").alias("x"))


def learning_rates(spark, rounds: int, largest: float, least: float, peak_at: int = 0):
    """round, rate: exponential decay on both sides of the round with the largest rate."""
    decay = math.log(largest / least) / max(rounds - 1, 1)
    return spark.range(rounds).select(F.col("id").alias("round"), (F.lit(largest) * F.exp(-decay * F.abs(F.col("id") - peak_at))).alias("rate"))


def sampling_index(lin: DataFrame) -> DataFrame:
    """path, rank, node, coord of the forward steps of each path in order of coord: what layouts draw pairs from."""
    order = Window.partitionBy("path").orderBy("coord", "step")
    return lin.where("not rev").select("path", (F.row_number().over(order) - 1).cast("long").alias("rank"), "node", "coord")
