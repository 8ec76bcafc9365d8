"""Hits of seeds as anchors on paths: expansion, merging, and pairs that share a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def expanded(hits: DataFrame, lin: DataFrame, lengths: DataFrame) -> DataFrame:
    """hits: read, node, offset, q, span. One anchor (read, path, ref, q, span) for each step of a path on the node; anchors that begin before or end after their path are left out."""
    at = hits.join(lin.select("node", "path", "coord"), "node").join(lengths.select("path", "length"), "path")
    ref = F.col("coord") + F.col("offset")
    return at.where((ref >= 0) & (ref + F.col("span") <= F.col("length"))).select("read", "path", ref.alias("ref"), "q", "span")


def within(a: Column, b: Column, tolerance: int) -> Column:
    return (F.greatest(b["q"] - (a["q"] + a["span"]), F.lit(0)) <= tolerance) & (F.greatest(b["offset"] - (a["offset"] + a["length"]), F.lit(0)) <= tolerance)


def joined(a: Column, b: Column) -> Column:
    """One hit that covers both; spans end at 65,535."""
    first = F.least(a["q"], b["q"])
    span = F.least(F.greatest(a["q"] + a["span"], b["q"] + b["span"]) - first, F.lit(65_535))
    length = F.least(F.greatest(a["offset"] + a["length"], b["offset"] + b["length"]) - a["offset"], F.lit(65_535))
    return F.struct(a["offset"].alias("offset"), first.cast("long").alias("q"), span.cast("long").alias("span"), length.cast("long").alias("length"))


def merged(hits: DataFrame, tolerance: int, keys: tuple[str, ...] = ("read", "node")) -> DataFrame:
    """keys, offset, q, span, length (all long): hits of a node in order of (offset, q), each taken into the one before while the gaps on both sides are within the tolerance (overlaps count as none).

    The hits of one key are one row: bounded by a read's seeds on one node.
    """
    rows = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("offset", "q", "span", "length"))).alias("h"))

    def step(out: Column, x: Column) -> Column:
        last = F.element_at(out, -1)
        return F.when(within(last, x, tolerance), F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), joined(last, x))).otherwise(F.array_append(out, x))

    return rows.select(*keys, F.inline(F.aggregate(F.slice("h", F.lit(2), F.size("h") - 1), F.slice("h", 1, 1), step)))


def shared_paths(anchors: DataFrame) -> DataFrame:
    """read, q, next_q, paths: in how many paths two seeds that follow each other on a read both lie."""
    on = anchors.select("read", "q", "path").distinct()
    follow = on.select("read", "q").distinct().withColumn("next_q", F.lead("q").over(Window.partitionBy("read").orderBy("q"))).where("next_q is not null")
    both = follow.join(on, ["read", "q"]).join(on.select("read", F.col("q").alias("next_q"), "path"), ["read", "next_q", "path"])
    return both.groupBy("read", "q", "next_q").agg(F.count("*").alias("paths"))


def reciprocal_overlap(a: Column, b: Column) -> Column:
    """Of intervals (start, end): the overlap's share of the longer one; 0 if they don't meet or one has no length."""
    over = F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"])
    return F.when(over > 0, over / F.greatest(a["end"] - a["start"], b["end"] - b["start"])).otherwise(0.0)


def distinct_intervals(chains: DataFrame, overlap: float = 0.8) -> DataFrame:
    """chains: read, chain, score, component, start, end. In order of chain, one that overlaps a kept one of its component that far takes its place if it scores higher, and else goes."""
    rows = chains.groupBy("read").agg(F.sort_array(F.collect_list(F.struct("chain", "score", "component", "start", "end"))).alias("c"))

    def step(kept: Column, x: Column) -> Column:
        same = F.transform(kept, lambda k: (k["component"] == x["component"]) & (reciprocal_overlap(k, x) >= overlap))
        at = F.array_position(same, True)  # the first
        placed = F.transform(kept, lambda k, i: F.when((i + 1 == at) & (x["score"] > k["score"]), x).otherwise(k))
        return F.when(at == 0, F.array_append(kept, x)).otherwise(placed)

    return rows.select("read", F.inline(F.aggregate(F.slice("c", F.lit(2), F.size("c") - 1), F.slice("c", 1, 1), step))).select("read", "chain", "score")
