"""Colinear chaining of anchors: candidate pairs, their scores, and the exact dynamic programme by group."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChainConfig:
    max_dist: int = 2500
    band: int = 500
    gap: float = 0.8
    skip: float = 0.0
    min_score: float = 15.0
    min_anchors: int = 2
    secondary_ratio: float = 0.3
    max_chains: int = 10
    #: Share of a link's length that its two distances may differ by without a penalty; penalty for leaving the chain's slope.
    tolerance: float = 0.0
    slope: float = 0.0

    def scaled(self, k: int) -> ChainConfig:
        """Penalties for each base become penalties for each k-mer."""
        return replace(self, gap=self.gap * 0.01 * k, skip=self.skip * 0.01 * k)


def link_score(span: Column, dr: Column, dq: Column, cfg: ChainConfig) -> Column:
    """Score of following an anchor of this span after distances dr and dq."""
    dg, dd = F.least(dr, dq), F.abs(dr - dq)
    cost = F.floor(cfg.gap * dd + cfg.skip * dg + F.when(dd >= 1, 0.5 * F.log2(dd + 1)).otherwise(0.0))
    return (F.least(span, dg) - F.when((dd != 0) | (dg > span), cost).otherwise(0)).cast("long")


def band_pairs(anchors: DataFrame, cfg: ChainConfig, group: str = "grp") -> DataFrame:
    """Pairs of a group's anchors in reach: an equi-join on bins of max_dist and the bin before, then the band."""
    a = anchors.select(group, F.col("ref").alias("ri"), F.col("q").alias("qi"), F.floor(F.col("ref") / cfg.max_dist).alias("bin"))
    b = anchors.select(group, F.col("ref").alias("rj"), F.col("q").alias("qj"), F.col("span").alias("sj"),
                       F.explode(F.array(F.floor(F.col("ref") / cfg.max_dist), F.floor(F.col("ref") / cfg.max_dist) + 1)).alias("bin"))
    dr, dq = F.col("ri") - F.col("rj"), F.col("qi") - F.col("qj")
    near = (dr > 0) & (dr <= cfg.max_dist) & (dq > 0) & (dq <= cfg.max_dist) & (F.abs(dr - dq) <= cfg.band)
    return a.join(b, [group, "bin"]).where(near).select(group, "ri", "qi", "rj", "qj", link_score(F.col("sj"), dr, dq, cfg).alias("score"))


def chain_scores(ref: np.ndarray, q: np.ndarray, span: int, cfg: ChainConfig) -> tuple[np.ndarray, np.ndarray]:
    """Best score of a chain that ends at each anchor (in order of ref, q) and its predecessor (-1: none). Exact: every anchor in reach is tried."""
    n = len(ref)
    f, back, slope = np.full(n, float(span)), np.full(n, -1), np.zeros(n)
    for i in range(1, n):
        low = np.searchsorted(ref, ref[i] - cfg.max_dist)
        dr, dq = np.floor(ref[i] - ref[low:i] + 0.5), q[i] - q[low:i]
        dg, apart = np.minimum(dr, dq), np.abs(dr - dq)
        dd = np.maximum(apart - np.floor(cfg.tolerance * dg), 0)
        ok = (ref[low:i] < ref[i]) & (dq > 0) & (dq <= cfg.max_dist) & (apart <= cfg.band)
        if not ok.any():
            continue
        cost = np.floor(cfg.gap * dd + cfg.skip * dg + 0.5 * np.log2(dd + 1.0))
        got = f[low:i] + np.minimum(span, dg) - np.where((dd != 0) | (dg > span), cost, 0)
        if cfg.slope:
            turn = np.abs(dr / np.where(dq == 0, 1, dq) - slope[low:i])
            got -= np.where(back[low:i] >= 0, np.floor(cfg.slope * turn * dg), 0)
        got = np.where(ok, got, -np.inf)
        best = int(np.argmax(got))
        if got[best] > f[i]:
            f[i], back[i] = got[best], low + best
            slope[i] = (ref[i] - ref[back[i]]) / (q[i] - q[back[i]])
    return f, back


def forest(ref, q, span: int, cfg: ChainConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score, predecessor, root and number of anchors so far at each anchor: predecessors make a forest."""
    f, back = chain_scores(ref, q, span, cfg)
    root, depth = np.arange(len(f)), np.ones(len(f), np.int64)
    for i in np.flatnonzero(back >= 0):  # ascending, and predecessors come first
        root[i], depth[i] = root[back[i]], depth[back[i]] + 1
    return f, back, root, depth


def extracted(ref, q, span: int, cfg: ChainConfig) -> list[tuple[float, list[int]]]:
    """(score, anchors) of chains, best first: of each tree of the forest the path to its best end (the first of equal ones).

    The other paths of a tree meet that one, and chains share no anchor.
    """
    f, back, root, depth = forest(ref, q, span, cfg)
    best: dict[int, int] = {}
    for end in np.lexsort((np.arange(len(f)), -f)).tolist():
        best.setdefault(int(root[end]), end)
    ends = [e for e in best.values() if f[e] >= cfg.min_score and depth[e] >= cfg.min_anchors]
    out = []
    for end in ends[: cfg.max_chains]:
        walk = [end]
        while back[walk[-1]] >= 0:
            walk.append(int(back[walk[-1]]))
        out.append((float(f[end]), walk[::-1]))
    return [c for c in out if c[0] >= cfg.secondary_ratio * out[0][0]]


def used_anchors(ref, q, span: int, cfg: ChainConfig) -> np.ndarray:
    """Which anchors lie on the way to an end that scores enough."""
    f, back, _, _ = forest(ref, q, span, cfg)
    used = f >= cfg.min_score
    for i in range(len(f) - 1, -1, -1):
        if used[i] and back[i] >= 0:
            used[back[i]] = True
    return used


def by_group(anchors: DataFrame, cfg: ChainConfig, kernel, shape: str) -> DataFrame:
    """kernel(read, path, ref, q) gives rows of shape for the anchors, in order of (ref, q), of each read on each path.

    Anchors stream through the tasks in order; where two neighbours lie farther apart than a link may reach, nothing
    before meets anything after, but the rows of a group are ranked together, so a group is held until it ends.
    """
    names = [x.split()[0] for x in shape.split(", ")]

    def run(frames):
        import pandas as pd

        held = None
        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            new = (pdf["read"] != pdf["read"].shift()) | (pdf["path"] != pdf["path"].shift())
            cuts = [*np.flatnonzero(new.to_numpy()).tolist(), len(pdf)]
            rows = [r for a, b in zip(cuts[:-2], cuts[1:-1], strict=True) for r in kernel(pdf["read"].iat[a], pdf["path"].iat[a], pdf["ref"].to_numpy()[a:b], pdf["q"].to_numpy()[a:b])]
            held = pdf.iloc[cuts[-2]:] if len(cuts) > 1 else None
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if held is not None and len(held):
            yield pd.DataFrame(kernel(held["read"].iat[0], held["path"].iat[0], held["ref"].to_numpy(), held["q"].to_numpy()), columns=names)

    at = anchors.select("read", "path", "ref", F.col("q").cast("long").alias("q"))
    return at.repartition("read", "path").sortWithinPartitions("read", "path", "ref", "q").mapInPandas(run, shape)


def chains(anchors: DataFrame, span: int, cfg: ChainConfig) -> DataFrame:
    """anchors: read, path, ref, q. Per read and path its chains: rank, score, anchors, ends on both sides."""
    def kernel(read, path, ref, q):
        for rank, (score, walk) in enumerate(extracted(ref, q, span, cfg)):
            yield read, path, rank, score, len(walk), int(q[walk].min()), int(q[walk].max()) + span, int(ref[walk].min()), int(ref[walk].max()) + span

    return by_group(anchors, cfg, kernel, "read long, path long, rank long, score double, anchors long, q_start long, q_end long, ref_start long, ref_end long")


def survivors(anchors: DataFrame, span: int, cfg: ChainConfig) -> DataFrame:
    """read, path, ref, q of the anchors that some chain uses."""
    def kernel(read, path, ref, q):
        return [(read, path, int(ref[i]), int(q[i])) for i in np.flatnonzero(used_anchors(ref, q, span, cfg))]

    return by_group(anchors, cfg, kernel, "read long, path long, ref long, q long")


def kept_hits(hits: DataFrame, alive: DataFrame) -> DataFrame:
    """hits (read, q and others) that a surviving anchor comes from."""
    return hits.join(alive.select("read", "q").distinct(), ["read", "q"], "left_semi")


def best_scores(anchors: DataFrame, span: int, cfg: ChainConfig) -> DataFrame:
    """read, path, n, score: the best chain's score of each group, exact."""
    def kernel(read, path, ref, q):
        f, _ = chain_scores(ref, q, span, cfg)
        return [(read, path, len(f), float(f.max()))]

    return by_group(anchors, cfg, kernel, "read long, path long, n long, score double")


def on_layout(hits: DataFrame, layout: DataFrame) -> DataFrame:
    """hits: read, node, offset, q. read, path (the component), ref, q: places on the layout (node, component, start, end, len); offsets are scaled by a node's length there, if it has one."""
    width = F.col("end") - F.col("start")
    ref = F.col("start") + F.col("offset") * F.when((F.col("len") > 0) & (width > 0), width / F.col("len")).otherwise(1.0)
    return hits.join(layout, "node").select("read", F.col("component").alias("path"), ref.cast("double").alias("ref"), "q")


def layout_chains(placed: DataFrame, span: int, cfg: ChainConfig, both_ways: bool = True) -> DataFrame:
    """placed: read, path (component), ref, q. The best chains of each read over all components, with both_ways also those along which ref falls: rank, path, score, anchors, ends on both sides, backward."""
    def one(rows: DataFrame, backward: bool) -> DataFrame:
        def kernel(read, path, ref, q):
            # every tree's best path counts here, whatever the best one scores
            for score, walk in extracted(ref, q, span, replace(cfg, secondary_ratio=0.0)):
                a, b = sorted((abs(float(ref[walk[0]])), abs(float(ref[walk[-1]])))) if backward else (float(ref[walk[0]]), float(ref[walk[-1]]))
                yield read, path, score, len(walk), int(q[walk].min()), int(q[walk].max()) + span, a, b, backward

        return by_group(rows, cfg, kernel, "read long, path long, score double, anchors long, q_start long, q_end long, ref_start double, ref_end double, backward boolean")

    found = one(placed, False)
    if both_ways:
        found = found.unionByName(one(placed.withColumn("ref", -F.col("ref")), True))
    order = Window.partitionBy("read").orderBy(F.desc("score"), "path", "backward", "q_start", "ref_start")
    return found.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < cfg.max_chains)
