"""Sequence mapping end to end: minimizers, capped lookup, chains, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixweave.operators import chaining, decide, index, seeds
from helixweave.operators.chaining import ChainConfig
from helixweave.sinks.records import best_first
from helixweave.sources.index_store import Index, save
from helixweave.store import fresh_folder

K, W, CAP = 12, 3, 0.99


def base_index(paths: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """paths: read, seq. hash, node, offset of their minimizers."""
    return index.entries(seeds.minimizers(seeds.base_kmers(paths, k), w).select("hash", F.col("read").alias("node"), F.col("pos").alias("offset")))


def stored_index(paths: DataFrame, k: int = K, w: int = W) -> Index:
    """The index of paths, written once: its cap, its counts and its postings are read from there."""
    where = fresh_folder(paths.sparkSession, "index")
    save(seeds.minimizers(seeds.base_kmers(paths, k), w).select("hash", F.col("read").alias("node"), F.col("pos").alias("offset")), where, "base", k, w)
    return Index(paths.sparkSession, where, "base")


def anchors(reads: DataFrame, paths: DataFrame | Index, k: int = K, w: int = W, cap: float = CAP) -> DataFrame:
    """read, path, ref, q: where minimizers of reads occur, without hashes over the percentile cap. paths: sequences, or the index of some."""
    built = paths if isinstance(paths, Index) else stored_index(paths, k, w)
    found = built.lookup(seeds.minimizers(seeds.base_kmers(reads, built.k), built.w), index.percentile_cap(built.counts, cap))
    return found.select("read", F.col("node").alias("path"), F.col("offset").alias("ref"), F.col("pos").alias("q"))


def mapped(reads: DataFrame, paths: DataFrame, k: int = K, w: int = W, cfg: ChainConfig | None = None) -> DataFrame:
    """read, n_chains, path, score, mapq, anchors, standout, decision of every read with a chain."""
    cfg = cfg or ChainConfig().scaled(k)
    best = chaining.best_scores(anchors(reads, paths, k, w), k, cfg).where(F.col("score") >= cfg.min_score)
    chains = decide.with_mapq(decide.ranked(best.select("read", F.col("path").alias("chain"), "score", F.col("n").alias("anchors"))))
    return decide.decided(decide.standout(chains)).withColumnRenamed("chain", "path")


def chain_records(reads: DataFrame, paths: DataFrame, built: Index | None = None, prefix: str = "", cfg: ChainConfig | None = None) -> DataFrame:
    """reads and paths: read, seq. Every read with its ranked chains and its decision, or with none, as ``sinks.records`` takes them; paths are named by prefix and number."""
    built = built or stored_index(paths)
    found = chaining.chains(anchors(reads, built), built.k, cfg or ChainConfig().scaled(built.k)).drop("rank")
    found = best_first(found).withColumn("chain", F.col("rank") + 1).drop("rank", "n_chains")
    ranked = decide.with_mapq(decide.ranked(found))
    decided = decide.decided(decide.standout(ranked.select("read", "chain", "score", "anchors", "mapq"))).select("read", "n_chains", "standout", "decision")
    lens = reads.select("read", F.length("seq").cast("long").alias("read_len"))
    path_lens = paths.select(F.col("read").alias("path"), F.length("seq").cast("long").alias("path_len"))
    rows = lens.join(ranked.join(path_lens, "path"), "read", "left").join(decided, "read", "left")
    return rows.withColumns({
        "decision": F.coalesce("decision", F.lit("U")), "rank": F.coalesce("rank", F.lit(0)), "n_chains": F.coalesce("n_chains", F.lit(0)), "standout": F.coalesce("standout", F.lit(0.0)),
        "path": F.concat(F.lit(prefix), F.col("path").cast("string")), "walk": F.concat(F.lit(">"), F.col("path").cast("string")), "matches": F.col("anchors") * built.k, "chunks": F.lit(1),
    })
