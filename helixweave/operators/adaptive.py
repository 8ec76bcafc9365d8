"""Decisions that follow the run: the first chunk at which a read is decided, and a fallback threshold that learns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixweave.operators import decide


def decided_by_chunk(chains: DataFrame) -> DataFrame:
    """chains: read, chunk, chain, score, anchors, as found with the first chunks of a read. read, chunk, decision, score: at the first chunk that decides, or unmapped at the last."""
    each = decide.decided(decide.standout(decide.with_mapq(decide.ranked(chains.withColumn("read", F.struct("read", "chunk"))))))
    rows = each.select("read.read", "read.chunk", "decision", "score")
    mapped = F.col("decision") != "U"
    # a mapped chunk sorts before every unmapped one; among those the last counts
    order = F.struct(F.when(mapped, 0).otherwise(1).alias("late"), F.when(mapped, F.col("chunk")).otherwise(-F.col("chunk")).alias("at"))
    return rows.groupBy("read").agg(F.min_by(F.struct("chunk", "decision", "score"), order).alias("d")).select("read", "d.*")


def with_learned_fallback(best: DataFrame, floor: float = 100.0, alpha: float = 0.02, keys: tuple[str, ...] = ("source", "depth")) -> DataFrame:
    """best: keys, read, n_chains, score, decision. decision with the fallback by a threshold for each key that learns
    from the scores of reads with several chains that stood out, in order of read; threshold as it was for the read.

    A key's reads stream through one task in order, as each changes what the next is held against; only the running mean
    is kept.
    """
    def run(frames):
        import pandas as pd

        at, mean = None, floor
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != at:
                    at, mean = key, floor
                limit, decision = max(mean, floor), row.decision
                if row.n_chains > 1 and decision == "S":
                    mean = alpha * row.score + (1.0 - alpha) * mean
                elif row.n_chains > 1:
                    decision = "F" if row.score >= limit else "U"
                out.append((*key, row.read, decision, limit))
            yield pd.DataFrame(out, columns=[*keys, "read", "decision", "threshold"])

    kinds = dict(best.dtypes)
    shape = ", ".join(f"{k} {kinds[k]}" for k in (*keys, "read")) + ", decision string, threshold double"
    return best.select(*keys, "read", "n_chains", "score", "decision").repartition(*keys).sortWithinPartitions(*keys, "read").mapInPandas(run, shape)
