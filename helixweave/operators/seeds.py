"""Seeds: hashes of short words of a sequence or a token stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixweave.functions.bits import base_code, hash_array, with_hash


def base_kmers(seqs: DataFrame, k: int, key: str = "read", seq: str = "seq") -> DataFrame:
    """key, pos, hash of each k-mer of ACGT letters (case ignored)."""
    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31: two bits a base, in a signed 64-bit integer")
    # sequences are dealt by key before they are exploded: windows over key need no shuffle of k-mers then
    n = int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = seqs.where(F.length(seq) >= k).repartition(n, key).select(key, seq, F.explode(F.sequence(F.lit(1), F.length(seq) - k + 1)).alias("p"))
    code = at.select(key, (F.col("p") - 1).cast("long").alias("pos"), base_code(F.substring(F.col(seq), F.col("p"), F.lit(k))).alias("code"))
    return with_hash(code, "code", 2 * k).select(key, "pos", "hash")


def minimizers(kmers: DataFrame, w: int, key: str = "read") -> DataFrame:
    """The leftmost smallest hash of every w consecutive k-mers, each position once; null hashes lose, all-null windows give none."""
    near = Window.partitionBy(key).orderBy("pos")
    best = F.min(F.when(F.col("hash").isNotNull(), F.struct("hash", "pos"))).over(near.rowsBetween(0, w - 1))
    size = F.count(F.lit(1)).over(near.rowsBetween(0, w - 1))
    picked = kmers.select(key, best.alias("best"), size.alias("size"), F.col("pos").alias("at")).where((F.col("size") == w) & F.col("best").isNotNull())
    new = F.coalesce(F.lag("best.pos").over(Window.partitionBy(key).orderBy("at")) != F.col("best.pos"), F.lit(True))
    return picked.withColumn("new", new).where("new").select(key, F.col("best.pos").alias("pos"), F.col("best.hash").alias("hash"))


def token_kmers(tokens: Column, k: int, bits: int, stride: int = 1) -> Column:
    """array<struct<idx, hash>> of runs of k tokens in an array of tokens; runs with a null token are skipped."""
    n = F.size(tokens) - k
    pack = lambda i: F.aggregate(F.slice(tokens, i + 1, k), F.lit(0).cast("long"), lambda a, t: (a * (1 << bits) + t).bitwiseAND((1 << min(k * bits, 62)) - 1))
    starts = F.when(n >= 0, F.sequence(F.lit(0), n, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    hashes = hash_array(F.transform(starts, pack), 32)
    return F.filter(F.arrays_zip(F.transform(starts, lambda i: i.cast("long")).alias("idx"), hashes.alias("hash")), lambda x: x["hash"].isNotNull())
