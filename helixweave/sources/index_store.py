"""A seed index as written tables: postings and counts by hash, and what it was made with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixweave.operators import index
from helixweave.store import written

#: Of the format; a reader takes its own only.
VERSION = 1


def save(seeds: DataFrame, where: str, mode: str, k: int, w: int, bits: int = 2, stride: int = 1, unique: bool = False) -> None:
    """seeds: hash, node, offset. Tables entries, counts and meta under where; each file of entries is in order of hash, so a reader of few hashes skips row groups.

    unique: no seed comes twice and there are few different hashes, so seeds are neither compared nor dealt by hash; each task writes its own.
    """
    spark = seeds.sparkSession
    found = seeds.select("hash", "node", "offset") if unique else index.entries(seeds).repartitionByRange("hash")
    entries = written(found.sortWithinPartitions("hash", "node", "offset"), f"{where}/entries")
    index.frequencies(entries).write.mode("overwrite").parquet(f"{where}/counts")
    spark.createDataFrame([(VERSION, mode, k, w, bits, stride)], "version int, mode string, k int, w int, bits int, stride int").write.mode("overwrite").parquet(f"{where}/meta")


def probe(spark: SparkSession, where: str) -> bool:
    """Whether an index was written here to its end: meta comes last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/meta/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


class Index:
    """entries (hash, node, offset), counts (hash, n) and the parameters of a written index; ValueError for another version or mode."""

    def __init__(self, spark: SparkSession, where: str, mode: str | None = None):
        if not probe(spark, where):
            raise ValueError(f"no index in {where}")
        meta = spark.read.parquet(f"{where}/meta").first()
        if meta.version != VERSION:
            raise ValueError(f"index of version {meta.version}, not {VERSION}")
        if mode is not None and meta.mode != mode:
            raise ValueError(f"index of mode {meta.mode}, not {mode}")
        self.k, self.w, self.bits, self.stride, self.mode = meta.k, meta.w, meta.bits, meta.stride, meta.mode
        self.entries = spark.read.schema("hash long, node long, offset long").parquet(f"{where}/entries")
        self.counts = spark.read.schema("hash long, n long").parquet(f"{where}/counts")

    def lookup(self, seeds: DataFrame, cap: DataFrame) -> DataFrame:
        """seeds (hash and others) with node and offset of each posting; hashes over the cap (one row) drop out before postings are expanded."""
        allowed = self.counts.crossJoin(F.broadcast(cap)).where("n <= cap").select("hash", "n")
        return seeds.join(allowed, "hash").join(self.entries, "hash")
