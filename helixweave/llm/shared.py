"""Where the llm operators stage tables, and how large their inputs are."""

from __future__ import annotations

import functools
import gc
import math
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Text bytes (as stored) that one chunk of documents should hold; a chunk is what one Python call sees.
CHUNK_BYTES = 4 << 20


@functools.lru_cache(maxsize=4)
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="helixweave-")


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared folder that the cluster names in spark.checkpoint.dir.

    Only a single local process, as in tests, may leave that unset: a temporary folder takes its place. On a cluster
    it would be another folder on each machine, so there an unset folder is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/helixweave-{uuid.uuid4().hex}"


def staged(df: DataFrame, where: str) -> DataFrame:
    """df as a written table in the shared folder: its lineage ends there, so a lost executor repeats nothing before it."""
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


class Staging:
    """Written tables of one run. Each goes as soon as the run has no more use for it, and so do the shuffle files behind it."""

    def __init__(self, spark: SparkSession, where: str | None = None):
        self.spark, self.where = spark, where or scratch(spark)
        self.held: dict[int, tuple[DataFrame, str]] = {}

    def put(self, df: DataFrame, name: str, free: bool = True) -> DataFrame:
        """free: let Spark's cleaner take the shuffle files that the write has left; they'd stay until the driver next collects its garbage."""
        out = staged(df, f"{self.where}/{name}")
        self.held[id(out)] = out, f"{self.where}/{name}"
        if free:
            gc.collect()
            self.spark._jvm.System.gc()
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of put(); nothing that is computed later may read them."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.held.pop(id(t))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of df by the planner's statistics (file sizes); measured where the planner doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 50:
        return size
    from pyspark.sql import functions as F

    texts = [F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    total = F.lit(0).cast("long")
    for t in texts:
        total = total + t
    return df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0]


def chunks(df: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """How many chunks of chunk_bytes df makes: follows the input, never below the session's partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(stored_bytes(df) / chunk_bytes))


def tokenizer_path(name: str) -> str:
    """Default place of a public vocabulary file; every operator also takes a path."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
