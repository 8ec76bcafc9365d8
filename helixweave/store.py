"""The shared folder of a run, tables written there, and row numbers over a whole table."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@functools.lru_cache(maxsize=4)
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="helixweave-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a single local process may leave it unset and gets a temporary one, a cluster may not."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_folder(spark.sparkContext.applicationId)
    return base.rstrip("/")


def fresh_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, where: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there."""
    df.write.mode("overwrite").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def row_numbers(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with out: each row's number from 0 in this order. Rows are dealt by range; what meets in one task is a count for each partition."""
    local = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the low 33 bits count a partition's rows, the others number the partitions in order of range
    local = written(local.withColumn("_at", F.monotonically_increasing_id()), fresh_folder(df.sparkSession, "numbered"))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = local.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    base = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    return local.withColumn("_part", part).join(F.broadcast(base), "_part").withColumn(out, at + F.col("_base")).drop("_part", "_at", "_base")
