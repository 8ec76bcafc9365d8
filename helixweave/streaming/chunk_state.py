"""Chunks of a read as a stream: running state by read.

Samples arrive as a file stream; state is kept by read with ``applyInPandasWithState`` and given off at every
micro-batch; the sink keeps the last state of each read. A batch's rows of one read are folded in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixweave.functions.signal import in_pa_range
from helixweave.store import fresh_folder

OUT = "read long, n long, total double, chunks long"
STATE = "n long, total double"


def fold(chunk: int):
    def update(key, frames, state):
        import pandas as pd

        n, total = state.get if state.exists else (0, 0.0)
        for pdf in frames:
            n, total = n + len(pdf), total + float(pdf["pa"].sum())
        state.update((n, total))
        yield pd.DataFrame([(key[0], n, total, -(-n // chunk))], columns=["read", "n", "total", "chunks"])

    return update


def states(stream: DataFrame, chunk: int) -> DataFrame:
    """stream: read, pa. State of each read after every micro-batch."""
    return stream.groupBy("read").applyInPandasWithState(fold(chunk), OUT, STATE, "update", "NoTimeout")


def run(views, chunk: int) -> DataFrame:
    """The events table as a stream, to its end; the last state of each read."""
    spark = views.spark
    events = views.table("events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").format("parquet").load(_folder(views))
    samples = stream.where(in_pa_range(F.col("value"))).select(F.col("user_id").alias("read"), F.col("value").alias("pa"))
    where = fresh_folder(spark, "chunks")
    (states(samples, chunk).writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{where}/state")
     .foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{where}/out/batch={n}")).start().awaitTermination())
    last = spark.read.schema(f"{OUT}").parquet(f"{where}/out").groupBy("read").agg(F.max_by(F.struct("n", "total", "chunks"), "n").alias("s"))
    return last.select("read", "s.n", F.round("s.total", 4).alias("total"), "s.chunks")


def _folder(views) -> str:
    """A streaming source reads folders: the table's own, or its parent with the table's name as the glob."""
    path = f"{views.sf_dir}/events.parquet"
    jvm = views.spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(views.spark._jsc.hadoopConfiguration())
    return path if fs.getFileStatus(p).isDirectory() else f"{views.sf_dir}/event[s].parquet"
