"""Reads: FASTQ and FASTA (plain or gzip) and SLOW5 text, one file a task."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(text: io.TextIOBase) -> Iterator[tuple[str, str]]:
    """(id, sequence) of four-line @ records and two-line > records; what is malformed ends the file."""
    while (head := text.readline()) and (head := head.rstrip("\r\n")) != "":
        seq = text.readline().rstrip("\r\n")
        if head[0] == "@":
            if not text.readline().startswith("+") or len(text.readline().rstrip("\r\n")) != len(seq):
                return
        elif head[0] != ">" or not seq:
            return
        yield head[1:].split()[0] if head[1:].split() else "", seq


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """read_id, sequence, source_file."""
    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = list(records(io.StringIO(raw.decode())))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([name] * len(rows), pa.string())], names=["read_id", "sequence", "source_file"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(parse, "read_id string, sequence string, source_file string")


def slow5(spark: SparkSession, path: str) -> DataFrame:
    """read_id, source_file, raw_signal, len_raw_signal, range, digitisation, offset, sampling_rate_hz of SLOW5 text; columns by the header line."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.slow5").text(path).select("value", F.col("_metadata.file_path").alias("source_file"))
    rows = rows.where(~F.col("value").startswith("#") & ~F.col("value").startswith("@") & (F.col("value") != "")).select("source_file", F.split("value", "\t").alias("f"))
    f = lambda i: F.get("f", F.lit(i))  # noqa: E731  fixed leading columns: read_id, group, digitisation, offset, range, rate, length, signal
    return rows.select(f(0).alias("read_id"), "source_file", F.split(f(7), ",").cast("array<smallint>").alias("raw_signal"), f(6).cast("long").alias("len_raw_signal"),
                       f(4).cast("float").alias("range"), f(2).cast("float").alias("digitisation"), f(3).cast("float").alias("offset"), f(5).cast("float").alias("sampling_rate_hz"))


def pore_model(spark: SparkSession, path: str, normalize: bool = False) -> DataFrame:
    """kmer, level from white-space columns; header and unreadable rows skipped; normalize: z-scores over the table."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), "\\s+").alias("f")).where((F.size("f") >= 2) & ~F.lower(F.col("f")[0]).isin("kmer", "#kmer"))
    rows = rows.select(F.col("f")[0].alias("kmer"), F.col("f")[1].try_cast("double").alias("level")).where("level is not null")
    if normalize:
        stat = rows.agg(F.avg("level").alias("m"), F.stddev_pop("level").alias("s"))  # one row
        rows = rows.crossJoin(F.broadcast(stat)).select("kmer", ((F.col("level") - F.col("m")) / F.col("s")).alias("level"))
    return rows


#: What reads each kind of file.
PROVIDERS = {".slow5": slow5, ".fastq": sequences, ".fq": sequences, ".fasta": sequences, ".fa": sequences}


def provider(path: str):
    """The reader of a file by its name (.gz aside); binary signal files are named, as no reader of theirs is at hand."""
    name = path.lower().removesuffix(".gz")
    found = next((f for end, f in PROVIDERS.items() if name.endswith(end)), None)
    if found is None:
        raise ValueError(f"{path}: convert binary signal files to .slow5 first" if name.endswith((".blow5", ".pod5")) else f"no reader for {path}")
    return found


def coordinates(spark: SparkSession, path: str) -> DataFrame:
    """node, start, end of a layout table with a header and two rows (idx, X, Y) for each node: its start, then its end."""
    rows = spark.read.option("sep", "\t").option("header", "true").schema("idx long, X double, Y double").csv(path)
    at = lambda k: F.max(F.when(F.col("idx") % 2 == k, F.col("X")))
    return rows.groupBy(F.floor(F.col("idx") / 2).alias("node")).agg(at(0).alias("start"), at(1).alias("end"))


def coordinate_lines(layout: DataFrame) -> DataFrame:
    """idx, X, Y of node, start, len: the end is the start and the length."""
    ends = F.array(F.struct((F.col("node") * 2).alias("idx"), F.col("start").alias("X")), F.struct((F.col("node") * 2 + 1).alias("idx"), (F.col("start") + F.col("len")).alias("X")))
    return layout.select(F.explode(ends).alias("e")).select("e.idx", "e.X", F.lit(0.0).alias("Y"))
