"""Op 7, token ids in binary files: static range asymmetric numeral system.

``write`` encodes every text, adds the end id, puts documents in ascending id order and writes

- ``table``: the shared frequency table (one row: scale bits, frequencies), counted over all documents;
- ``blocks``: rows (shard, block, n_tokens, payload); payload is a self-contained block (``rans``) with its
  checkpoint, checksum and the pieces of documents in it. A block closes at the first document end past
  block_tokens, or within a document that is longer than that.

Blocks travel as rows of Parquet, so any store that Spark writes will do and lost tasks are written again.
``read`` decodes blocks in any order, in parallel; ``documents`` derives each document's place, length and
crc32 from decoded blocks alone.

Null and empty texts hold the end id only. Rows with equal ids stay apart, ordered by their tokens; null
ids come first. An empty table gives empty files. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans, wordbpe
from .shared import scratch, staged, tokenizer_path

BLOCK_TOKENS = 1 << 17
SCALE_BITS = 18
#: pieces: document number in its shard, id, first token in the shard, tokens here, 1 if it begins here | 2 if it ends here, 1 if the id is null
DOCNO, ID, START, N, ENDS, NULL = range(rans.PIECE)


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, toks): each text's ids with the end id, packed."""
    whole = docs.sparkSession.sparkContext.broadcast(
        wordbpe.load(path).proven_whole()
    )

    def encode(batches):
        bpe, proven = wordbpe.load(path), whole.value
        for batch in batches:
            ids, n = bpe.encode_many(batch.column(1).to_pylist(), proven, end_id)
            cuts = np.concatenate([[0], np.cumsum(n)]) * bpe.dtype.itemsize
            toks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), toks.cast(pa.binary())], names=["id", "toks"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        encode, "id long, toks binary"
    )


def counted(toks: DataFrame, size: int, dtype: str) -> np.ndarray:
    """How often each id occurs over all documents; summed by task, then by id: what comes to the driver is bounded by the vocabulary."""

    width = np.dtype(dtype).itemsize

    def count(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            _, cuts, raw = batch.column(0).buffers()
            cuts = np.frombuffer(cuts, np.int32)[batch.column(0).offset :][: len(batch) + 1]
            if len(batch):
                total += np.bincount(np.frombuffer(raw, dtype)[cuts[0] // width : cuts[-1] // width], minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["tok", "n"])

    out = np.zeros(size, np.int64)
    for tok, n in toks.select("toks").mapInArrow(count, "tok long, n long").groupBy("tok").agg(F.sum("n")).collect():
        out[tok] = n
    return out


def write(docs: DataFrame, where: str, path: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
          block_tokens: int = BLOCK_TOKENS, scale_bits: int = SCALE_BITS) -> None:
    spark = docs.sparkSession
    path = path or tokenizer_path("word_bpe_49k.json")
    bpe = wordbpe.load(path)
    size, dtype = bpe.size, bpe.dtype.str
    toks = staged(encoded(docs, path, end_id, id_col, text_col), f"{where}/tokens")
    freq = rans.scaled(counted(toks, size, dtype), scale_bits)
    spark.createDataFrame([(scale_bits, freq.tolist())], "bits int, freq array<long>").write.mode("overwrite").parquet(f"{where}/table")
    table = spark.sparkContext.broadcast((freq, scale_bits))

    def blocks(batches):
        wordbpe.load.cache_clear()  # a worker that has encoded texts before holds the words of then
        coder = rans.Table(*table.value)
        shard = TaskContext.get().partitionId()
        pieces: list[tuple] = []
        held: list[np.ndarray] = []
        n = block = start = docno = 0

        def close():
            nonlocal n, block
            row = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([block], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([rans.pack(coder, np.concatenate(held), np.array(pieces, np.int64))], pa.binary())],
                names=["shard", "block", "n_tokens", "payload"],
            )
            held.clear(), pieces.clear()
            n, block = 0, block + 1
            return row

        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, at = np.frombuffer(b, dtype), 0
                while at < len(ids):
                    part = ids[at : at + block_tokens - n]
                    held.append(part)
                    pieces.append((docno, i or 0, start, len(part), (at == 0) | (at + len(part) == len(ids)) << 1, i is None))
                    at, n, start = at + len(part), n + len(part), start + len(part)
                    if n >= block_tokens or len(ids) > block_tokens and at < len(ids):
                        yield close()
                docno += 1
        if n:
            yield close()

    (toks.repartitionByRange("id").sortWithinPartitions("id", "toks")
     .mapInArrow(blocks, "shard long, block long, n_tokens long, payload binary")
     .write.mode("overwrite").parquet(f"{where}/blocks"))


def read(spark: SparkSession, where: str) -> DataFrame:
    """Decoded pieces: shard, docno, id, start (in its shard), n, ends, crc, toks (32-bit little-endian)."""
    bits, freq = spark.read.parquet(f"{where}/table").first()
    table = spark.sparkContext.broadcast((np.array(freq, np.int64), bits))

    def decode(batches):
        wordbpe.load.cache_clear()
        coder = rans.Table(*table.value)
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, pieces = rans.unpack(coder, block.as_buffer().to_pybytes())
                cuts = np.concatenate([[0], np.cumsum(pieces[:, N])])
                raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(raw), pa.int64()), pa.array(pieces[:, DOCNO]),
                     pa.array(pieces[:, ID], mask=pieces[:, NULL] == 1), pa.array(pieces[:, START]), pa.array(pieces[:, N]),
                     pa.array(pieces[:, ENDS]), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(raw, pa.binary())],
                    names=["shard", "docno", "id", "start", "n", "ends", "crc", "toks"],
                )

    return spark.read.parquet(f"{where}/blocks").select("shard", "payload").mapInArrow(
        decode, "shard long, docno long, id long, start long, n long, ends long, crc long, toks binary"
    )


def documents(spark: SparkSession, where: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    from pyspark.sql import Window

    shards = spark.read.parquet(f"{where}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row per shard: as many as there are write tasks, each with a block or more
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    pieces = read(spark, where).drop("toks").join(F.broadcast(base), "shard")

    def joined(batches):
        for batch in batches:
            out = []
            for parts in batch.column(1).to_pylist():
                parts.sort(key=lambda p: p["start"])
                crc = 0
                for p in parts:
                    crc = rans.crc_joined(crc, p["crc"], 4 * p["n"])
                out.append(crc)
            cols = [batch.column(0), batch.column(2), batch.column(3), pa.array(out, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "n_tokens", "ids_crc32"])

    at = (F.col("base") + F.col("start")).alias("start")
    entire = pieces.where("ends = 3").select("id", at, F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = (pieces.where("ends < 3").groupBy("shard", "docno")
           .agg(F.first("id").alias("id"), F.collect_list(F.struct("start", "n", "crc")).alias("parts"),
                F.min(F.col("base") + F.col("start")).alias("start"), F.sum("n").alias("n_tokens"))
           .select("id", "parts", "start", "n_tokens")
           .mapInArrow(joined, "id long, start long, n_tokens long, ids_crc32 long"))
    return entire.unionByName(cut).withColumnRenamed("id", id_col)


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write docs in the shared folder, read the files back."""
    where = scratch(docs.sparkSession)
    write(docs, where, path, end_id)
    return documents(docs.sparkSession, where)
