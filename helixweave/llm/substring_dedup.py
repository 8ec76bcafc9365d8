"""Op 2, substring dedup: count-min prefilter, then exact grouping of the windows estimated repeated.

Documents are dealt by a hash of their id over chunks that follow the input's size. Then, chunk by chunk:

1. Each chunk sketches its windows (span words): two hash rows, sparse cells, each with a count of 1 or
   "2 or more". Cells are dealt by block, sketches are merged by adding, and each chunk is told which of its
   cells reach 2. A cell counts every window that falls on it, so a repeated window is never missed.
2. Windows whose cells all reach 2 go, once for each chunk, with two 64-bit hashes and their first document,
   to the owner of their hash, which groups exactly and tells each chunk which of them start earlier elsewhere.
3. Each chunk removes the words that windows which also start earlier cover.

The three steps share one shuffle of the texts (the planner reuses the exchange); a window that a third of all
documents hold is one row for each chunk. No sketch is ever gathered whole, on the driver or elsewhere.

Null and empty texts have no words and remove nothing. Of rows with equal ids one is earlier (by text). Rows
with a null id are treated as the smallest id. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, stored_bytes

SPAN = 20
#: A block's cells for each of the two rows, and the windows it is meant for.
CELLS, BLOCK_WINDOWS = 1 << 24, 1 << 21
BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
MIX = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)
MEMO = 400_000


class Words(dict):
    """Two independent 64-bit hashes of each word, remembered up to MEMO words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_128_intdigest(word)
        return h


def windows(texts: list[bytes | None], memo: Words, span: int) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text; two hashes, document and first word of each window, in order of document and word."""
    words = [t.split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    flat = b"".join([memo[x].to_bytes(16, "little") for w in words for x in w])
    both = np.frombuffer(flat, "<u8").reshape(-1, 2)
    n = np.maximum(sizes - span + 1, 0)
    doc = np.repeat(np.arange(len(words)), n)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + first
    hashes = []
    for k in range(2):
        one = np.ascontiguousarray(both[:, k])
        # sums over all starts at once; starts whose window crosses a text's end are never looked at
        total = np.zeros(max(0, len(one) - span + 1), np.uint64)
        for j in range(span):
            total = total * BASES[k] + one[j : j + len(total)]
        total ^= total >> np.uint64(32)
        total *= MIX[k]
        total ^= total >> np.uint64(29)
        hashes.append(total[at])
    return words, hashes[0], hashes[1], doc, first


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash (stable), where each distinct hash begins in it, and each window's number among the distinct."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # two window texts of equal first hash
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        same = a[1:] == a[:-1]
    new = np.concatenate([[True], ~(same & (b[1:] == b[:-1]))])[: len(a)]
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


def block_of(h1: np.ndarray, blocks: int) -> np.ndarray:
    """Ascending in h1: a block is a range of first hashes."""
    return ((h1 >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)


def cells(h1: np.ndarray, h2: np.ndarray) -> list[np.ndarray]:
    return [((h2 >> np.uint64(8 + 26 * r)) & np.uint64(CELLS - 1)).astype(np.uint32) for r in range(2)]


def squeezed(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def ranges(blocks: np.ndarray):
    """(block, from, to) of each run in an ascending array."""
    cut = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])) if len(blocks) else []
    for a, b in zip(cut, [*cut[1:], len(blocks)], strict=True):
        yield int(blocks[a]), a, b


def table(**cols) -> pa.Table:
    return pa.table({k: pa.array(v, pa.binary() if k == "payload" else pa.int64()) for k, v in cols.items()})


SENT = "chunk long, block long, payload binary"


def chunk_arrays(docs: pa.Table) -> tuple[list, list]:
    """Ids and texts of a chunk in ascending order of (id, text)."""
    rows = sorted(zip(docs["id"].to_pylist(), docs["text"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or b""))
    return [r[0] for r in rows], [r[1] for r in rows]


def sketched(span: int, blocks: int):
    """Step 1, in a chunk: sparse cells by block."""

    def run(docs: pa.Table) -> pa.Table:
        _, h1, h2, _, _ = windows(docs["text"].to_pylist(), Words(), span)
        chunk = docs["chunk"][0].as_py()
        out: list[tuple[int, bytes]] = []
        order, begin, _ = distinct(h1, h2)
        u1, u2 = h1[order][begin], h2[order][begin]
        often = np.diff(np.append(begin, len(order))) > 1
        for block, a, b in ranges(block_of(u1, blocks)):
            parts = []
            for cell in cells(u1[a:b], u2[a:b]):
                at = np.argsort(cell, kind="stable")
                c = cell[at]
                new = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                many = (np.diff(np.append(new, len(c))) > 1) | np.logical_or.reduceat(often[a:b][at], new)
                parts.append((c[new] << np.uint32(1)) | many)
            gaps = [np.diff(p, prepend=np.uint32(0)) for p in parts]
            out.append((block, len(gaps[0]).to_bytes(4, "little") + squeezed(np.concatenate(gaps))))
        return table(chunk=[chunk] * len(out), block=[b for b, _ in out], payload=[p for _, p in out])

    return run


def unsqueezed(payload: bytes) -> list[np.ndarray]:
    n, gaps = int.from_bytes(payload[:4], "little"), np.frombuffer(zlib.decompress(payload[4:]), np.uint32)
    return [np.cumsum(g, dtype=np.uint32) for g in (gaps[:n], gaps[n:])]


def merged(group: pa.Table) -> pa.Table:
    """Step 1, in a block: add the sketches, tell each chunk which of its cells reach 2."""
    total = np.zeros((2, CELLS), np.uint8)
    payloads = group["payload"]
    for p in payloads:
        for r, x in enumerate(unsqueezed(p.as_py())):
            c = x >> np.uint32(1)
            total[r, c] = np.minimum(total[r, c] + 1 + (x & np.uint32(1)).astype(np.uint8), 2)
    out = [b"".join(np.packbits(total[r, x >> np.uint32(1)] > 1).tobytes() for r, x in enumerate(unsqueezed(p.as_py()))) for p in payloads]
    return table(chunk=group["chunk"].to_pylist(), block=group["block"].to_pylist(), payload=out)


def suspects(span: int, blocks: int):
    """Step 2, in a chunk: of the distinct windows those whose cells all reach 2, with their first document."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts = chunk_arrays(docs) if len(docs) else ([], [])
        if not len(docs):
            return table(chunk=[], block=[], payload=[])
        _, h1, h2, doc, _ = windows(texts, Words(), span)
        order, begin, _ = distinct(h1, h2)
        u1, u2, first = h1[order][begin], h2[order][begin], doc[order][begin]
        told = dict(zip(replies["block"].to_pylist(), replies["payload"].to_pylist(), strict=True))
        sent = np.zeros(len(u1), bool)
        known = np.array([np.iinfo(np.int64).min if i is None else i for i in ids], np.int64)
        chunk, out = docs["chunk"][0].as_py(), []
        for block, a, b in ranges(block_of(u1, blocks)):
            bits, at, hit = told[block], 0, np.ones(b - a, bool)
            for cell in cells(u1[a:b], u2[a:b]):
                own, back = np.unique(cell, return_inverse=True)
                size = (len(own) + 7) // 8
                hit &= np.unpackbits(np.frombuffer(bits, np.uint8, size, at))[: len(own)].astype(bool)[back]
                at += size
            sent[a:b] = hit
            s = a + np.flatnonzero(hit)
            if len(s):
                out.append((block, len(s).to_bytes(4, "little") + u1[s].tobytes() + u2[s].tobytes() + squeezed(known[first[s]])))
        out.append((-1 - chunk, np.packbits(sent).tobytes()))  # comes back with the replies
        return table(chunk=[chunk] * len(out), block=[b for b, _ in out], payload=[p for _, p in out])

    return run


def owned(group: pa.Table) -> pa.Table:
    """Step 2, at the owner of a range of hashes: tell each chunk which of its windows start in an earlier document elsewhere."""
    if group["block"][0].as_py() < 0:
        return group.select(["chunk", "block", "payload"])
    h1, h2, doc, sizes = [], [], [], []
    for p in group["payload"].to_pylist():
        n = int.from_bytes(p[:4], "little")
        h1.append(np.frombuffer(p, "<u8", n, 4)), h2.append(np.frombuffer(p, "<u8", n, 4 + 8 * n))
        doc.append(np.frombuffer(zlib.decompress(p[4 + 16 * n :]), "<i8")), sizes.append(n)
    a, b, d = map(np.concatenate, (h1, h2, doc))
    _, begin, number = distinct(a, b)
    low = np.full(len(begin), np.iinfo(np.int64).max)
    np.minimum.at(low, number, d)
    late = np.split(low[number] < d, np.cumsum(sizes)[:-1])
    return table(chunk=group["chunk"].to_pylist(), block=group["block"].to_pylist(), payload=[np.packbits(x).tobytes() for x in late])


def removed(span: int, blocks: int, id_col: str, kept_text: bool):
    """Step 3, in a chunk."""

    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts = chunk_arrays(docs) if len(docs) else ([], [])
        words, h1, h2, doc, first = windows(texts, Words(), span)
        order, begin, number = distinct(h1, h2)
        late = np.zeros(len(begin), bool)
        told = dict(zip(replies["block"].to_pylist(), replies["payload"].to_pylist(), strict=True))
        if len(docs):
            sent = np.unpackbits(np.frombuffer(told[-1 - docs["chunk"][0].as_py()], np.uint8))[: len(begin)].astype(bool)
            for block, a, b in ranges(block_of(h1[order][begin], blocks)):
                s = a + np.flatnonzero(sent[a:b])
                if len(s):
                    late[s] = np.unpackbits(np.frombuffer(told[block], np.uint8))[: len(s)]
        drop = late[number]
        again = np.ones(len(order), bool)
        again[order[begin]] = False  # all but the first of this chunk
        drop |= again
        ends = np.cumsum([len(w) for w in words])
        start = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(words) else np.empty(0, np.int64)
        cover = np.zeros((int(ends[-1]) if len(words) else 0) + 1, np.int64)
        at = (start[doc] + first)[drop] if len(doc) else np.empty(0, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + span, -1)
        gone = np.cumsum(cover)[:-1] > 0
        n_removed, digests, kept = [], [], []
        for w, a, b in zip(words, start, ends, strict=True):
            g = gone[a:b]
            k = int(g.sum())
            text = b" ".join([x for x, y in zip(w, g.tolist(), strict=True) if not y] if k else w)
            n_removed.append(k), digests.append(hashlib.sha256(text).hexdigest())
            if kept_text:
                kept.append(text.decode())
        cols = {id_col: pa.array(ids, pa.int64()), "n_words": pa.array(map(len, words), pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(cols | ({"kept_text": pa.array(kept, pa.string())} if kept_text else {}))

    return run


def substring_dedup(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text_col: str = "text", n_chunks: int | None = None,
                    n_blocks: int | None = None, kept_text: bool = False) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (kept words joined by one space)."""
    n = n_chunks or chunks(docs)
    blocks = n_blocks or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), stored_bytes(docs) // (3 * BLOCK_WINDOWS))
    dealt = docs.select(
        F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col).cast("string"), "UTF-8").alias("text"),
        F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(n)).alias("chunk"),
    ).repartition(n, "chunk")
    by_chunk = dealt.groupBy("chunk")

    def sent_back(df: DataFrame):
        return df.repartition(n, "chunk").groupBy("chunk")

    told = by_chunk.applyInArrow(sketched(span, blocks), SENT).groupBy("block").applyInArrow(merged, SENT)
    found = by_chunk.cogroup(sent_back(told)).applyInArrow(suspects(span, blocks), SENT)
    late = found.groupBy("block").applyInArrow(owned, SENT)
    out = f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * kept_text
    return by_chunk.cogroup(sent_back(late)).applyInArrow(removed(span, blocks, id_col, kept_text), out)
