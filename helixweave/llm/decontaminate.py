"""Op 5, benchmark decontamination: greedy string tiling.

Seeds (runs of seed terms) of each benchmark item are hashed and joined with those of every document by
Karp-Rabin hashes; runs of seeds on one diagonal make matches. The longest match is marked first, what
overlaps it is cut back, and so on, until no unmarked match of seed terms is left. An item's coverage is the
share of its terms that tiles cover, in any order; a document at or above the threshold is contaminated.

The benchmark is dealt by a hash of its ids into slices of about slice_bytes of text (an item stays whole, so a slice
holds at least one). Only one slice is broadcast and indexed at a time: where there are several, each one's pass over the
documents writes what it finds before the next begins, and the finds are joined to the documents by id and text.
With one slice documents are not shuffled.

Items shorter than seed must match whole. Items without terms match nothing; null and empty documents match
nothing. An item of one term marks every document with that term. Repeated item ids count together (the best coverage);
repeated rows of a document have equal results. An empty benchmark matches nothing. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Staging
from .terms import Hashes, hashed, terms, windows

SEED, THRESHOLD = 5, 0.6
SLICE_BYTES = 8 << 20


class Seeds:
    """Terms of items, and their seeds' hashes in ascending order, by seed length."""

    def __init__(self, items: list[tuple[int, str | None]], seed: int):
        memo = Hashes()
        self.ids = [i for i, _ in items]
        self.terms = [terms(t) for _, t in items]
        self.by_length = {}
        for length in sorted({min(seed, len(t)) for t in self.terms} - {0}):
            of = [k for k, t in enumerate(self.terms) if min(seed, len(t)) == length]
            h = [windows(hashed(self.terms[k], memo), length) for k in of]
            item = np.repeat(of, [len(x) for x in h])
            at = np.concatenate([np.arange(len(x)) for x in h])
            h = np.concatenate(h)
            order = np.argsort(h, kind="stable")
            self.by_length[length] = h[order], item[order], at[order]

    def matches(self, words: list[bytes], memo: Hashes):
        """(item, seed length, positions in item, positions in words) of each item that shares a seed."""
        h = hashed(words, memo)
        for length, (seeds, item, at) in self.by_length.items():
            w = windows(h, length)
            low = np.searchsorted(seeds, w)
            hit = np.flatnonzero((low < len(seeds)) & (seeds[np.minimum(low, len(seeds) - 1)] == w)) if len(w) else []
            if not len(hit):
                continue
            high = np.searchsorted(seeds, w[hit], "right")
            n = high - low[hit]
            where = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, i, p = np.repeat(hit, n), item[where], at[where]
            order = np.lexsort((p, q - p, i))
            i, p, q = i[order], p[order], q[order]
            cuts = [0, *(np.flatnonzero(np.diff(i)) + 1).tolist(), len(i)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield int(i[a]), length, p[a:b], q[a:b]


def tiled(item: list[bytes], words: list[bytes], length: int, p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
    """Terms of the item under tiles and the number of tiles; p, q: seeds, in order of diagonal and position."""
    new = np.flatnonzero(np.concatenate([[True], (np.diff(q - p) != 0) | (np.diff(p) != 1)]))
    size = np.diff(np.append(new, len(p))) + length - 1
    heap = [(-int(n), int(p[k]), int(q[k])) for k, n in zip(new, size, strict=True)]
    heapq.heapify(heap)
    mine, theirs = bytearray(len(item)), set()
    tiles = 0
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = [not mine[a + k] and b + k not in theirs and item[a + k] == words[b + k] for k in range(n)]
        if all(free):
            mine[a : a + n] = b"\1" * n
            theirs.update(range(b, b + n))
            tiles += 1
            continue
        k = 0
        while k < n:  # what is left of it between marks comes up again at its own length
            if not free[k]:
                k += 1
                continue
            end = k
            while end < n and free[end]:
                end += 1
            if end - k >= length:
                heapq.heappush(heap, (k - end, a + k, b + k))
            k = end
    return sum(mine), tiles


MATCHES = "array<struct<item: bigint, coverage: double, tiles: bigint>>"


def matched(texts: DataFrame, items: DataFrame, seed: int) -> DataFrame:
    """texts (its last column a text) with matches in that column's place. items: one slice, which is broadcast."""
    index = texts.sparkSession.sparkContext.broadcast(Seeds([(r.item, r.text) for r in items.orderBy("item", "text").collect()], seed))
    kind = pa.list_(pa.struct([("item", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int64())]))

    def match(batches):
        seeds, memo = index.value, Hashes()
        for batch in batches:
            found = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                best: dict[int, dict] = {}
                words = terms(text)
                for i, length, p, q in seeds.matches(words, memo):
                    covered, tiles = tiled(seeds.terms[i], words, length, p, q)
                    share, name = covered / len(seeds.terms[i]), seeds.ids[i]
                    if name not in best or share > best[name]["coverage"]:
                        best[name] = {"item": name, "coverage": share, "tiles": tiles}
                found.append(sorted(best.values(), key=lambda m: m["item"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=[*batch.schema.names[:-1], "matches"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return texts.mapInArrow(match, f"{shape}, matches {MATCHES}")


def coverages(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, text_col: str = "text", item_col: str = "item_id",
              item_text: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """row (struct of docs' columns) and matches array<struct<item, coverage, tiles>>: all items that share a seed with the text, in order of item."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    n = max(1, math.ceil((items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) / slice_bytes))
    slices = [r[0] for r in items.select(F.pmod(F.xxhash64("item"), F.lit(n)).alias("s")).distinct().orderBy("s").collect()]
    part = lambda s: items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == s)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.col(text_col).cast("string").alias("text")
    if len(slices) <= 1:
        return matched(docs.select(row, text), part(slices[0]) if slices else items.limit(0), seed)
    stage = Staging(docs.sparkSession)
    # a text is named by two hashes
    name = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("text"), text).alias("h2")]
    found = None
    for s in slices:
        new = stage.put(matched(docs.select(*name, text), part(s), seed).where(F.size("matches") > 0).dropDuplicates(["h1", "h2"]), f"slice{s}", free=False)
        found = new if found is None else found.unionByName(new)
    # an item is in one slice only, so the slices' finds are put together as they are
    found = found.groupBy("h1", "h2").agg(F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))
    return docs.select(row, *name).join(found, ["h1", "h2"], "left").select("row", F.coalesce("matches", F.expr(f"cast(array() as {MATCHES})")).alias("matches"))


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", **how) -> DataFrame:
    """Per document row: id, contaminated, items (ids of the items it covers), n_items, max_coverage (0 without a match)."""
    text_col = how.get("text_col", "text")
    covered = F.transform(F.filter("matches", lambda m: m["coverage"] >= threshold), lambda m: m["item"])
    return coverages(docs.select(id_col, text_col), benchmark, **how).select(
        F.col("row").getField(id_col).alias(id_col), (F.size(covered) > 0).alias("contaminated"), covered.alias("items"), F.size(covered).cast("long").alias("n_items"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0)).alias("max_coverage"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of docs that cover no item; all their columns."""
    clean = coverages(docs, benchmark, **how).where(~F.exists("matches", lambda m: m["coverage"] >= threshold))
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
