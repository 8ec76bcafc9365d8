"""Op 9, n-gram Jaccard join: chosen paths.

Each text is the set of its runs of span terms (all its terms, if there are fewer). Texts of equal sets are one
representative, so copies cost one group-by. Representatives then go down random trees: a node picks, by a hash of its
path, each of the set's 128 min-wise tokens (a shared random sample of its tokens) with chance branch / 128; a child is a
path with that token. Two sets of Jaccard J meet in a given child with chance J. Buckets of at most leaf sets stop;
larger ones split on, to depth levels; what is still large then is compared as it is, so no bucket is capped. Trees are
repeated until a pair at the threshold meets with the target recall, by the survival of the branching process.

Sets that meet and whose 8-bit sketches agree in 66 % or more (0.8 less four standard deviations) join a candidate
group. Within each group all pairs are verified exactly. Buckets and groups of more than a block are dealt into blocks, and
each block is packed into one row: what is sent again for each pair of blocks are these rows, not the documents. What
leaves a task is, per representative, its number of links and one edge to its group's root: no pair rows.

Result: one row per input row: id, class_id (smallest id that links reach), n_links (other texts at the threshold or
above; texts are told apart by a 64-bit hash, so copies count once and texts of equal sets, such as other case, count
each). Null and empty texts have no set: a class each, no link. Rows of equal id each go by their text: their class is that
text's. Null ids give a null class and found no class. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Staging
from .terms import Hashes, hashed, runs, terms, windows

SPAN, THRESHOLD = 5, 0.8
T, BRANCH, DEPTH = 128, 2.0, 4
#: Rows, and bytes of tokens, that a block holds on average. A bucket of one block is compared as it is (4,096 sketches of
#: 128 bytes: a second at most where none agree), so splitting it would only make more rows.
BLOCK, BLOCK_BYTES = 4096, 8 << 20
LEAF = BLOCK
#: Bits of the filter that picks texts to be read again: 2 MB, whatever the input.
FILTER_BITS = 1 << 24
LOOSE = 0.66

_rng = np.random.default_rng(20_250_101)
MULT = (_rng.integers(0, 1 << 63, T, np.uint64) << np.uint64(1)) | np.uint64(1)
ADD = _rng.integers(0, 1 << 63, T, np.uint64)


def runs_for(recall: float, threshold: float, branch: float = BRANCH, depth: int = DEPTH) -> int:
    """Trees until a pair at the threshold shares a leaf of some tree with this chance."""
    alive = 1.0
    for _ in range(depth):
        alive = 1 - math.exp(-branch * threshold * alive)
    return math.ceil(math.log(1 - recall) / math.log(1 - alive))


def shingles(text: str | None, memo: Hashes, span: int = SPAN) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of span terms."""
    words = terms(text)
    return np.unique(windows(hashed(words, memo), min(span, len(words)))) if words else np.empty(0, np.uint64)


def minwise(s: np.ndarray) -> np.ndarray:
    """The smallest of T hashes of the set, 32 bits each."""
    out = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        x = s[k : k + 2048, None] * MULT + ADD
        x ^= x >> np.uint64(32)
        out = np.minimum(out, x.min(0))
    return (out >> np.uint64(16)).astype(np.uint32)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_COORD = np.arange(1, T + 1, dtype=np.uint64)


def children(paths: np.ndarray, sigs: np.ndarray, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) of every token that a row's path picks."""
    dice = mixed(paths[:, None], np.broadcast_to(_COORD, (len(paths), T)))
    row, at = np.nonzero((dice >> np.uint64(11)).astype(np.float64) / (1 << 53) < branch / T)
    return row, mixed(dice[row, at], sigs[row, at].astype(np.uint64))


def local_roots(n: int, alike) -> np.ndarray:
    """Smallest row of each row's component; alike(k, rows): which of rows are like row k."""
    root, open_ = np.full(n, -1), np.arange(n)
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start], todo = start, [start]
        open_ = open_[root[open_] < 0]
        while todo and len(open_):
            hit = open_[alike(todo.pop(), open_)]
            root[hit] = start
            todo.extend(hit.tolist())
            open_ = open_[root[open_] < 0]
    return root


def packed(rows: DataFrame, key: str, n_blocks: str, names: list[str]) -> DataFrame:
    """rows of groups dealt into n_blocks blocks: (key, i, j, part, and each of names packed) for each pair of blocks i <= j.

    part is the block's own number; names are longs, or binaries whose lengths the reader knows.
    """
    own = rows.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(1)), F.col(n_blocks)).cast("int"))

    def pack(batches):
        for group in runs(batches, [key, "part"]):
            cols = [group.column(0)[:1], group.column(1)[:1], group.column(2)[:1]]
            cols += [pa.array([c.to_numpy().tobytes() if pa.types.is_int64(c.type) else b"".join(c.to_pylist())], pa.binary()) for c in group.columns[3:]]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[key, "part", "n", *names])

    shape = f"{key} long, part int, n int, " + ", ".join(f"{x} binary" for x in names)
    blocks = own.select(key, "part", F.col(n_blocks).cast("int").alias("n"), *names).repartition(key, "part").sortWithinPartitions(key, "part", "rep").mapInArrow(pack, shape)
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return pairs.select(key, F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", *names).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", "part")


def signed(docs: DataFrame, id_col: str, text_col: str, span: int) -> DataFrame:
    """doc, th (hash of the text), digest of its set, its size, signature; the last three are null where there are no terms."""

    def sign(batches):
        memo = Hashes()
        for batch in batches:
            digests, sizes, sigs = [], [], []
            for t in batch.column(2).to_pylist():
                s = shingles(t, memo, span)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sizes.append(len(s) or None)
                sigs.append(minwise(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())],
                                             names=["doc", "th", "digest", "size", "sig"])

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(
        sign, "doc long, th long, digest binary, size long, sig binary")


def candidates(reps: DataFrame, stage: Staging, recall: float, threshold: float) -> DataFrame:
    """Links (a, b) that make the candidate groups of reps (rep, sig)."""
    n_runs = runs_for(recall, threshold)
    shape = "bucket long, rep long"

    def planted(batches):
        seeds = mixed(np.arange(1, n_runs + 1, dtype=np.uint64), np.full(n_runs, 77, np.uint64))
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, T)
            reps = batch.column(0).to_numpy()
            row, path = children(np.tile(seeds, len(reps)), np.repeat(sigs, n_runs, 0), BRANCH)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(reps[row // n_runs])], names=["bucket", "rep"])

    def split(batches):
        for batch in batches:
            sigs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, T)
            row, path = children(batch.column(0).to_numpy().view(np.uint64), sigs, BRANCH)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(batch.column(1).to_numpy()[row])], names=["bucket", "rep"])

    def alike(sketch: np.ndarray):
        return lambda k, rows: (sketch[rows] == sketch[k]).mean(1) >= LOOSE

    def edges(reps: np.ndarray, root: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(reps[far]), pa.array(reps[root][far])], names=["a", "b"])

    def linked(batches):
        for group in runs(batches, ["bucket"]):
            reps = group["rep"].to_numpy()
            root = local_roots(len(reps), alike(np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, T)))
            yield edges(reps, root, root != np.arange(len(reps)))

    def linked_blocks(batches):
        for group in runs(batches, ["bucket", "i", "j"]):
            parts = [np.frombuffer(b, np.int64) for b in group["rep"].to_pylist()]
            reps, own = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(-1, T)
            root = local_roots(len(reps), alike(sketch))
            far = root != np.arange(len(reps))
            if len(parts) > 1:  # what hangs together within a block is linked in the block's own pair: one edge for each such part
                for side in (0, 1):
                    at = np.flatnonzero(own == side)
                    far[at[local_roots(len(at), alike(sketch[at])) != np.arange(len(at))]] = False
            yield edges(reps, root, far)

    nodes = reps.select("rep", "sig").mapInArrow(planted, shape)
    leaves, held = None, []
    for level in range(1, DEPTH + 1):
        nodes = stage.put(nodes, f"nodes{level}", free=False)
        sizes = nodes.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        live = stage.put(nodes.join(sizes, "bucket"), f"live{level}")
        stage.drop(nodes)
        held.append(live)
        done = live if level == DEPTH else live.where(F.col("n") <= LEAF)
        leaves = done if leaves is None else leaves.unionByName(done)
        if level == DEPTH:
            break
        large = live.where(F.col("n") > LEAF)
        if large.isEmpty():
            break
        nodes = large.select("bucket", "rep").join(reps.select("rep", "sig"), "rep").select("bucket", "rep", "sig").mapInArrow(split, shape)
    leaves = leaves.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).join(reps.select("rep", "sketch"), "rep")
    # in order of rep, each part's root is its smallest rep, so many trees give the same link and distinct() keeps it once
    ones = leaves.where("blocks = 1").select("bucket", "rep", "sketch").repartition("bucket").sortWithinPartitions("bucket", "rep").mapInArrow(linked, "a long, b long")
    many = packed(leaves.where("blocks > 1"), "bucket", "blocks", ["rep", "sketch"]).mapInArrow(linked_blocks, "a long, b long")
    links = stage.put(ones.unionByName(many).distinct(), "candidates")
    stage.drop(*held)
    return links


def counted(reps: np.ndarray, own: np.ndarray, weight: np.ndarray, size: np.ndarray, tokens: np.ndarray, threshold: float, across: bool) -> pa.RecordBatch:
    """(rep, root, links): root by all links here; links of the weights of near sets, of the other block alone if across."""
    owner = np.repeat(np.arange(len(reps)), size)
    order = np.argsort(tokens, kind="stable")
    ranked, by = tokens[order], owner[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(ranked)))
    place = np.empty(len(tokens), np.int64)
    place[order] = np.cumsum(new) - 1
    cut = np.concatenate([[0], np.cumsum(size)])
    links, root = np.zeros(len(reps), np.int64), np.full(len(reps), -1)
    for start in range(len(reps)):
        if root[start] >= 0:
            continue
        root[start], todo = start, [start]
        while todo:  # every rep is looked at once
            k = todo.pop()
            at = place[cut[k] : cut[k + 1]]
            at = at[n[at] > 1]
            where = np.repeat(begin[at] - (np.cumsum(n[at]) - n[at]), n[at]) + np.arange(n[at].sum())
            both = np.bincount(by[where], minlength=len(reps))
            near = both >= threshold * (size + size[k] - both) - 1e-9
            near[k] = False
            links[k] = weight[near & (own != own[k]) if across else near].sum()
            hit = np.flatnonzero(near & (root < 0))
            root[hit] = start
            todo.extend(hit.tolist())
    return pa.RecordBatch.from_arrays([pa.array(reps), pa.array(reps[root]), pa.array(links)], names=["rep", "root", "links"])


def verified(sets: DataFrame, stage: Staging, threshold: float) -> DataFrame:
    """sets: grp, n, bytes (of its tokens), rep, weight, tokens of candidate groups. (rep, root, links): of each pair of blocks, links of each rep there and its root by them."""
    shape = "rep long, root long, links long"

    def verify(batches):
        for group in runs(batches, ["grp"]):
            size = np.array([len(b) // 8 for b in group["tokens"].to_pylist()], np.int64)
            tokens = np.frombuffer(b"".join(group["tokens"].to_pylist()), np.uint64)
            yield counted(group["rep"].to_numpy(), np.zeros(len(size), np.int64), group["weight"].to_numpy(), size, tokens, threshold, False)

    def verify_blocks(batches):
        for group in runs(batches, ["grp", "i", "j"]):
            of = lambda name, kind: [np.frombuffer(b, kind) for b in group[name].to_pylist()]  # noqa: B023, E731
            reps = of("rep", np.int64)
            own = np.repeat(np.arange(len(reps)), [len(x) for x in reps])
            yield counted(np.concatenate(reps), own, *[np.concatenate(of(x, np.int64)) for x in ("weight", "size")], np.concatenate(of("tokens", np.uint64)), threshold, len(reps) > 1)

    sets = sets.withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int"))
    ones = sets.where("blocks = 1").select("grp", "rep", "weight", "tokens").repartition("grp").sortWithinPartitions("grp", "rep").mapInArrow(verify, shape)
    many = packed(sets.where("blocks > 1").withColumn("size", (F.length("tokens") / 8).cast("long")), "grp", "blocks", ["rep", "weight", "size", "tokens"]).mapInArrow(verify_blocks, shape)
    return ones.unionByName(many)


def slot():
    return F.pmod(F.xxhash64("doc", "th"), F.lit(FILTER_BITS)).alias("slot")


def picked(members: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits of members' (doc, th): texts that aren't in it need not be read again; the join that follows is exact."""
    words = members.select(slot()).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint8)


def jaccard_classes(docs: DataFrame, span: int = SPAN, threshold: float = THRESHOLD, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, n_links of each row."""
    stage = Staging(docs.sparkSession)
    sets = stage.put(signed(docs, id_col, text_col, span), "sets", free=False)
    texts = sets.where("digest is not null and doc is not null").groupBy("digest", "th").agg(F.min("doc").alias("doc"), F.first("size").alias("size"))
    first = texts.groupBy("digest").agg(F.min(F.struct("doc", "th")).alias("r"), F.count("*").alias("weight"), F.first("size").alias("size"))
    # the number is written with the row, so it stays the same in every later read
    named = stage.put(first.select(F.monotonically_increasing_id().alias("rep"), "digest", "r.doc", "r.th", "weight", "size"), "named")
    own = sets.join(named.select("rep", "doc", "th", F.col("digest").alias("d")), ["doc", "th"]).where("digest = d").dropDuplicates(["rep"])

    def sketched(batches):
        for batch in batches:
            sketch = [(np.frombuffer(b, np.uint32) & np.uint32(255)).astype(np.uint8).tobytes() for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketch, pa.binary())], names=["rep", "sig", "sketch"])

    reps = stage.put(own.select("rep", "sig").mapInArrow(sketched, "rep long, sig binary, sketch binary"), "reps")
    links = candidates(reps, stage, recall, threshold)
    stage.drop(reps)
    groups = components(links, stage, "groups")
    stage.drop(links)
    members = groups.select(F.col("label").alias("grp"), F.col("node").alias("rep")).join(named.select("rep", "doc", "th", "weight", "size"), "rep")
    sizes = members.groupBy("grp").agg(F.count("*").alias("n"), (8 * F.sum("size")).alias("bytes"))
    members = stage.put(members.join(sizes, "grp").drop("size"), "members")

    wanted = docs.sparkSession.sparkContext.broadcast(picked(members))

    def tokens(batches):
        memo, bits = Hashes(), wanted.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
            got = [shingles(t, memo, span).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(got, pa.binary())], names=["doc", "th", "tokens"])

    text = F.col(text_col).cast("string")
    said = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("th"), text.alias("text")).where("doc is not null")
    said = said.select("doc", "th", slot(), "text").mapInArrow(tokens, "doc long, th long, tokens binary").join(members, ["doc", "th"]).dropDuplicates(["rep"])
    said = stage.put(said.select("grp", "n", "bytes", "rep", "weight", "tokens"), "tokens")
    found = stage.put(verified(said, stage, threshold), "verified")
    stage.drop(said, members, groups)
    labels = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), stage, "classes")
    counts = found.groupBy("rep").agg(F.sum("links").alias("others"))
    whole = named.select("rep", "digest", "doc", "weight").join(counts, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    smallest = whole.where("label is not null").groupBy("label").agg(F.min("doc").alias("class"))
    of_rep = whole.join(smallest, "label", "left").select("digest", F.coalesce("class", "doc").alias("class"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    of_rep = stage.put(of_rep, "classed")
    stage.drop(found, labels, named)
    return (sets.select("doc", "digest").join(of_rep, "digest", "left")
            .select(F.col("doc").alias(id_col), F.when(F.col("doc").isNotNull(), F.coalesce("class", "doc")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
