"""Op 6, SentencePiece encoding and decoding: a lattice of pieces over each distinct word.

Texts are cut into words (runs of the space mark with what follows, line ends alone) that no piece crosses. Words are
exploded into substrings no longer than the longest piece and equi-joined with the piece table; the edges of a word are
grouped and folded:

- unigram models: Viterbi, the best sum of scores at each end;
- BPE models: edges in order of rank, each merging the two symbols that it spans at its turn. Viterbi would
  maximise another quantity than BPE does and give other ids than the library, so it isn't used for these.

``encode`` does this within the tasks that hold the texts, on Arrow batches: explode, join (by hash, equal hashes count
only with equal letters) and fold take all new words of a batch at once, and a worker remembers up to MEMO words. No row
is shuffled. ``encoded_words`` is the same lattice as a Spark plan (explode, broadcast join, grouping, fold by
higher-order ``aggregate``) over a table of words; for whole texts that form missed its limits (README), as words and
their ids must be sent to the texts' tasks and back.

Characters without a piece become their bytes' pieces. Null and empty texts have no ids and decode to the empty text.
Words of any length are folded in n log n steps. Rows of equal id are encoded each by its own text. Other columns are
ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import folding
from .shared import tokenizer_path
from .wordbpe import Numbers

MARK = "▁"
WORD = re.compile("▁*[^▁\n]+|▁+|\n")
#: Words that a worker remembers until it starts over; characters of texts, and of words, that are taken at once.
MEMO, PART, FOLD = 400_000, 1 << 20, 1 << 18


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> tuple[list[tuple[str, int, float]], int, list[bytes]]:
    """(piece, id, score) of the ordinary pieces, the id of byte 0, and the bytes of each id."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    special = [m.is_control(i) or m.is_unknown(i) or m.is_unused(i) for i in range(n)]
    first = next(i for i in range(n) if m.is_byte(i))
    table = [(m.id_to_piece(i), i, m.get_score(i)) for i in range(n) if not special[i] and not m.is_byte(i)]
    if any("\n" in p or MARK in p.lstrip(MARK) for p, _, _ in table):
        raise ValueError("a piece crosses words")
    raw = [b"" if special[i] else bytes([i - first]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
    return table, first, raw


def odd_pieces(rank: dict[str, int]) -> set[str]:
    """Pieces that rank before a part of theirs: only these can come due after their turn."""
    late = lambda p, part: len(part) > 1 and rank[part] > rank[p]
    return {p for p in rank for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank and (late(p, p[:i]) or late(p, p[i:]))}


#: An edge as one long, in order of turn (rank + 1, 0: no piece; 20 bits), start (30), length (12) and whether it is odd (1).
TURN, START, LENGTH, ODD = "shiftrightunsigned({x}, 43)", "cast(shiftrightunsigned({x}, 13) & 1073741823 as int)", "cast(shiftrightunsigned({x}, 1) & 4095 as int)", "({x} & 1) = 1"


def edges(words: DataFrame, ranked: list[tuple[str, int, float]]) -> DataFrame:
    """words: distinct rows of h, word and others. These with packed, their edges as sorted longs; h, a hash of the word, leads the keys so that the sort behind the grouping compares longs."""
    rank = {p: k for k, (p, _, _) in enumerate(ranked)}
    odd, longest = odd_pieces(rank), max(map(len, rank))
    table = words.sparkSession.createDataFrame([(p, (k + 1 << 43) + (p in odd)) for p, k in rank.items()], "known string, turn long").coalesce(1).withColumn("kh", F.xxhash64("known"))
    own = words.columns
    at = words.select(*own, F.explode(F.sequence(F.lit(1), F.length("word"))).alias("s"))
    sub = at.select(*own, "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("s") + 1))).alias("l"))
    sub = sub.withColumn("piece", F.substring("word", F.col("s"), F.col("l")))
    # the probe is of longs; equal hashes count only with equal strings
    found = sub.withColumn("ph", F.xxhash64("piece")).join(F.broadcast(table), F.expr("ph = kh and startswith(known, piece) and startswith(piece, known)"), "left").where("turn is not null or l = 1")
    packed = F.coalesce("turn", F.lit(0).cast("long")).bitwiseOR(F.shiftleft(F.col("s").cast("long"), 13)).bitwiseOR(F.shiftleft(F.col("l").cast("long"), 1))
    return found.groupBy(*own).agg(F.sort_array(F.collect_list(packed)).alias("packed"))


def over(cuts: str, x: str) -> str:
    """The cuts that edge x spans, both ends included."""
    return f"substring({cuts}, {START.format(x=x)}, {LENGTH.format(x=x)} + 1)"


def shapes(longest: int, inner: int) -> str:
    """By length, the cuts of an edge with both ends cut and so many cuts inside (0 or 1), as an array<array<binary>>."""
    def of(n: int) -> list[bytes]:
        flat = [b"1" + b"0" * (n - 1) + b"1"] if n else []
        return flat if not inner else [x[:k] + b"1" + x[k + 1 :] for x in flat for k in range(1, n)]

    return "array({})".format(", ".join("cast(array({}) as array<binary>)".format(", ".join(f"X'{x.hex()}'" for x in of(n))) for n in range(longest + 1)))


def merged(lattice: DataFrame, longest: int) -> DataFrame:
    """BPE: lattice with cuts, a byte for each place between characters: 1 where a symbol begins or the word ends, else 0.

    An edge is due if it has one cut inside. One fold in order of (rank, start) is BPE as long as no edge comes due
    after its turn; the fold looks for that after each merge, and a word where it happens is merged step by step,
    the first edge due each time.
    """
    one = shapes(longest, 1)
    due = lambda cuts, x: f"array_contains(get({one}, {LENGTH.format(x=x)}), {over(cuts, x)})"
    fused = lambda cuts, x: f"overlay({cuts} placing cast(repeat('0', {LENGTH.format(x=x)} - 1) as binary) from {START.format(x=x)} + 1)"
    start = "cast(repeat('1', length(word) + 1) as binary)"
    lattice = lattice.withColumn("pairs", F.expr(f"filter(packed, x -> {LENGTH.format(x='x')} > 1)")).withColumn("odds", F.expr(f"filter(pairs, x -> {ODD.format(x='x')})"))
    late = f"exists(odds, y -> y < x and {due(fused('a.cuts', 'x'), 'y')})"
    lattice = lattice.withColumn("once", F.expr(f"""aggregate(pairs, struct({start} as cuts, false as late), (a, x) ->
        if(not a.late and {due('a.cuts', 'x')}, struct({fused('a.cuts', 'x')} as cuts, {late} as late), a))"""))
    # an edge of one character fuses nothing: the last merge has been made
    step = f"transform(slice(filter(pairs, x -> {due('c', 'x')}), 1, 1), x -> {fused('c', 'x')})"
    slow = f"aggregate(sequence(1, length(word)), {start}, (c, k) -> coalesce(get({step}, 0), c))"
    return lattice.withColumn("cuts", F.expr(f"if(once.late, {slow}, once.cuts)"))


def viterbi(lattice: DataFrame, scores: Column, unknown: float = -1e4) -> DataFrame:
    """Unigram: lattice with cuts of the best path, as in ``merged``. Ties go to the edge that begins first."""
    n = F.length("word")
    of = lambda what: F.expr(f"transform(packed, x -> {what.format(x='x')})")
    lattice = lattice.select("*", F.arrays_zip(of(TURN).alias("turn"), of(START).alias("s"), of(LENGTH).alias("l")).alias("edges"))
    state = F.struct(F.lit(0.0).alias("best"), F.lit(0).alias("back"))
    start = F.array_append(F.array_repeat(F.struct(F.lit(float("-inf")).alias("best"), F.lit(0).alias("back")), n), state)
    # place p (1 to n + 1) is kept at p - 2, place 1 last
    start = F.concat(F.slice(start, 1, n), F.array(state))
    by_end = F.sort_array(F.transform("edges", lambda x: F.struct((x["s"] + x["l"]).alias("e"), x["s"].alias("s"), F.coalesce(F.get(scores, x["turn"].cast("int") - 1), F.lit(unknown)).alias("w"))))
    slot = lambda p: F.when(p == 1, n).otherwise(p - 2)

    def relax(best: Column, x: Column) -> Column:
        new = F.get(best, slot(x["s"]))["best"] + x["w"]
        return F.when(new > F.get(best, slot(x["e"]))["best"], F.transform(
            best, lambda v, i: F.when(i == slot(x["e"]), F.struct(new.alias("best"), x["s"].alias("back"))).otherwise(v))).otherwise(best)

    lattice = lattice.withColumn("best", F.aggregate(by_end, start, relax))
    best = F.col("best")
    path = F.aggregate(F.sequence(F.lit(1), n), F.array(n + 1), lambda p, _: F.when(F.element_at(p, -1) == 1, p).otherwise(
        F.array_append(p, F.get(best, slot(F.element_at(p, -1)))["back"])))
    lattice = lattice.withColumn("path", path)
    return lattice.withColumn("cuts", F.array_join(F.transform(F.sequence(F.lit(1), n + 1), lambda s: F.when(F.array_contains("path", s), "1").otherwise("0")), "").cast("binary"))


def encoded_words(words: DataFrame, path: str, unigram: bool = False, table: list | None = None, byte_id: int | None = None) -> DataFrame:
    """words: distinct rows of h (xxhash64 of word), word and others, in partitions by word. These and ids array<int>."""
    rows, first, _ = pieces(path) if table is None else (table, byte_id, None)
    ranked = sorted(rows, key=lambda r: (-r[2], r[1]))
    ids_of, scores = (F.expr(f"cast(split('{','.join(map(str, x))}', ',') as array<{kind}>)") for x, kind in (([i for _, i, _ in ranked], "int"), ([w for _, _, w in ranked], "double")))
    lattice = edges(words, ranked)
    longest = max(len(p) for p, _, _ in rows)
    lattice = viterbi(lattice, scores) if unigram else merged(lattice, longest)
    flat = f"transform({shapes(longest, 0)}, x -> coalesce(get(x, 0), X''))"
    # start and turn of the edges taken, in order of start
    taken = f"sort_array(transform(filter(packed, x -> {over('cuts', 'x')} = get({flat}, {LENGTH.format(x='x')})), x -> shiftleft(cast({START.format(x='x')} as long), 27) | {TURN.format(x='x')}))"
    lattice = lattice.select(*words.columns, F.expr(taken).alias("taken"))
    turn = lambda x: x.bitwiseAND((1 << 27) - 1).cast("int")
    hexa = lambda x: F.hex(F.encode(F.substring("word", F.shiftrightunsigned(x, 27).cast("int"), F.lit(1)), "UTF-8"))
    spelled = lambda x: F.transform(F.sequence(F.lit(0), (F.length(hexa(x)) / 2 - 1).cast("int")), lambda k: F.conv(F.substring(hexa(x), 2 * k + 1, F.lit(2)), 16, 10).cast("int") + first)
    ids = F.when(F.exists("taken", lambda x: turn(x) == 0), F.flatten(F.transform("taken", lambda x: F.when(
        turn(x) > 0, F.array(F.get(ids_of, turn(x) - 1))).otherwise(spelled(x))))).otherwise(F.transform("taken", lambda x: F.get(ids_of, turn(x) - 1)))
    return lattice.select(*words.columns, ids.alias("ids"))


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK)


class Lattice:
    """Pieces by length and hash; words numbered so far and their ids."""

    MULT = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, table: list[tuple[str, int, float]], byte_id: int, unigram: bool = False):
        ranked = sorted(table, key=lambda r: (-r[2], r[1]))
        self.rank = {p: k for k, (p, _, _) in enumerate(ranked)}
        self.ids, self.scores = np.array([i for _, i, _ in ranked], np.int64), np.array([w for _, _, w in ranked])
        self.byte_id, self.unigram, self.longest = byte_id, unigram, max(map(len, self.rank))
        self.by_length = {}
        for n in sorted({len(p) for p in self.rank}):
            own = [p for p in self.rank if len(p) == n]
            letters = codes("".join(own)).reshape(-1, n)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = self.longer(h, letters[:, k])
            order = np.argsort(h)
            self.by_length[n] = h[order], letters[order], np.array([self.rank[p] for p in own], np.int64)[order]
        self.forget()

    def forget(self) -> None:
        self.numbers, self.flat = Numbers(), np.empty(0, np.int32)
        self.start, self.size_of = np.empty(0, np.int64), np.empty(0, np.int64)

    def longer(self, h: np.ndarray, letter: np.ndarray) -> np.ndarray:
        h = (h ^ letter.astype(np.uint64)) * self.MULT
        return h ^ (h >> np.uint64(29))

    def edges(self, letters: np.ndarray, room: np.ndarray) -> np.ndarray:
        """[length, place]: rank of the piece of that length from that place on, or NONE. room: letters from a place to its word's end."""
        out = np.full((self.longest + 1, len(letters)), folding.NONE)
        at, h = np.arange(len(letters)), np.zeros(len(letters), np.uint64)
        for n in range(1, self.longest + 1):
            some = room[at] >= n
            at, h = at[some], h[some]
            h = self.longer(h, letters[at + n - 1])
            if n not in self.by_length or not len(at):
                continue
            known, spelled, ranks = self.by_length[n]
            found = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = np.flatnonzero(known[found] == h)
            hit = hit[(letters[at[hit][:, None] + np.arange(n)] == spelled[found[hit]]).all(1)]
            out[n, at[hit]] = ranks[found[hit]]
        return out

    def best(self, edge: np.ndarray, n: int) -> list[tuple[int, int]]:
        """Viterbi over one word: (start, end) of each piece of the best path; a letter without a piece counts far below any. Ties go to the piece that begins first."""
        score, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        unknown = min(self.scores.min(), 0.0) - 1e4
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                r = edge[e - s, s]
                w = score[s] + (self.scores[r] if r != folding.NONE else unknown if e - s == 1 else -np.inf)
                if w > score[e]:
                    score[e], back[e] = w, s
        path = [n]
        while path[-1]:
            path.append(back[path[-1]])
        return list(zip(path[:0:-1], path[-2::-1], strict=True))

    def fold(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters, first = codes("".join(words)), np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        edge = self.edges(letters, (first + size)[word] - np.arange(len(letters)))
        if self.unigram:
            spans = [(k, a, b) for k in range(len(words)) for a, b in self.best(edge[:, first[k] : first[k] + size[k]], int(size[k]))]
        else:
            spans = [(k, a, b) for k in np.flatnonzero(size > folding.LONG) for a, b in folding.folded_alone(int(size[k]), lambda a, b, w=words[k]: self.rank.get(w[a:b]) if b - a <= self.longest else None)]
        odd = np.array(spans, np.int64).reshape(-1, 3)
        starts, lengths, of = first[odd[:, 0]] + odd[:, 1], odd[:, 2] - odd[:, 1], odd[:, 0]
        if not self.unigram:
            # a symbol is its start * (longest + 1) + its length
            step = self.longest + 1

            def pair(left, right):
                at, n = left // step, left % step + right % step
                fits = n <= self.longest
                return np.where(fits, edge[np.where(fits, n, 0), at], folding.NONE), at * step + n

            short = np.flatnonzero((size <= folding.LONG)[word])
            sym, owner = folding.folded(short * step + 1, word[short], pair)
            starts, lengths, of = np.concatenate([sym // step, starts]), np.concatenate([sym % step, lengths]), np.concatenate([owner, of])
            order = np.argsort(starts)
            starts, lengths, of = starts[order], lengths[order], of[order]
        rank = edge[lengths, starts]
        ids = np.where(rank == folding.NONE, -1, self.ids[np.where(rank == folding.NONE, 0, rank)])
        out = np.split(ids, np.cumsum(np.bincount(of, minlength=len(words)))[:-1])
        for k in np.unique(of[ids < 0]):
            own = np.flatnonzero(of == k)
            out[k] = np.array([i for j in own for i in ([ids[j]] if ids[j] >= 0 else [self.byte_id + b for b in chr(letters[starts[j]]).encode()])], np.int64)
        return out

    def learn(self) -> None:
        fresh, self.numbers.fresh = self.numbers.fresh, []
        own: list[np.ndarray] = []
        k = 0
        while k < len(fresh):
            stop, size = k, 0
            while stop < len(fresh) and size < FOLD:
                size += len(fresh[stop])
                stop += 1
            own += self.fold(fresh[k:stop])
            k = stop
        if own:
            size = np.fromiter(map(len, own), np.int64, len(own))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size_of = np.concatenate([self.size_of, size])
            self.flat = np.concatenate([self.flat, *own]).astype(np.int32)

    def encode(self, texts: list[str | None]):
        """Ids of each text, as arrays."""
        k = 0
        while k < len(texts):
            said, size = [], 0
            while k < len(texts) and size < PART:
                said.append(WORD.findall(marked(texts[k])) if texts[k] else [])
                size += len(texts[k] or "")
                k += 1
            lengths = np.fromiter(map(len, said), np.int64, len(said))
            at = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(said)), np.int64, lengths.sum())
            self.learn()
            n = self.size_of[at]
            total = np.concatenate([[0], np.cumsum(n)])
            ids = self.flat[np.repeat(self.start[at] - total[:-1], n) + np.arange(total[-1])]
            cuts = total[np.concatenate([[0], np.cumsum(lengths)])].tolist()
            yield from (ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
            if len(self.numbers) > MEMO:
                self.forget()


def codes(letters: str) -> np.ndarray:
    return np.frombuffer(letters.encode("utf-32-le"), "<u4")


def decoded(ids: list[int], raw: list[bytes]) -> bytes:
    """The text of ids: pieces' bytes joined, without the first mark."""
    return b"".join([raw[i] for i in ids])[1:]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), n_byte_tokens, round_trip (whether the ids decode to the text); with ids=True also ids array<int>."""
    table, first_byte, raw = pieces(path or tokenizer_path("piece_bpe_32k.model"))
    shared = docs.sparkSession.sparkContext.broadcast((table, first_byte, raw))

    def coded(batches):
        table, first, raw = shared.value
        lattice = Lattice(table, first)
        for batch in batches:
            cols: dict[str, list] = {k: [] for k in ("n", "crc", "byte", "same", "ids")}
            texts = batch.column(1).to_pylist()
            for t, a in zip(texts, lattice.encode(texts), strict=True):
                cols["n"].append(len(a)), cols["crc"].append(zlib.crc32(a.astype("<u4").tobytes()))
                cols["byte"].append(int(((a >= first) & (a < first + 256)).sum()))
                cols["same"].append(decoded(a.tolist(), raw) == (t or "").encode())
                if ids:
                    cols["ids"].append(a)
            out = {id_col: batch.column(0), "n_tokens": pa.array(cols["n"], pa.int64()), "ids_crc32": pa.array(cols["crc"], pa.int64()),
                   "n_byte_tokens": pa.array(cols["byte"], pa.int64()), "round_trip": pa.array(cols["same"], pa.bool_())}
            yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(cols["ids"], pa.list_(pa.int32()))} if ids else {}))

    shape = f"`{id_col}` long, n_tokens long, ids_crc32 long, n_byte_tokens long, round_trip boolean" + ", ids array<int>" * ids
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(coded, shape)


def decode(rows: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the text of their ids as their last column. Null ids decode to null."""
    if text_col in rows.columns:
        raise ValueError(f"there is a column {text_col} already")
    raw = rows.sparkSession.sparkContext.broadcast(pieces(path or tokenizer_path("piece_bpe_32k.model"))[2])
    at = rows.columns.index(ids_col)

    def spelled(batches):
        for batch in batches:
            texts = [None if i is None else decoded(i, raw.value).decode("utf-8", "replace") for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return rows.mapInArrow(spelled, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{text_col}` string")


def spark_words(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string").repartition("word").select(F.xxhash64("word").alias("h"), "word")
