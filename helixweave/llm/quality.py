"""Op 8, quality rules: an isolation forest over rule statistics.

One pass computes each text's statistics. An isolation forest grows each tree on psi rows drawn from all
labelled ones, as the method has it: tree k takes the k-th psi rows in order of the hash of the id. The path length of
a row over its random splits gives its score, 2^(-mean path / expected path). The threshold comes from all
labelled rows: the score that no more than loss of the rows labelled good exceed, so clean documents stay. Of the subsets of
statistics that a forest may split on, the one is taken whose forest rejects most of all rows labelled bad at that
threshold. A document that the base rules fail is rejected without the forest.

Null and empty texts have no words and fail the base rules. Repeated rows and ids are each judged alike;
labels count once per id (a document with both labels counts as good). Without labelled rows of good quality
there is no threshold and only the base rules reject. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch, staged

#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Texts of more words than this count windows by sorted arrays instead of a table of tuples.
ARRAY_WORDS = 20_000
#: Trees of a forest, and rows that each is grown on.
TREES, PSI = 60, 256
#: Bits of a score that one pass settles when it is looked for by rank.
DIGITS = 16


def repeated_words(words: list[bytes], span: int = 5) -> int:
    """Words in windows of span words that the text has twice or more."""
    if len(words) <= span:
        return 0
    if len(words) <= ARRAY_WORDS:
        windows = list(zip(*(words[k:] for k in range(span)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        often = Counter(windows)
        starts = [i for i, w in enumerate(windows) if often[w] > 1]
        end = n = 0
        for i in starts:
            n += i + span - max(i, end)
            end = i + span
        return n
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key = ids
    for k in range(1, span):  # number pairs, then triples, and so on: exact
        _, key = np.unique(key[: len(words) - k] * len(words) + ids[k:], return_inverse=True)
    _, at, often = np.unique(key, return_inverse=True, return_counts=True)
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(often[at] > 1)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + span, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """STATS of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    lines = [x for x in text.split("\n") if SPACE.sub("", x)] if "\n" in text else []
    return (
        len(words), len(SPACE.sub("", text)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated_words(words),
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and STATS of each row."""

    def measure(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, rows.T)], names=[id_col, *STATS])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(
        measure, f"`{id_col}` {kind}, " + ", ".join(f"{s} long" for s in STATS)
    )


def shape(rows: np.ndarray) -> np.ndarray:
    """What the forest sees of STATS: word length, and symbols, repeated lines and repeated words for each word."""
    n = np.maximum(rows[:, 0], 1).astype(float)
    return np.column_stack([rows[:, 1] / n, rows[:, 2] / n, rows[:, 3] / n, rows[:, 4] / n])


def expected(n: float) -> float:
    """Mean path to a leaf of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), split, left and right child, path length at a leaf."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    psi: int = PSI
    threshold: float = math.inf

    @classmethod
    def grown(cls, x: np.ndarray, use: tuple[int, ...], trees: int = TREES, psi: int = PSI, seed: int = 7) -> Forest:
        rng = np.random.default_rng(seed)
        out = cls(psi=min(psi, len(x)))
        depth = math.ceil(math.log2(max(2, out.psi)))
        for k in range(trees if len(x) else 0):
            nodes: list[list[float]] = []

            def grow(rows: np.ndarray, level: int, nodes=nodes) -> int:
                at = len(nodes)
                nodes.append([-1, 0, 0, 0, level + expected(len(rows))])
                low, high = rows.min(0), rows.max(0)
                open_ = [f for f in use if high[f] > low[f]]
                if level < depth and len(rows) > 1 and len(open_):
                    f = int(rng.choice(open_))
                    cut = float(rng.uniform(low[f], high[f]))
                    left = rows[:, f] < cut
                    if left.any() and not left.all():
                        nodes[at][:4] = f, cut, grow(rows[left], level + 1), grow(rows[~left], level + 1)
                return at

            # rows of its own for each tree, as far as there are enough
            own = x[k * out.psi : (k + 1) * out.psi]
            grow(own if len(own) == out.psi else x[rng.choice(len(x), out.psi, replace=False)], 0)
            a = np.array(nodes)
            out.trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; anomalous rows end after few splits and come near 1."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for feature, cut, left, right, path in self.trees:
            at, live = np.zeros(len(x), int), np.arange(len(x))
            while len(live := live[feature[at[live]] >= 0]):
                f = feature[at[live]]
                at[live] = np.where(x[live, f] < cut[at[live]], left[at[live]], right[at[live]])
            total += path[at]
        return 2.0 ** (-(total / len(self.trees)) / max(expected(self.psi), 1e-9))


def base_failed(n_words, n_repeat_words):
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def labelled(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, quality of every labelled id, once."""
    some = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
    return some.groupBy(id_col).agg(F.max("quality").alias("quality"))


def forests(rows: DataFrame, id_col: str = "doc_id") -> list[Forest]:
    """A forest for each subset of statistics, without threshold; rows: id, quality, STATS."""
    # what trees are grown on: psi rows for each tree come to the driver
    some = rows.orderBy(F.xxhash64(id_col), id_col).limit(TREES * PSI).select(*STATS).collect()
    x = shape(np.array([tuple(r) for r in some], np.int64).reshape(-1, len(STATS)))
    return [Forest.grown(x, use) for k in range(1, x.shape[1] + 1) for use in itertools.combinations(range(x.shape[1]), k)]


def with_scores(rows: DataFrame, grown: list[Forest]) -> DataFrame:
    """good, forest (its number) and bits of its score, as ordered as the score, with n, the number of rows; a few rows for each batch of rows."""
    model = rows.sparkSession.sparkContext.broadcast(grown)

    def score(batches):
        for batch in batches:
            a = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).reshape(-1, 1 + len(STATS)).astype(np.int64)
            a, n = np.unique(a, axis=0, return_counts=True)
            x = shape(a[:, 1:])
            for k, forest in enumerate(model.value):
                bits = forest.scores(x).view(np.int64)  # not negative, so the bits are in order of the numbers
                yield pa.RecordBatch.from_arrays([pa.array(a[:, 0] > 0), pa.array(np.full(len(a), k)), pa.array(bits), pa.array(n)], names=["good", "forest", "bits", "n"])

    return rows.select("quality", *STATS).mapInArrow(score, "good boolean, forest long, bits long, n long")


def thresholds(scores: DataFrame, n_good: int, loss: float, forests: int) -> list[int]:
    """For each forest, bits of the score of all good rows that is int(loss * n_good) places below the highest: digit by digit, each pass counts rows by the next one."""
    prefix, above = [0] * forests, [int(loss * n_good)] * forests
    good = scores.where("good")
    for shift in range(64 - DIGITS, -1, -DIGITS):
        rows = good
        if shift + DIGITS < 64:
            known = scores.sparkSession.createDataFrame(list(enumerate(prefix)), "forest long, prefix long")
            rows = good.join(F.broadcast(known), "forest").where(F.shiftright("bits", shift + DIGITS) == F.col("prefix"))
        digit = F.shiftright("bits", shift).bitwiseAND((1 << DIGITS) - 1).alias("digit")
        counts: dict[int, list[tuple[int, int]]] = {}
        for r in rows.groupBy("forest", digit).agg(F.sum("n").alias("n")).collect():
            counts.setdefault(r.forest, []).append((r.digit, r.n))
        for k in range(forests):
            for d, n in sorted(counts[k], reverse=True):
                if above[k] < n:
                    prefix[k] = prefix[k] << DIGITS | d
                    break
                above[k] -= n
    return prefix


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", loss: float = 0.002) -> Forest:
    """The forest and its threshold, from all labelled rows."""
    where = scratch(stats.sparkSession)
    # one row for each labelled id, however often it occurs
    rows = stats.join(labelled(labels, id_col), id_col).groupBy(id_col).agg(F.max("quality").cast("long").alias("quality"), F.min(F.struct(*STATS)).alias("s")).select(id_col, "quality", "s.*")
    rows = staged(rows.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))), f"{where}/labelled")
    n_good = rows.where("quality > 0").count()
    if not n_good:
        return Forest()
    grown = forests(rows, id_col)
    scores = staged(with_scores(rows, grown), f"{where}/scores")
    limits = thresholds(scores, n_good, loss, len(grown))
    limit = stats.sparkSession.createDataFrame(list(enumerate(limits)), "forest long, most long")
    caught = scores.where("not good").join(F.broadcast(limit), "forest").where("bits > most").groupBy("forest").agg(F.sum("n").alias("n")).collect()
    most = {r.forest: r.n for r in caught}
    best = max(range(len(grown)), key=lambda k: (most.get(k, 0), -k))
    grown[best].threshold = float(np.array(limits[best], np.int64).view(np.float64))
    return grown[best]


def judged(stats: DataFrame, forest: Forest, id_col: str = "doc_id") -> DataFrame:
    """stats with base_failed, score and kept."""
    model = stats.sparkSession.sparkContext.broadcast(forest)

    def judge(batches):
        for batch in batches:
            rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).reshape(-1, len(STATS))
            failed, score = base_failed(rows[:, 0], rows[:, 4]), model.value.scores(shape(rows))
            kept = ~failed & (score <= model.value.threshold)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(failed), pa.array(score), pa.array(kept)], names=[id_col, *STATS, "base_failed", "score", "kept"]
            )

    kind = stats.schema[id_col].dataType.simpleString()
    return stats.select(id_col, *STATS).mapInArrow(
        judge, f"`{id_col}` {kind}, " + ", ".join(f"{s} long" for s in STATS) + ", base_failed boolean, score double, kept boolean"
    )


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over the texts (its small result is staged), the fit on labelled rows, the verdicts."""
    stats = staged(with_statistics(docs, id_col, text_col), f"{scratch(docs.sparkSession)}/stats")
    return judged(stats, fit(stats, labels, id_col), id_col)


def kept_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules and the forest keep, all their columns: a pass for the statistics, then one for the verdicts; no shuffle of texts."""
    model = docs.sparkSession.sparkContext.broadcast(fit(with_statistics(docs, id_col, text_col), labels, id_col))
    at = docs.columns.index(text_col)

    def judge(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in batch.column(at).to_pylist()], np.int64).reshape(-1, len(STATS))
            yield batch.filter(pa.array(~base_failed(rows[:, 0], rows[:, 4]) & (model.value.scores(shape(rows)) <= model.value.threshold)))

    return docs.mapInArrow(judge, docs.schema)
