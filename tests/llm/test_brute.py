"""Operators against plain versions, on rows with repeated and null ids, ties and long texts."""

import random
import re

import numpy as np
import pytest

pytest.importorskip("tokenizers")

from helixweave.llm import decontaminate, jaccard_join, line_dedup, quality  # noqa: E402
from helixweave.llm.terms import terms  # noqa: E402


def test_statistics_plainly():
    rng = random.Random(1)
    for _ in range(400):
        t = "".join(rng.choice(["a", "b ", "cc", " ", "\n", "#", "$x", "\t", "é ", "\x0b", " "]) for _ in range(rng.randint(0, 120)))
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        want = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)
        assert quality.statistics(t) == want


def plain_tiles(item, words, least):
    """Greedy string tiling: the longest unmarked match first, the leftmost of equal ones."""
    a, b, covered = [False] * len(item), [False] * len(words), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(words)):
                n = 0
                while i + n < len(item) and j + n < len(words) and item[i + n] == words[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = n, i, j
        n, i, j = best
        if n < least:
            return covered
        a[i : i + n], b[j : j + n] = [True] * n, [True] * n
        covered += n


def test_tiling_plainly(spark):
    rng = random.Random(2)
    said = [" ".join(rng.choice("pqrstu") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    items = [(k, " ".join(rng.choice("pqrstu") for _ in range(rng.randint(1, 16)))) for k in range(6)]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(said)] + [(None, said[3]), (7, None)], "doc_id long, text string").selectExpr("*", "1 as matches", "2 as row", "3 as h1")
    bench = spark.createDataFrame(items + [(99, None), (None, "p q r")], "item_id long, text string")
    want = {}
    for t in [*said, None]:
        w = terms(t)
        covered = {i: plain_tiles(terms(x), w, min(5, len(terms(x)))) / len(terms(x)) for i, x in items}
        want[t] = {i: c for i, c in covered.items() if c}
    for slice_bytes in (1 << 20, 20):
        out = decontaminate.coverages(docs, bench, slice_bytes=slice_bytes).collect()
        assert len(out) == docs.count()
        for r in out:
            assert {m.item: m.coverage for m in r.matches} == pytest.approx(want[r.row.text])
    clean = decontaminate.uncontaminated(docs, bench)
    assert clean.dtypes == docs.dtypes
    none = decontaminate.contamination(docs, bench.where("false"))
    assert none.count() == docs.count() and none.where("contaminated or n_items > 0").count() == 0


def test_classes_and_links_plainly(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(2000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(40, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            other = base.copy()
            for _ in range(rng.randint(1, 3)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    texts += [texts[0], texts[0].upper(), texts[5], "a b", "A B", "", None]
    rows = [(k // 2 if k % 7 == 0 else 1000 + k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (1001, texts[9])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as rep", "2 as digest")
    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.class_id if r.class_id is not None else -1, r.n_links) for r in jaccard_join.jaccard_classes(docs).collect()))

    def shingles(t):
        w = terms(t)
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    different = sorted({t for i, t in rows if i is not None and t})
    sets = {t: shingles(t) for t in different}
    near = {t: [u for u in different if u != t and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])] for t in different}
    label = {t: min(i for i, x in rows if x == t and i is not None) for t in different}
    for _ in different:
        label = {t: min([label[t], *(label[u] for u in near[t])]) for t in different}
    want = sorted((i if i is not None else -1, -1 if i is None else label[t] if t else i, len(near[t]) if t else 0) for i, t in rows)
    assert got == want


def test_lines_of_repeated_ids(spark):
    rows = [(1, "alpha beta gamma\nunique first line"), (1, "unique other row\nalpha beta gamma"), (1, "alpha beta gamma\nunique first line"), (None, "alpha beta gamma"), (2, "ALPHA, beta gamma!\n--\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as removed", "2 as n_lines", "3 as th", "4 as doc", "5 as row")
    out = line_dedup.without_lines(docs)
    assert out.dtypes == docs.dtypes
    kept = [(r.doc_id, r.text) for r in out.collect()]
    lines = [x for i, t in kept if i is not None for x in t.split("\n")]
    assert (None, "alpha beta gamma") in kept and "unique first line" in lines and "unique other row" in lines
    # the two equal rows lose the same lines
    assert lines.count("alpha beta gamma") in (1, 2) and not any(i == 2 for i, _ in kept)
    empty = line_dedup.without_lines(docs.where("false"))
    assert empty.dtypes == docs.dtypes and empty.count() == 0


def test_long_near_lines_in_pieces(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    a = [rng.choice(words) for _ in range(1500)]
    b = a.copy()
    for k in sorted(rng.sample(range(1500), 40), reverse=True):
        b[k : k + 1] = rng.choice(([], [rng.choice(words)], [b[k], "x"]))
    c = [rng.choice(words) for _ in range(1500)]
    rows = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in line_dedup.line_dedup(rows).collect()} == {1: 0, 2: 1, 3: 0}


def test_quality_of_repeated_ids(spark):
    rng = np.random.default_rng(1)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60))
    docs = spark.createDataFrame([(k % 5, text()) for k in range(30)] + [(None, text()), (9, "# $ % & " * 20)], "doc_id long, text string").selectExpr("*", "1 as _labelled", "2 as quality")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(5)] + [(9, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.kept_documents(docs, labels)
    assert out.dtypes == docs.dtypes and out.count() >= 25
    assert quality.kept_documents(docs.where("false"), labels).count() == 0
    assert quality.quality(docs.select("doc_id", "text"), labels.where("false")).where("kept = base_failed").count() == 0
