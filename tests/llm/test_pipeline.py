"""The pipeline's stages and its end against a plain Python version on a small corpus."""

import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from helixweave.llm import quality  # noqa: E402
from helixweave.llm.shared import tokenizer_path  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = ["\n".join(line(rng.randint(12, 25)) for _ in range(rng.randint(3, 6))) for _ in range(40)]
    item = line(30)
    texts.append(texts[0])  # a copy: all its lines go
    texts.append(texts[1].split("\n")[0] + "\n" + line(30))  # one line of another's
    near = texts[2].split("\n")
    texts.append("\n".join([near[0] + " zz", *near[1:], line(14)]))  # near lines and one of its own
    whole = line(80)
    texts += [whole, " ".join([*whole.split()[:40], "other", *whole.split()[41:]])]  # one line each, near in edits as in shingles
    texts += [line(20) + " " + item + " " + line(15), "too short", None, "", "same words here again " * 30]
    return [(k + 1, t, "en", "web", len(t or "")) for k, t in enumerate(texts)], item


def normal(line):
    return " ".join(re.findall(r"[^\W_]+", line.lower()))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def without_lines(docs):
    said = [(i, k, normal(x)) for i, t in docs for k, x in enumerate((t or "").split("\n")) if normal(x)]
    group = list(range(len(said)))
    for b in range(len(said)):
        for a in range(b):
            x, y = said[a][2], said[b][2]
            most = int(0.1 * max(len(x), len(y)) + 1e-9)
            if x == y or abs(len(x) - len(y)) <= most and len(set(x.split()) & set(y.split())) * 2 > len(x.split()) and edits(x, y) <= most:
                old, new = sorted((group[a], group[b]))
                group = [old if g == new else g for g in group]
    gone = {said[n][:2] for n in range(len(said)) if group[n] != n}
    out = []
    for i, t in docs:
        kept = [x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone]
        if any(j == i for j, _ in gone) and not any(normal(x) for x in kept):
            continue
        out.append((i, "\n".join(kept) if any(j == i for j, _ in gone) else t))
    return out


def shingles(t):
    w = re.findall(r"\w+", (t or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def one_of_each(docs):
    sets, kept = [(i, shingles(t)) for i, t in docs], []
    label = {i: i for i, _ in docs}
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                old, new = sorted((label[i], label[j]))
                label = {k: old if v == new else v for k, v in label.items()}
    kept = [(i, t) for i, t in docs if label[i] == i]
    return kept


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    rows, item = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 35)] + [(999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where), rows, item


def test_stages_and_run(spark, tables):
    where, rows, item = tables
    docs = spark.read.parquet(f"{where}/documents.parquet")
    plain = {
        "line_dedup": without_lines,
        "near_duplicates": one_of_each,
        "decontamination": lambda ds: [(i, t) for i, t in ds if item not in (t or "")],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
        out = stage(spark, docs, where)
        assert out.dtypes == docs.dtypes
        got = [(r.doc_id, r.text) for r in out.orderBy("doc_id").collect()]
        if name == "quality":
            failed = {i for i, t in before if (s := quality.statistics(t or ""))[0] < 10 or 100 * s[-1] > 20 * s[0]}
            assert failed.isdisjoint(i for i, _ in got) and {i for i, _ in before[:34]} - failed <= {i for i, _ in got}
        else:
            assert got == plain[name](before), name
        docs = spark.createDataFrame([r for r in out.collect()], COLUMNS)
    m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    want = {r.doc_id: m.encode(r.text or "") for r in docs.collect()}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, where).collect()}
    assert got.keys() == want.keys()
    for i, ids in want.items():
        assert (got[i].ids, got[i].n_tokens, got[i].ids_crc32) == (",".join(map(str, ids)), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_stages_of_nothing(spark, tables):
    where, _, _ = tables
    docs = spark.read.parquet(f"{where}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, where)
        assert out.dtypes == docs.dtypes and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, where).count() == 0
