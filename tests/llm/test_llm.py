"""Operators against brute force on small fixtures with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from helixweave.llm import decontaminate, jaccard_join, license_scan, line_dedup, piece_lattice, quality, rans, secrets, substring_dedup, token_counts, token_files  # noqa: E402
from helixweave.llm.shared import scratch, tokenizer_path  # noqa: E402

PASSAGE = " ".join(f"word{k}" for k in range(60))
OTHER = " ".join(f"term{k * 7 % 53}" for k in range(200))
TEXTS = [
    (1, PASSAGE), (2, "x y " + PASSAGE + " z"), (3, PASSAGE), (4, None), (5, ""), (6, " \n\t"), (7, OTHER), (8, OTHER.replace("term7 ", "other ")),
    (9, "It's <|endoftext|> ΑΣ Σ é漢 x² 12 a"), (10, "a" * 3000), (11, "line one here\nLine, ONE here!\n\nlast"), (12, PASSAGE + " " + PASSAGE),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("n_tokens", F.lit(-1)).withColumn("chunk", F.lit("x")).withColumn("source", F.lit("s"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def ids():
    t = tokenizers.Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in TEXTS}


def test_token_counts(docs, empty, ids):
    rows = {r.doc_id: r for r in token_counts.token_counts(docs, limit=50).collect()}
    for i, x in TEXTS:
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len((x or "").encode()), len(ids[i]), len(ids[i]) > 50)
    assert token_counts.token_counts(empty).count() == 0


@pytest.mark.parametrize("block", [1 << 17, 40])
def test_token_files(spark, docs, ids, block):
    where = scratch(spark)
    token_files.write(docs, where, block_tokens=block)
    at = 0
    for r in token_files.documents(spark, where).orderBy("start").collect():
        own = [*ids[r.doc_id], 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)


def test_token_files_of_nothing(spark, empty):
    assert token_files.token_files(empty).count() == 0


def test_rans_round_trip_and_checksum():
    rng = np.random.default_rng(1)
    ids = (rng.pareto(1, 5000) * 3).astype(np.uint32) % 500
    table = rans.Table(rans.scaled(np.bincount(ids, minlength=500), 12), 12)
    block = rans.pack(table, ids, np.zeros((1, rans.PIECE), np.int64))
    assert (rans.unpack(table, block)[0] == ids).all()
    with pytest.raises(ValueError):
        rans.unpack(table, block[:-4] + bytes(b ^ 255 for b in block[-4:]))
    assert rans.crc_joined(zlib.crc32(b"abc"), zlib.crc32(b"defg"), 4) == zlib.crc32(b"abcdefg")


def test_substring_dedup(docs, empty):
    seen, want = set(), {}
    for i, x in TEXTS:
        w = (x or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(a for a, g in zip(w, gone) if not g)).hexdigest())
    rows = substring_dedup.substring_dedup(docs, n_chunks=3, n_blocks=2).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_jaccard_classes(docs, empty):
    rows = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_classes(docs).collect()}
    assert rows[3] == (1, 2) and rows[2] == (1, 2) and rows[1] == (1, 2)
    assert rows[4] == (4, 0) and rows[5] == (5, 0) and rows[12][0] == rows[1][0]
    assert jaccard_join.jaccard_classes(empty).count() == 0


def test_jaccard_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "LEAF", 4)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join([*words[:k], f"odd{k}", *words[k + 1 :]])) for k in range(20)]
    got = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 19)}


def test_line_dedup(docs, empty):
    rows = {r.doc_id: r for r in line_dedup.line_dedup(docs).collect()}
    assert rows[3].n_removed == 1 and rows[1].n_removed == 0 and rows[11].removed == "1" and rows[4].n_lines == 0
    kept = {r.doc_id: r.text for r in line_dedup.without_lines(docs).collect()}
    assert 3 not in kept and kept[11] == "line one here\n\nlast" and kept[4] is None
    assert line_dedup.line_dedup(empty).count() == 0


def test_decontamination(spark, docs, empty):
    half = PASSAGE.split()
    bench = spark.createDataFrame([(1, " ".join(half[30:50] + half[5:25])), (2, None), (3, "word1 word2"), (4, "not there at all, ever again")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert rows[1]["items"] == [1, 3] and rows[1].max_coverage == 1.0 and not rows[7].contaminated and not rows[4].contaminated
    sliced = decontaminate.contamination(docs, bench, slice_bytes=1).collect()
    assert {r.doc_id: r["items"] for r in sliced} == {i: r["items"] for i, r in rows.items()}
    assert decontaminate.contamination(empty, bench).count() == 0 and decontaminate.uncontaminated(docs, bench).columns == docs.columns


def test_sentencepiece(spark, docs, empty):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    coded = piece_lattice.encode(docs, ids=True)
    for r in coded.collect():
        text = dict(TEXTS)[r.doc_id] or ""
        assert list(r.ids) == m.encode(text) and r.round_trip
    assert piece_lattice.encode(empty).count() == 0


def test_viterbi(spark):
    table = [("a", 3, -1.0), ("b", 4, -1.2), ("ab", 5, -1.5), ("abc", 6, -9.0), ("c", 7, -2.0), ("bc", 8, -1.1)]
    words = piece_lattice.spark_words(spark, ["abc", "cab", "ab", "a", "axb"])
    got = {r.word: list(r.ids) for r in piece_lattice.encoded_words(words, "", unigram=True, table=table, byte_id=100).collect()}
    assert got == {"abc": [3, 8], "cab": [7, 5], "ab": [5], "a": [3], "axb": [3, 100 + ord("x"), 4]}


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3, 7, 8)] + [(9, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert rows[4].base_failed and not rows[4].kept and rows[1].kept and rows[7].n_words == 200
    assert rows[12].n_repeat_words == 120 and rows[12].base_failed
    assert quality.statistics("a # b\na # b\n \n") == (6, 6, 2, 1, 0)
    assert quality.quality(empty, labels).count() == 0
    kept = {r.doc_id for r in quality.kept_documents(docs, labels).collect()}
    assert kept == {i for i, r in rows.items() if r.kept}


def test_repeated_words_both_ways(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (0, 3, 6, 200):
        words = [b"%d" % k for k in rng.integers(0, 3, n)]
        want = quality.repeated_words(words)
        monkeypatch.setattr(quality, "ARRAY_WORDS", 0)
        assert quality.repeated_words(words) == want
        monkeypatch.undo()


def test_secrets(spark, docs):
    key = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"
    rows = spark.createDataFrame([(1, f'the token = "{key}" here', "src"), (2, "card 4041894974608795 of", None), (3, None, "x"), (4, "pass password=b7db7aa4a5fcc78305", "src")], "doc_id long, text string, source string")
    got = {r.doc_id: r.secret for r in secrets.secret_scan(rows).collect()}
    assert got == {1: True, 2: False, 4: True}


def test_secret_forest_on_held_out_findings(spark):
    rows = secrets.labelled_findings(spark, 2000).withColumn("k", F.xxhash64("candidate") % 4)
    gather, model = secrets.fitted(rows.where("k <> 0").drop("k"))
    out = model.transform(gather.transform(secrets.featured(rows.where("k = 0").drop("k"))))
    assert out.where("prediction = label").count() >= 0.95 * out.count()


def test_licenses(spark, docs, empty):
    rows = spark.createDataFrame([(1, "released UNDER the MIT Licence"), (2, "Copyright 2020 me\nAll rights reserved.\ntext"), (3, None), (4, "nothing")], "doc_id long, text string")
    got = {r.doc_id: (r.whole_license, r.licenses) for r in license_scan.license_scan(rows).collect()}
    assert got == {1: ("MIT", "MIT"), 2: (None, "all-rights-reserved"), 3: (None, ""), 4: (None, "")}
    assert license_scan.license_scan(empty).count() == 0


def test_pieces_that_come_due_late(spark):
    """BPE where a merge makes an edge due that ranks before it: taken at once, as in merging step by step."""
    import itertools

    table = [(p, k, -float(k)) for k, p in enumerate(["abc", "ab", "bc", "cd", "da", "dab", "aa", "aaa", "a", "b", "c", "d"])]
    rank = {p: k for k, (p, _, _) in enumerate(table)}

    def plain(word):
        out = list(word)
        while True:
            due = [(rank[x + y], k) for k, (x, y) in enumerate(zip(out, out[1:], strict=False)) if x + y in rank]
            if not due:
                return [rank[x] for x in out]
            k = min(due)[1]
            out[k : k + 2] = [out[k] + out[k + 1]]

    words = ["".join(w) for n in (1, 3, 4, 5, 6) for w in itertools.product("abcd", repeat=n)]
    got = {r.word: list(r.ids) for r in piece_lattice.encoded_words(piece_lattice.spark_words(spark, words), "", table=table, byte_id=100).collect()}
    assert got == {w: plain(w) for w in words}
