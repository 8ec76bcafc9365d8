"""Merges and lattices of words of any length against the libraries and merging step by step."""

import random

import pytest

from helixweave.llm import piece_lattice, wordbpe
from helixweave.llm.shared import tokenizer_path

sentencepiece = pytest.importorskip("sentencepiece")


def words(rng):
    letters = "abcdefghijklmnopqrstuvwxyzéßΣ漢字  .-'’0123456789"
    yield from ("", "a", " ", "\n", "a\n\nb ", "  two  marks ", "▁ mark", "ab" * 20_000, "é漢" * 3000)
    for _ in range(400):
        yield "".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 5, 8, 13, 63, 64, 65, 66, 200))))


def test_pieces_of_texts(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    table, first, raw = piece_lattice.pieces(path)
    texts = list(words(random.Random(3)))
    got = [x.tolist() for x in piece_lattice.Lattice(table, first).encode(texts)]
    assert got == [m.encode(t) for t in texts]
    assert all(piece_lattice.decoded(i, raw).decode() == t.replace("▁", " ") for i, t in zip(got, texts, strict=True))


def test_texts_come_back(spark):
    docs = spark.createDataFrame([(1, "A text, é漢 \x01."), (2, None), (3, ""), (3, "other"), (None, "x")], "doc_id long, text string")
    coded = piece_lattice.encode(docs, ids=True)
    assert sorted((r.doc_id or 0, r.text) for r in piece_lattice.decode(coded).collect()) == sorted((i or 0, t or "") for i, t in [tuple(r) for r in docs.collect()])
    assert all(r.round_trip for r in coded.collect())


def test_long_words_in_seconds(spark):
    import time

    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghij") for _ in range(100_000))
    table, first, _ = piece_lattice.pieces(tokenizer_path("piece_bpe_32k.model"))
    lattice = piece_lattice.Lattice(table, first)
    began = time.time()
    next(lattice.encode([word]))
    assert time.time() - began < 30


def test_lattice_within_tasks_and_as_a_plan(spark):
    table = [("a", 3, -1.0), ("b", 4, -1.2), ("ab", 5, -1.5), ("abc", 6, -9.0), ("c", 7, -2.0), ("bc", 8, -1.1)]
    said = ["abc", "cab", "ab", "a", "axb", "abcabc", "ccba"]
    for unigram in (True, False):
        plan = piece_lattice.encoded_words(piece_lattice.spark_words(spark, said), "", unigram=unigram, table=table, byte_id=100)
        own = piece_lattice.Lattice(table, 100, unigram).fold(said)
        assert {r.word: list(r.ids) for r in plan.collect()} == {w: x.tolist() for w, x in zip(said, own, strict=True)}


def test_word_bpe_of_words(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path("word_bpe_49k.json")
    library, bpe = tokenizers.Tokenizer.from_file(path), wordbpe.WordBpe(path)
    texts = [*words(random.Random(5)), "It's <|endoftext|> here", "<|endoftext|>", "x² Σ ΑΣ ﬁ"]
    ids, n = bpe.encode_many(texts, bpe.proven_whole())
    at = 0
    for t, k in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + k].tolist() == library.encode(t, add_special_tokens=False).ids
        at += k
