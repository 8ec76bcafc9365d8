"""Byte-level BPE with word ends: what op 1 and op 7 share.

``WordBpe`` gives the same ids as the tokenizers library for a file whose normalizer is NFC, white
space, lower case and whose pre-tokens are contractions, letter runs, single digits and runs of other
symbols. ``proven_whole`` finds offline which vocabulary strings encode alone as one token; a text's
pre-tokens among them are looked up, and only the rest are merged (and remembered).
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections import Counter

import numpy as np
import regex

from . import folding

#: The pre-token pattern of the file's format.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same with letters first, as no other alternative begins with one.
WIDE = regex.compile(r"[\p{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[\p{N}]|[^\s\p{L}\p{N}]+")
NAMED = regex.compile(r"[\p{L}\p{N}]")
#: The same over lower-case Latin-1 texts, where the standard library is faster.
LATIN = re.compile(
    r"[a-zªµºß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9²³¹¼-¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼-¾]+"
)
#: Merged pre-tokens remembered by a worker before it starts over.
MEMO = 400_000
#: Characters of texts that are split before their pre-tokens are looked up.
PART = 1 << 20


@functools.cache
def byte_letters() -> list[str]:
    """The printable letter of each byte in byte-level vocabularies: visible Latin-1 stays, others follow from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = itertools.count(256)
    return [chr(b) if b in visible else chr(next(rest)) for b in range(256)]


@functools.cache
def newer() -> re.Pattern:
    """Characters that one of the Unicode tables at hand calls letters or numbers and another doesn't know."""
    odd = [c for c in map(chr, range(0x80, 0x110000)) if (unicodedata.category(c)[0] in "LN") != bool(NAMED.match(c))]
    spans: list[list[int]] = []
    for c in map(ord, odd):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans) + "]") if spans else re.compile(r"(?!)")


def lowered(text: str) -> str:
    """NFC, then lower case letter by letter (no final sigma)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def pretokens(text: str) -> list[str]:
    low = lowered(text)
    return (LATIN if latin(low) else WIDE).findall(low)


class Numbers(dict):
    """A number for each pre-token (str) or special id (int); those that come up for the first time are noted as fresh."""

    def __init__(self, known=()):
        super().__init__(known)
        self.fresh: list[str | int] = []

    def __missing__(self, t: str | int) -> int:
        self.fresh.append(t)
        n = self[t] = len(self)
        return n


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.size = self.library.get_vocab_size()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.hint = min((s[:2] for s in self.special), default="")
        self.letters = byte_letters()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.memo: dict[str, tuple[int, ...]] = {}
        self.forget()
        self.read_merges()

    def read_merges(self) -> None:
        """Merges as sorted keys (left id * size + right id), ranks and results; ids of each byte within a pre-token and at its end."""
        import json

        vocab = self.library.get_vocab(with_added_tokens=False)
        merges = [m if isinstance(m, list) else m.split(" ") for m in json.loads(self.library.to_str())["model"]["merges"]]
        table = np.array([(vocab[a] * self.size + vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(merges)], np.int64).reshape(-1, 3)
        self.merge_keys, self.merge_ranks, self.merge_ids = table[np.argsort(table[:, 0])].T.copy()
        self.byte_ids, self.last_ids = (np.array([vocab[c + end] for c in self.letters], np.int64) for end in ("", "</w>"))

    def merge(self, pretoken: str) -> tuple[int, ...]:
        """Ids of one pre-token, by merging."""
        letters = self.letters
        return tuple(t.id for t in self.model.tokenize("".join(letters[b] for b in pretoken.encode())))

    def proven_whole(self) -> dict[str, int]:
        """Every vocabulary string that is a pre-token and encodes alone as one token, with its id."""
        back = {c: b for b, c in enumerate(self.letters)}
        found = {}
        for piece, i in self.library.get_vocab(with_added_tokens=False).items():
            if not piece.endswith("</w>"):
                continue
            try:
                text = bytes(back[c] for c in piece[:-4]).decode()
            except (KeyError, UnicodeDecodeError):
                continue
            if PRETOKEN.fullmatch(text) and PRETOKEN.match(text).end() == len(text) and self.merge(text) == (i,):
                found[text] = i
        return found

    @staticmethod
    def unknown(text: str) -> bool:
        """Whether a text has characters whose class depends on the Unicode version; the library itself takes these."""
        return not text.isascii() and not latin(text) and newer().search(text) is not None

    def parts(self, text: str):
        """(special id, None) or (None, pre-tokens) of a text, in order."""
        if self.split is None or self.hint not in text:
            yield None, pretokens(text)
            return
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                yield self.special[part], None
            elif part:
                yield None, pretokens(part)

    def count(self, text: str, whole: dict[str, int]) -> int:
        """Tokens of a text: pre-tokens among the proven count one each, the rest are merged."""
        n = 0
        if self.unknown(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        for special, found in self.parts(text):
            if found is None:
                n += 1
                continue
            n += len(found)
            rest = Counter(t for t in found if t not in whole)
            for t, k in rest.items():
                ids = self.memo.get(t)
                if ids is None:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    ids = self.memo[t] = self.merge(t)
                n += k * (len(ids) - 1)
        return n

    def forget(self, whole: dict[str, int] | None = None) -> None:
        """Start over with only the proven pre-tokens and special ids numbered; ids of number n: flat[start[n] : start[n] + size_of[n]]."""
        known = {**(whole or {}), **{i: i for i in self.special.values()}}
        self.numbers = Numbers(zip(known, range(len(known)), strict=True))
        self.flat = np.fromiter(known.values(), self.dtype, len(known))
        self.start, self.size_of = np.arange(len(known)), np.ones(len(known), np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each merge."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_ranks[at], folding.NONE), self.merge_ids[at]

    def learn(self) -> None:
        """Ids of the fresh pre-tokens, merged: those of few bytes all at once."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        raw = [t.encode() if type(t) is str else b"" for t in fresh]
        plain = [k for k, b in enumerate(raw) if 0 < len(b) <= folding.LONG]
        size = np.fromiter((len(raw[k]) for k in plain), np.int64, len(plain))
        byte = np.frombuffer(b"".join([raw[k] for k in plain]), np.uint8)
        sym = self.byte_ids[byte]
        ends = np.cumsum(size) - 1
        sym[ends] = self.last_ids[byte[ends]]
        ids, word = folding.folded(sym, np.repeat(np.arange(len(plain)), size), self.pair)
        ends = np.cumsum(np.bincount(word, minlength=len(plain)))
        size = np.zeros(len(fresh), np.int64)
        size[plain] = np.diff(ends, prepend=0)
        rest = np.setdiff1d(np.arange(len(fresh)), plain)
        own = [(t,) if type(t) is int else self.merge(t) for t in (fresh[k] for k in rest)]
        size[rest] = [len(x) for x in own]
        order = np.concatenate([plain, rest]).astype(np.int64)  # as the ids of the fresh ones are put down
        start = np.empty(len(fresh), np.int64)
        start[order] = len(self.flat) + np.cumsum(size[order]) - size[order]
        self.start, self.size_of = np.concatenate([self.start, start]), np.concatenate([self.size_of, size])
        self.flat = np.concatenate([self.flat, ids.astype(self.dtype), np.array([i for x in own for i in x], self.dtype)])

    def encode_many(self, texts: list[str | None], whole: dict[str, int], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by end, and how many each has."""
        out, counts = [np.empty(0, self.dtype)], []
        if len(self.numbers) < len(whole):
            self.forget(whole)
        k = 0
        while k < len(texts):
            part: list[list[str | int]] = []
            size = 0
            while k < len(texts) and size < PART:
                t, said = texts[k], []
                if t and self.unknown(t):
                    said = self.library.encode(t, add_special_tokens=False).ids
                elif t:
                    for special, found in self.parts(t):
                        said = found if found is not None and not said else [*said, *(found if found is not None else [special])]
                part.append(said)
                if end is not None:
                    part.append([end])
                size += len(t or "")
                k += 1
            lengths = np.fromiter(map(len, part), np.int64, len(part))
            at = np.fromiter(map(self.numbers.__getitem__, itertools.chain.from_iterable(part)), np.int64, lengths.sum())
            self.learn()
            n = self.size_of[at]
            total = np.concatenate([[0], np.cumsum(n)])
            out.append(self.flat[np.repeat(self.start[at] - total[:-1], n) + np.arange(total[-1])])
            cuts = total[np.concatenate([[0], np.cumsum(lengths)])]
            counts.append(np.diff(cuts) if end is None else np.diff(cuts[::2]))
            if len(self.numbers) > MEMO:
                self.forget(whole)
        return np.concatenate(out), np.concatenate(counts) if counts else np.empty(0, np.int64)


@functools.lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One per worker process and file."""
    return WordBpe(path)
