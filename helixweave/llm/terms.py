"""Words as ops 5 and 9 compare them: lower case, split at white space and punctuation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_SPACED = bytes(b if chr(b).isalnum() or b >= 0x80 or b == 0x5F else 0x20 for b in range(256))
_WIDE = re.compile("[\u0080-©«-±´¶-¸»¿×÷ -⁯　-〿！-／]")
MEMO = 400_000


class Hashes(dict):
    """A word's 64-bit hash, remembered up to MEMO words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def terms(text: str | None) -> list[bytes]:
    if not text:
        return []
    low = text.lower()
    if not low.isascii() and _WIDE.search(low):
        low = _WIDE.sub(" ", low)
    return low.encode().translate(_SPACED).split()


def hashed(words: list[bytes], memo: Hashes) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, span: int) -> np.ndarray:
    """A hash of every run of span words."""
    total = np.zeros(max(0, len(h) - span + 1), np.uint64)
    for j in range(span):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(total)]
    total ^= total >> np.uint64(31)
    total *= np.uint64(0xFF51AFD7ED558CCD)
    return total ^ (total >> np.uint64(33))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of rows with equal keys, from batches that are sorted by them; a group may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        cols = [t[k].to_numpy() for k in keys]
        new = np.zeros(len(t), bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), len(t)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)
