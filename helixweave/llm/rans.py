"""Static range asymmetric numeral system over token ids: interleaved lanes, independent blocks.

A block holds N symbols dealt over L lanes (symbol i to lane i % L). Each lane keeps a 64-bit state in
[2^31, 2^63) and gives off 32-bit words; all lanes of a block share one word stream, which the decoder
reads in the order in which the lanes run dry. Every block starts from its own states, so any block can
be decoded alone; its states are the checkpoint, its checksum is the crc32 of its ids (little-endian,
32 bits).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"HWRA"
HEAD = struct.Struct("<4sBBHIIII")  # magic, version, scale bits, lanes, symbols, words, pieces, crc32
LOW, WORD = np.uint64(1 << 31), np.uint64(32)
MAX_LANES = 1024


def scaled(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that sum to 2^bits, at least 1 wherever the count isn't 0."""
    total, room = int(counts.sum()), 1 << bits
    freq = np.zeros(len(counts), np.int64)
    if not total:
        return freq
    some = counts > 0
    if int(some.sum()) > room:
        raise ValueError(f"{int(some.sum())} symbols don't fit in 2^{bits} slots")
    freq[some] = np.maximum(1, counts[some].astype(object) * room // total).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    left = room - int(freq.sum())
    if left > 0:
        freq[order[0]] += left
    for i in order if left < 0 else ():
        take = min(-left, int(freq[i]) - 1)
        freq[i] -= take
        left += take
        if not left:
            break
    return freq


class Table:
    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Lanes, their states, the words of a block."""
        n = len(ids)
        lanes = 1
        while lanes < MAX_LANES and n > lanes * 256:
            lanes *= 2
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        bits, top = np.uint64(self.bits), np.uint64(63 - self.bits)
        for at in range((n - 1) // lanes * lanes if n else -1, -1, -lanes):
            now = ids[at : at + lanes]
            x, f, c = state[: len(now)], self.freq[now], self.start[now]
            full = x >= (f << top)
            if full.any():
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                x = np.where(full, x >> WORD, x)
            q = x // f
            state[: len(now)] = (q << bits) + (x - q * f) + c
        return lanes, state, np.concatenate(words[::-1]) if words else np.empty(0, "<u4")

    def decode(self, n: int, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        lanes, at = len(state), 0
        out = np.empty(n, np.uint32)
        state = state.astype(np.uint64)
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        for k in range(0, n, lanes):
            x = state[: min(lanes, n - k)]
            slot = x & mask
            s = self.symbol[slot]
            out[k : k + len(x)] = s
            x = self.freq[s] * (x >> bits) + slot - self.start[s]
            dry = np.flatnonzero(x < LOW)
            if len(dry):
                x[dry] = (x[dry] << WORD) | words[at : at + len(dry)].astype(np.uint64)
                at += len(dry)
            state[: len(x)] = x
        if at != len(words) or not (state == LOW).all():
            raise ValueError("block doesn't end where it should")
        return out


def pack(table: Table, ids: np.ndarray, pieces: np.ndarray) -> bytes:
    """A block: header, the pieces of documents that it holds (6 numbers each, see token_files), states, words."""
    lanes, state, words = table.encode(ids)
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    head = HEAD.pack(MAGIC, 1, table.bits, lanes, len(ids), len(words), len(pieces), crc)
    return head + pieces.astype("<i8").tobytes() + state.astype("<u8").tobytes() + words.tobytes()


def unpack(table: Table, block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and pieces of a block; ValueError where it doesn't match its checksum."""
    magic, version, bits, lanes, n, n_words, n_pieces, crc = HEAD.unpack_from(block)
    if magic != MAGIC or version != 1 or bits != table.bits:
        raise ValueError("not a block of this format and table")
    at = HEAD.size
    pieces = np.frombuffer(block, "<i8", n_pieces * PIECE, at).reshape(-1, PIECE)
    at += n_pieces * PIECE * 8
    state = np.frombuffer(block, "<u8", lanes, at)
    words = np.frombuffer(block, "<u4", n_words, at + lanes * 8)
    ids = table.decode(n, state, words)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum doesn't match")
    return ids, pieces


#: Numbers kept of each piece.
PIECE = 6


def crc_joined(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings joined, from theirs and the second's length (zlib's method: powers of a zero-byte operator)."""

    def times(m: list[int], v: int) -> int:
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
            if not v:
                break
        return out

    def square(m: list[int]) -> list[int]:
        return [times(m, row) for row in m]

    if not length:
        return first
    op = square(square([0xEDB88320, *(1 << k for k in range(31))]))  # four zero bits
    while length:
        op = square(op)
        if length & 1:
            first = times(op, first)
        length >>= 1
    return first ^ second
