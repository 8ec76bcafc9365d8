"""Byte-pair merges of many words at once: in each round every word makes the one merge that is due in it."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np

#: Rank of a pair that doesn't merge. Words of more symbols than LONG are merged one by one, so rounds stay few.
NONE, LONG = np.int64(1 << 60), 64


def folded(sym: np.ndarray, word: np.ndarray, pair: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of words (numbers in ascending order) after all merges; pair(left, right): ranks and merged symbols. The lowest rank goes first, then the leftmost."""
    if not len(sym):
        return sym, word
    sym, out = sym.copy(), []
    rank, new = np.full(len(sym), NONE), np.zeros_like(sym)
    rank[:-1], new[:-1] = pair(sym[:-1], sym[1:])
    rank[:-1][word[1:] != word[:-1]] = NONE
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(word)))
        best = np.minimum.reduceat(rank, first)
        best_here = np.repeat(best, size)
        ready = best_here == NONE
        if ready.any():
            out.append((sym[ready], word[ready]))
            sym, word, rank, new, best_here = (x[~ready] for x in (sym, word, rank, new, best_here))
            if not len(sym):
                break
        hit = np.flatnonzero(rank == best_here)
        hit = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])]
        sym[hit] = new[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        sym, word, rank, new = (x[keep] for x in (sym, word, rank, new))
        at = hit - np.arange(len(hit))
        beside = np.zeros(len(sym), bool)
        beside[at] = True
        beside[at[at > 0] - 1] = True
        left = np.flatnonzero(beside)
        rank[left] = NONE
        left = left[left + 1 < len(sym)]
        left = left[word[left] == word[left + 1]]
        rank[left], new[left] = pair(sym[left], sym[left + 1])
    sym, word = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(word, kind="stable")
    return sym[order], word[order]


def folded_alone(n: int, rank_of: Callable[[int, int], int | None]) -> list[tuple[int, int]]:
    """(start, end) of each symbol of one word of n symbols after all merges; rank_of(start, end) of a merged symbol or None. n log n merges."""
    end, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, k, k + 1, k + 2) for k in range(n - 1) if (r := rank_of(k, k + 2)) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, b, e = heapq.heappop(heap)
        if not alive[a] or end[a] != b or b >= n or not alive[b] or end[b] != e:
            continue
        alive[b], end[a] = False, e
        if e < n:
            back[e] = a
            if (r := rank_of(a, end[e])) is not None:
                heapq.heappush(heap, (r, a, e, end[e]))
        p = back[a]
        if p >= 0 and (r := rank_of(p, e)) is not None:
            heapq.heappush(heap, (r, p, a, e))
    return [(k, end[k]) for k in range(n) if alive[k]]
