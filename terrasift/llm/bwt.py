"""Repeated windows of a text block by interval expansion on its Burrows-Wheeler transform."""

from __future__ import annotations

import numpy as np

END, BREAK, FIRST = 1, 2, 3  # symbols: 0 pads, then the block's end, the break after each string, the bytes
WIDTH = 7  # symbols of nine bits in the first sort key


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by at least their first ``depth`` symbols, and each suffix's place."""
    n = len(symbols)
    key = np.zeros(n, np.int64)
    for k in range(WIDTH):
        key <<= 9
        key[: max(0, n - k)] |= symbols[k:]
    span = WIDTH
    while True:
        order = np.argsort(key)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
        if span > depth or int(rank[order[-1]]) == n:
            break
        key = rank * (n + 1)
        key[: max(0, n - span)] += rank[span:]
        span *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def short_prefixes(symbols: np.ndarray, order: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """For every border between neighbours in suffix order: is their common prefix under ``least``?

    Intervals of the transform are extended backwards, breadth first: those of length k give
    the common prefixes of value k. An extension goes on only if it sets the border after it,
    so every border is set once, in order of value, and the search ends at ``least``.
    """
    n = len(order)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    before = order - 1
    has = before >= 0
    letter = np.where(has, symbols[before], 0)
    moved = np.where(has, place[before], -1)  # place of the suffix that is one symbol longer
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(least):
        width = high - low + 1
        rows = np.repeat(low - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
        parent = np.repeat(np.arange(len(low)), width)
        use = has[rows]
        rows, parent = rows[use], parent[use]
        # the suffixes of one extension lie side by side: sorted by place, they part where the string changes
        key = np.sort(moved[rows] << 32 | parent << 9 | letter[rows])
        at, name = key >> 32, key & 0xFFFFFFFF
        last = np.ones(len(at), bool)
        last[:-1] = (name[1:] != name[:-1]) | (at[1:] != at[:-1] + 1)
        ends = np.flatnonzero(last)
        starts = np.concatenate([[0], ends[:-1] + 1])
        new = ~known[at[ends] + 1]
        low, high = at[starts[new]], at[ends[new]]
        known[high + 1] = True
        if not len(low):
            break
    return known[1:n]


def repeated_windows(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For every string the flags of its windows that begin at another place of the block, too."""
    if sum(map(len, strings)) + len(strings) >= 1 << 22:
        raise ValueError("a block holds less than 4 MB")  # interval numbers have 22 bits
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    symbols = np.empty(int(sizes.sum()) + len(strings) + 1, np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    flat = np.frombuffer(b"\0".join(strings), np.uint8)
    symbols[: len(flat)] = flat.astype(np.int64) + FIRST
    symbols[starts + sizes] = BREAK
    symbols[-1] = END
    order, place = suffix_order(symbols, window)
    alike = ~short_prefixes(symbols, order, place, window)
    again = np.zeros(len(symbols), bool)
    again[order[:-1][alike]] = True
    again[order[1:][alike]] = True
    return [again[a : a + max(0, n - window + 1)] for a, n in zip(starts.tolist(), sizes.tolist())]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of every run of true flags."""
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return [(int(a), int(b) - 1) for a, b in edge.reshape(-1, 2)]
