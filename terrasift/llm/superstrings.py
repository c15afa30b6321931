"""Superstrings: runs of neighbouring windows that share their smallest gram.

Every window of ``WINDOW`` bytes is named by the smallest hash among its grams. Equal windows
have equal names, and neighbouring windows mostly share theirs, so a text falls into a few
overlapping stretches, each with one name. Repeated windows can only lie in stretches of the
same name.
"""

from __future__ import annotations

import numpy as np

GRAM = 64
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from every position of a uint8 array."""
    word = data.astype(np.uint64)
    for k in (1, 2, 4):
        word = word[:-k] | word[k:] << np.uint64(8 * k)
    h = _mixed(word * ODD)
    for k in (8, 16, 32):
        h = _mixed(h[:-k] * ODD + h[k:])
    return h


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Smallest or largest of every ``width`` neighbouring values."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def superstrings(data: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, start, length, name, twice) of all stretches of the texts that lie one after another.

    ``bounds`` holds the texts' ends after a leading zero. ``start`` counts from the array's
    begin. ``twice`` tells that the naming gram occurs again in the stretch, as it does
    wherever a window repeats inside it.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < window:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(bool)
    hashes = gram_hashes(data)
    width = window - GRAM + 1
    names = sliding(hashes, width, np.minimum)
    sizes = np.diff(bounds)
    # windows inside one text
    inside = np.zeros(len(data) + 1, np.int32)
    long = np.flatnonzero(sizes >= window)
    np.add.at(inside, bounds[long], 1)
    np.add.at(inside, bounds[long] + sizes[long] - window + 1, -1)
    ok = np.cumsum(inside[: len(names)]) > 0
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | ~ok[:-1]
    new[bounds[:-1][bounds[:-1] < len(names)]] = True
    first = np.flatnonzero(new & ok)
    # a run ends before the next start or where windows stop fitting
    stop = np.ones(len(names), bool)
    stop[:-1] = new[1:] | ~ok[1:]
    last = np.flatnonzero(stop & ok)
    text = np.searchsorted(bounds, first, side="right") - 1
    # positions whose gram names some window, sorted by (hash, position)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), names, np.zeros(width - 1, np.uint64)])
    naming = np.flatnonzero(sliding(padded, width, np.maximum)[: len(hashes)] == hashes)
    order = np.lexsort((naming, hashes[naming]))
    values, places = hashes[naming][order], naming[order]
    lo = np.searchsorted(values, names[first], side="left")
    # the naming grams of a run lie in [first, last + width); count them among the equal hashes
    group = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]]))
    rank = group * (len(data) + 1) + places
    base = group[np.minimum(lo, len(group) - 1)] * (len(data) + 1)
    n = np.searchsorted(rank, base + last + width, side="left") - np.searchsorted(rank, base + first, side="left")
    return text, first, last - first + window, names[first], n > 1
