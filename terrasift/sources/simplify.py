"""Per-line vertex reduction used inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd


def keep_mask(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Vertices kept by Douglas-Peucker, iteratively (no recursion limit)."""
    keep = np.zeros(len(xy), dtype=bool)
    keep[[0, -1]] = True
    todo = [(0, len(xy) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        a, b = xy[lo], xy[hi]
        d = b - a
        inner = xy[lo + 1 : hi] - a
        norm = d @ d
        t = np.clip(inner @ d / norm, 0.0, 1.0) if norm > 0 else np.zeros(len(inner))
        off = np.hypot(*(inner - t[:, None] * d).T)
        worst = int(off.argmax())
        if off[worst] > tolerance:
            mid = lo + 1 + worst
            keep[mid] = True
            todo += [(lo, mid), (mid, hi)]
    return keep


def simplify_batches(key: str, tolerance: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for vertices in pdf["vertices"]:
                xy = np.array([(v["lon"], v["lat"]) for v in vertices], dtype=float)
                kept = xy[keep_mask(xy, tolerance)] if len(xy) > 2 else xy
                out.append([{"lon": float(x), "lat": float(y)} for x, y in kept])
            yield pd.DataFrame({key: pdf[key], "vertices": out})

    return run
