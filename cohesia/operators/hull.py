"""Convex hulls in the plane."""

from __future__ import annotations

import numpy as np


def hull_2d(x: np.ndarray) -> np.ndarray:
    """Places of the hull's corners, counter-clockwise; points along an edge are left out, equal points count once."""
    order = np.lexsort((x[:, 1], x[:, 0]))

    def chain(places: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in places:
            while len(out) > 1 and _turn(x[out[-2]], x[out[-1]], x[i]) <= 0:
                out.pop()
            if not out or (x[out[-1]] != x[i]).any():
                out.append(int(i))
        return out

    low, high = chain(order), chain(order[::-1])
    return np.array(low[:-1] + high[:-1] if len(low) > 1 else low)


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
