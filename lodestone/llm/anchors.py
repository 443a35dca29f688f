"""Content-defined anchors: places that any two equal windows of a text share.

Every window of WINDOW bytes chooses the leftmost of its GRAM-byte strings of least hash. The choice depends on the
window's bytes alone, so equal windows choose at the same place within them, and the windows that choose one place are
consecutive. Only the chosen places travel: about 2 in (WINDOW - GRAM) of all.
"""

from __future__ import annotations

import numpy as np

WINDOW, GRAM = 200, 64
#: Base of the rolling hash (odd, so that it has an inverse) and the random value of each byte.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
VALUES = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any substring of a text, from sums over its prefixes."""

    _up = _powers(BASE, 1 << 16)
    _down = _powers(INVERSE, 1 << 16)

    def __init__(self, text: np.ndarray) -> None:
        n = len(text) + 1
        if n > len(Rolling._up):
            Rolling._up, Rolling._down = _powers(BASE, 2 * n), _powers(INVERSE, 2 * n)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(VALUES[text] * Rolling._up[: n - 1], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * Rolling._down[begin])

    def all(self, size: int) -> np.ndarray:
        """Hash of every substring of so many bytes."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * Rolling._down[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of width values, from least values of prefixes and suffixes of blocks."""
    n = len(v)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    padded[:n] = v
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(rolling: Rolling, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, hash of the gram) of every chosen place of a text."""
    size = len(rolling.sums) - 1
    if size < window:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64)
    v, width = rolling.all(gram), window - gram + 1
    low = sliding_min(v, width)
    drops = (np.flatnonzero(low[1:] < low[:-1]) + 1).tolist()
    drops.append(len(low))
    places, firsts = [], []
    p, at, k, end = 0, int(v[:width].argmin()), 0, len(low)
    while True:
        places.append(at)
        firsts.append(p)
        drop = drops[k]
        if drop <= at:
            if drop >= end:
                break
            p, at, k = drop, drop + width - 1, k + 1
        else:
            p = at + 1
            if p >= end:
                break
            if drop == p:
                k += 1
            at = p + int(v[p : p + width].argmin())
    place, first = np.array(places), np.array(firsts)
    return place, first, np.r_[first[1:] - 1, end - 1], v[place]
