"""Content-defined sampling: every window of L bytes owns one anchor, the least k-gram in it.

Equal windows, wherever they are, own the equal k-gram at the equal place. So texts that share an L-byte
string meet at an anchor, though only about one position in (L - k) / 2 is one.
"""

from __future__ import annotations

import numpy as np

from .common import U64, mix, powers

_R = 0x9E3779B97F4A7C15
_INVERSE = pow(_R, -1, 1 << 64)
_LETTER = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
_KEPT: dict[int, np.ndarray] = {}


def inverses(n: int) -> np.ndarray:
    """Powers of the inverse of the hash base, at least n of them."""
    size = 1 << max(10, int(n).bit_length())
    if size not in _KEPT:
        out = np.full(size, U64(_INVERSE), U64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if size > 1 << 22:
            return out
        _KEPT[size] = out
    return _KEPT[size]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of letter times power before each position; n + 1 of them."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_LETTER[data] * powers(len(data) + 1)[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], the same for equal bytes anywhere."""
    return mix((prefix[end] - prefix[start]) * inverses(len(prefix))[start] + (end - start).astype(U64) * U64(_R))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, by running minima from block ends."""
    n = len(x)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(data: np.ndarray, at: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one owner: text number, first window, number of windows, owner's place in the run, owner's hash, and the prefix hashes.

    A run covers the bytes from its first window to the end of its last; it never crosses a text's end.
    """
    n, w = len(data), length - k + 1
    prefix = prefix_hash(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(U64), prefix
    grams = np.arange(n - k + 1)
    h = range_hash(prefix, grams, grams + k)
    least = sliding_min(h, w)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (h[: len(least) - 1] == least[:-1])
    ends = at[1:] - length  # the last window of each text
    inside = np.zeros(n + 1, np.int32)
    has = ends >= at[:-1]
    np.add.at(inside, at[:-1][has], 1)
    np.add.at(inside, ends[has] + 1, -1)
    inside = np.cumsum(inside[: len(least)]) > 0
    new[at[:-1][has]] = True
    stop = ends[has] + 1
    new[stop[stop < len(new)]] = True
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(least)))
    ok = inside[first]
    first, count = first[ok], count[ok]
    owner = np.empty(len(first), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, w)
    for lo in range(0, len(first), 4096):
        owner[lo : lo + 4096] = view[first[lo : lo + 4096]].argmin(1)
    return np.searchsorted(at, first, "right") - 1, first, count, owner, h[first + owner], prefix
