"""Suffix sorting by hashes: prefix polynomial hashes, binary search and a mergesort.

Rows of a matrix of bytes are contexts, each valid in a range of columns. Prefix hashes make
the hash of any part of a row one subtraction and one product, a binary search over lengths
finds the common extension of two suffixes in a few steps, and the mergesort compares
suffixes by it. Equal hashes are confirmed by the bytes themselves.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1


class Hashed:
    """Prefix hashes of each row of ``cells`` (bytes), modulo 2**64."""

    def __init__(self, cells: np.ndarray):
        width = cells.shape[1]
        power = np.cumprod(np.full(width, BASE, np.uint64))
        self.cells = cells
        self.prefix = np.zeros((len(cells), width + 1), np.uint64)
        np.cumsum((cells.astype(np.uint64) + np.uint64(1)) * power, axis=1, out=self.prefix[:, 1:])
        self.back = np.cumprod(np.full(width + 1, pow(BASE, -1, 1 << 64), np.uint64))

    def part(self, row: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.prefix[row, at + length] - self.prefix[row, at]) * self.back[at]

    def common(self, x: np.ndarray, y: np.ndarray, at: int, most: np.ndarray) -> np.ndarray:
        """How many bytes the suffixes of rows x and y from column ``at`` share, ``most`` at most."""
        low, high = np.zeros(len(x), np.int64), most.astype(np.int64)
        column = np.full(len(x), at)
        for _ in range(int(most.max(initial=0)).bit_length() + 1):
            if not (low < high).any():
                break
            mid = (low + high + 1) >> 1
            same = self.part(x, column, mid) == self.part(y, column, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def sort_suffixes(h: Hashed, group: np.ndarray, at: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of (group, suffix from column ``at`` of ``size`` bytes), and each one's longest common extension with another row of its group.

    Rows must come by group. Runs double; a row finds its place in the other run by binary
    search among the rows of its own group there.
    """
    n = len(group)
    order = np.arange(n)
    starts = np.searchsorted(group, group, "left")
    ends = np.searchsorted(group, group, "right")
    run = 1
    biggest = int((ends - starts).max(initial=1))

    def before(x: np.ndarray, y: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix y sorts ahead of suffix x (or equals it, where ``ties``)."""
        most = np.minimum(size[x], size[y])
        c = h.common(x, y, at, most)
        inside = c < most
        k = at + np.minimum(c, np.maximum(most - 1, 0))
        byte_x, byte_y = h.cells[x, k].astype(int), h.cells[y, k].astype(int)
        longer = size[x] - size[y]
        return np.where(inside, byte_y < byte_x, (longer > 0) | ((longer == 0) & ties))

    while run < n:
        place = np.arange(n)
        block = place // run
        other = block ^ 1
        mine_first = (block & 1) == 0
        # Rows of the own group in the other run; group bounds are places, as the order keeps groups together.
        low = np.maximum(other * run, starts)
        high = np.minimum(np.minimum((other + 1) * run, n), ends)
        high = np.maximum(high, low)
        lo, hi = low.copy(), high.copy()
        while (active := np.flatnonzero(lo < hi)).size:
            mid = (lo[active] + hi[active]) >> 1
            smaller = before(order[active], order[mid], ~mine_first[active])
            lo[active] = np.where(smaller, mid + 1, lo[active])
            hi[active] = np.where(smaller, hi[active], mid)
        # New place: own place, shifted by how many of the other run's rows change sides.
        passed = lo - low
        new = np.where(mine_first, place + passed, place - ((high - low) - passed))
        merged = np.empty(n, np.int64)
        merged[new] = order
        order = merged
        run *= 2
        if run >= 2 * biggest and not _straddles(starts, ends, run):
            break
    longest = np.zeros(n, np.int64)
    if n > 1:
        x, y = order[:-1], order[1:]
        beside = group[x] == group[y]
        c = np.where(beside, h.common(x, y, at, np.minimum(size[x], size[y])), 0)
        np.maximum.at(longest, x, c)
        np.maximum.at(longest, y, c)
    return order, longest


def _straddles(starts: np.ndarray, ends: np.ndarray, run: int) -> bool:
    """Whether a group lies on both sides of an edge between runs."""
    return bool((starts // run != (ends - 1) // run).any())


def repeated(h: Hashed, group: np.ndarray, rows: np.ndarray, at: int, length: int) -> np.ndarray:
    """Of ``rows``, which have the same ``length`` bytes from column ``at`` as another of them in their group, confirmed by the bytes."""
    value = h.part(rows, np.full(len(rows), at), np.full(len(rows), length))
    order = np.lexsort((value, group[rows]))
    r = rows[order]
    same = np.zeros(len(r), bool)
    if len(r) > 1:
        next_ = (value[order][1:] == value[order][:-1]) & (group[r[1:]] == group[r[:-1]])
        k = np.flatnonzero(next_)
        for i in range(0, len(k), 20_000):
            part = k[i : i + 20_000]
            next_[part] = (h.cells[r[part], at : at + length] == h.cells[r[part + 1], at : at + length]).all(1)
        same[1:] |= next_
        same[:-1] |= next_
    out = np.zeros(len(r), bool)
    out[order] = same
    return out


def repeated_span(cells: np.ndarray, group: np.ndarray, first: np.ndarray, last: np.ndarray, anchor: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the least and greatest offset o, such that the ``length`` bytes from column anchor - o also stand there in another context of its group; (1, 0) if none.

    Rows come by group and are valid from column ``first`` to ``last`` (exclusive). The
    longest extensions to the right and, in mirrored rows, to the left bound the offsets;
    the outermost ones are then tested, mostly with success at once.
    """
    n = len(group)
    h = Hashed(cells)
    _, right = sort_suffixes(h, group, anchor, last - anchor)
    mirror = Hashed(np.ascontiguousarray(cells[:, ::-1]))
    _, left = sort_suffixes(mirror, group, cells.shape[1] - anchor, anchor - first)
    del mirror
    low = np.maximum(0, length - right)
    high = np.minimum(left, anchor)
    open_low, open_high = low <= high, low <= high
    out_low, out_high = np.ones(n, np.int64), np.zeros(n, np.int64)

    def test(o: int, wanted: np.ndarray) -> np.ndarray:
        groups = np.unique(group[wanted])
        k = np.searchsorted(groups, group)
        rows = np.flatnonzero((groups[np.minimum(k, len(groups) - 1)] == group) & (first <= anchor - o) & (last >= anchor - o + length))
        hit = np.zeros(n, bool)
        hit[rows] = repeated(h, group, rows, anchor - o, length)
        return hit & wanted

    for o in range(anchor, -1, -1):
        wanted = open_high & (high >= o) & (low <= o)
        if wanted.any():
            hit = test(o, wanted)
            out_high[hit] = o
            open_high &= ~hit
    open_low &= ~open_high  # no window at all
    for o in range(anchor + 1):
        wanted = open_low & (low <= o)
        if wanted.any():
            hit = test(o, wanted)
            out_low[hit] = o
            open_low &= ~hit
    return out_low, out_high
