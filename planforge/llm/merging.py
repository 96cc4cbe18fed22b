"""Merging sorted runs of strings with loser trees that carry common-prefix lengths.

Strings are rows of big-endian 8-byte digits.  A sorted run knows of each row
how many bytes it shares with the row before (its LCP), which is also what
front coding keeps.  A loser tree over the runs stores at each node the loser
and its LCP with the winner that beat it; a new candidate comes with its LCP
with the last winner.  Of two rows the one that shares more with the last winner
is smaller, and only rows that share equally much are compared, from the first
digit that is not known to be equal.

One tree step in Python for each row would be slow, so the key range is cut by
sampled splitters into many ranges, each with a tree of its own, and all trees
step together in numpy.
"""

from __future__ import annotations

import numpy as np

STREAMS = 64  # runs that a tree merges; more are merged in several passes
BYTES = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)
PER_TREE = 48  # rows of a tree, about


def leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    """Of each non-zero 64-bit number."""
    return 7 - np.searchsorted(BYTES, x, side="right")


def compare(flat: np.ndarray, digits: int, a: np.ndarray, b: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common bytes, whether row a is smaller) of row pairs that share ``known`` bytes."""
    lcp, less = np.full(len(a), 8 * digits), np.zeros(len(a), dtype=bool)
    todo, d = np.arange(len(a)), known >> 3
    i, j = a * digits, b * digits
    while len(todo):
        ok = d < digits
        if not ok.all():
            todo, d = todo[ok], d[ok]
            continue
        x, y = flat[i[todo] + d], flat[j[todo] + d]
        same = x == y
        done = todo[~same]
        if len(done):
            p, q = x[~same], y[~same]
            lcp[done] = d[~same] * 8 + leading_zero_bytes(p ^ q)
            less[done] = p < q
        todo, d = todo[same], d[same] + 1
    return lcp, less


def run_lcp(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row of a sorted matrix of digits shares with the row before."""
    n, digits = rows.shape
    out = np.zeros(n, np.int64)
    if n > 1:
        out[1:], _ = compare(np.ascontiguousarray(rows).ravel(), digits, np.arange(1, n), np.arange(n - 1), np.zeros(n - 1, np.int64))
    return out


def merge(rows: np.ndarray, lcp: np.ndarray, sizes: list[int], *, per_tree: int = PER_TREE, streams: int = STREAMS) -> tuple[np.ndarray, np.ndarray]:
    """Merges sorted runs laid end to end: (order of the rows, LCP of each with the one before in the order)."""
    runs = [(np.arange(e - n, e), lcp[e - n : e]) for n, e in zip(sizes, np.cumsum(sizes), strict=True) if n]
    while len(runs) > 1:
        runs = [_merge_some(rows, runs[i : i + streams], per_tree) for i in range(0, len(runs), streams)]
    return runs[0] if runs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _merge_some(rows: np.ndarray, runs: list[tuple[np.ndarray, np.ndarray]], per_tree: int) -> tuple[np.ndarray, np.ndarray]:
    if len(runs) == 1:
        return runs[0]
    digits = rows.shape[1]
    item, lcp = np.concatenate([r for r, _ in runs]), np.concatenate([x for _, x in runs])
    own = rows[item]
    flat, n = own.ravel(), len(item)
    keys = np.ascontiguousarray(own.astype(">u8")).view(f"S{8 * digits}").ravel()
    offset = np.concatenate([[0], np.cumsum([len(r) for r, _ in runs])])
    splitters = np.unique(keys[np.arange(per_tree // 2, n, per_tree)])
    depth = (len(runs) - 1).bit_length()
    width, trees = 1 << depth, len(splitters) + 1
    at, end = np.zeros((trees, width), np.int64), np.zeros((trees, width), np.int64)
    for s, (i, j) in enumerate(zip(offset[:-1], offset[1:], strict=True)):
        cut = np.concatenate([[0], np.searchsorted(keys[i:j], splitters, side="left"), [j - i]]) + i
        at[:, s], end[:, s] = cut[:-1], cut[1:]
    total = (end - at).sum(axis=1)
    base = np.cumsum(total) - total
    # first tournament: every pair of a level at once, nothing known yet
    loser, shared = np.zeros((trees, width), np.int64), np.zeros((trees, width), np.int64)
    level, nodes = np.tile(np.arange(width), (trees, 1)), width
    tree = np.arange(trees)[:, None]
    while nodes > 1:
        nodes //= 2
        a, b = level[:, 0::2], level[:, 1::2]
        ia, ib = at[tree, a], at[tree, b]
        ea, eb = ia >= end[tree, a], ib >= end[tree, b]
        second, common = ea & ~eb, np.zeros(a.shape, np.int64)
        both = ~ea & ~eb
        common[both], less = compare(flat, digits, ia[both], ib[both], np.zeros(int(both.sum()), np.int64))
        second[both] = ~less & (common[both] < 8 * digits)
        loser[:, nodes : 2 * nodes], shared[:, nodes : 2 * nodes] = np.where(second, a, b), common
        level = np.where(second, b, a)
    order, out = np.empty(n, np.int64), np.zeros(n, np.int64)
    t = np.flatnonzero(total)
    stream, known, to = level[t, 0], np.zeros(len(t), np.int64), base[t]
    left = total[t]
    at, end, loser, shared = at.ravel(), end.ravel(), loser.ravel(), shared.ravel()
    while len(t):
        place = t * width + stream
        head = at[place]
        order[to], out[to] = head, known
        to, left = to + 1, left - 1
        at[place] = head + 1
        going = left > 0
        if not going.all():
            t, stream, to, left, place, head = t[going], stream[going], to[going], left[going], place[going], head[going]
            if not len(t):
                break
        mine, root = head + 1, t * width
        empty = mine >= end[place]
        known = lcp[np.minimum(mine, n - 1)]
        node = (stream + width) >> 1
        for _ in range(depth):
            spot = root + node
            rival, theirs = loser[spot], shared[spot]
            rival_at = root + rival
            other = at[rival_at]
            gone = other >= end[rival_at]
            swap = ~gone & (empty | (known < theirs))
            tie = np.flatnonzero(~gone & ~empty & (known == theirs))
            lost = np.where(swap, known, theirs)
            if len(tie):
                common, less = compare(flat, digits, mine[tie], other[tie], known[tie])
                swap[tie] = ~less & (common < 8 * digits)
                lost[tie] = common
            loser[spot], shared[spot] = np.where(swap, stream, rival), lost
            stream, mine, known, empty = np.where(swap, rival, stream), np.where(swap, other, mine), np.where(swap, theirs, known), np.where(swap, gone, empty)
            node >>= 1
    border = base[total > 0][1:]  # first rows of trees have nothing before them in their tree
    if len(border):
        out[border], _ = compare(flat, digits, order[border], order[border - 1], np.zeros(len(border), np.int64))
    return item[order], out
