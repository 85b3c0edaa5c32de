"""Threshold-bounded interval expansion on a Burrows-Wheeler transform (one block, in memory).

`equal_prefix_groups` takes strings and finds which of their suffixes share a prefix of `least` bytes:

1. suffixes are sorted by prefix doubling (each string ends in a sentinel of its own, lower than any byte),
2. from the transform (the byte before each suffix) a stable sort gives the steps of backward extension,
3. breadth-first over interval boundaries: two neighbours in suffix order that differ first at depth d are a boundary
   of value d; extending the interval right of a boundary of value d backward by a byte c gives the boundary between the
   last c-suffix before it and the first one in it, of value d + 1 unless it has a smaller one.  So common-prefix
   lengths come by increasing value; each is set once, and the expansion stops at `least`: what has no value by then shares `least`
   bytes or more.
"""

from __future__ import annotations

import numpy as np


def suffix_order(sym: np.ndarray, end: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Order of all suffixes. sym: byte + 1, or 0 at the end of each string; end: where the string of a position ends."""
    n = len(sym)
    key, step = np.zeros(n, np.uint64), 7
    at = np.arange(n)
    for k in range(step):
        p = at + k
        v = np.where(p < end, sym[np.minimum(p, n - 1)], 0).astype(np.uint64)
        key = (key << np.uint64(9)) | v
    sa = np.argsort(key, kind="stable")
    s = key[sa]
    fresh = np.concatenate(([True], s[1:] != s[:-1]))
    head = np.maximum.accumulate(np.where(fresh, at, 0))
    rank = np.empty(n, np.int64)
    rank[sa] = head
    tied = ~(fresh & np.append(fresh[1:], True))
    pos = np.flatnonzero(tied)
    while len(pos):
        sub = sa[pos]
        p = sub + step
        second = np.where(p < end[sub], rank[np.minimum(p, n - 1)], owner[sub])  # equal up to the end: by string
        key = (rank[sub].astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64)
        o = np.argsort(key, kind="stable")
        sub, key = sub[o], key[o]
        sa[pos] = sub
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        rank[sub] = np.maximum.accumulate(np.where(fresh, pos, 0))
        pos = pos[~(fresh & np.append(fresh[1:], True))]
        step *= 2
    return sa


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.concatenate(([0], np.cumsum(size)[:-1]))
    return np.arange(total) + np.repeat(start - shift, size)


def equal_prefix_groups(buf: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions (string, offset in it) of suffixes that share `least` bytes with another, and the number of their group."""
    m, sizes = len(off) - 1, np.diff(off)
    n = int(off[-1]) + m
    begin = off[:-1] + np.arange(m)
    sym, owner = np.zeros(n, np.uint16), np.repeat(np.arange(m), sizes + 1)
    stop = np.repeat(begin + sizes, sizes + 1)
    body = np.ones(n, bool)
    body[begin + sizes] = False
    sym[body] = buf.astype(np.uint16) + 1
    sa = suffix_order(sym, stop, owner)
    before = np.where(sa > 0, sym[sa - 1], 0)  # the transform; 0 is a sentinel, which nothing is extended by
    first = np.argsort(before, kind="stable")  # row in sorted order -> the row it extends
    step = np.empty(n, np.int64)
    step[first] = np.arange(n)
    last = np.where(step > 0, first[step - 1], -1)  # the row before with the same byte
    last[(last >= 0) & (before[last] != before)] = -1
    known = np.zeros(n + 1, bool)
    known[n] = True  # beyond the last row
    f = sym[sa]
    new = np.flatnonzero(np.concatenate(([True], f[1:] != f[:-1])) | (f == 0))
    known[new] = True
    for _ in range(least - 1):
        if not len(new):
            break
        bounds = np.flatnonzero(known)
        size = bounds[np.searchsorted(bounds, new) + 1] - new
        y = ranges(new, size)
        left = np.repeat(new, size)
        y = y[(before[y] > 0) & (last[y] < left)]
        x = step[y]
        new = np.unique(x[~known[x]])
        known[new] = True
    group = np.cumsum(known[:n]) - 1
    same = np.bincount(group)[group] > 1
    at = sa[same]
    return owner[at], at - begin[owner[at]], group[same]
