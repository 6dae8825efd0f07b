"""Suffix arrays by induced sorting, in whole-array steps.

Suffixes are classified as smaller (S) or larger (L) than their successor; leftmost S suffixes (LMS) are sorted by their
substrings up to the next one, by induction; equal substrings get equal names, and the string of names, half as
long at most, is sorted in the same way, recursively; its order induces that of all suffixes. Over the bytes, inductions take each bucket as arrays: one step
per bucket and per repeat of its own character. Names are an alphabet nearly as wide as their string, whose buckets hold a
few suffixes each, so there inductions go suffix by suffix; both take time in proportion to the string.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes. The end of the string counts as smaller than everything."""
    n = len(t)
    s = np.zeros(n, bool)
    if n < 2:
        return s
    differs = np.flatnonzero(t[:-1] != t[1:])
    smaller = t[differs] < t[differs + 1]
    # each suffix takes the type of the next place where the character changes
    at = np.searchsorted(differs, np.arange(n))
    inside = at < len(differs)
    s[inside] = smaller[at[inside]]
    return s


def dealt(lists: list[list[np.ndarray]], t: np.ndarray, p: np.ndarray) -> None:
    """Appends suffixes, in their order, to the lists of their first characters."""
    c = t[p]
    order = np.argsort(c, kind="stable")
    p, c = p[order], c[order]
    cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
    for part in np.split(p, cuts) if len(cuts) else [p]:
        lists[t[part[0]]].append(part)


def induce(t: np.ndarray, s: np.ndarray, lms: np.ndarray, width: int) -> np.ndarray:
    """The suffix array that the given order of the LMS suffixes induces."""
    n = len(t)
    larger: list[list[np.ndarray]] = [[] for _ in range(width)]
    seeds: list[list[np.ndarray]] = [[] for _ in range(width)]
    if len(lms):
        dealt(seeds, t, lms)
    larger[t[n - 1]].append(np.array([n - 1]))  # the end of the string, the least of all, induces the last suffix
    done: list[np.ndarray] = [np.zeros(0, np.int64)] * width
    for c in range(width):
        parts = []
        now = np.concatenate(larger[c]) if larger[c] else None
        while now is not None and len(now):
            parts.append(now)
            p = now[now > 0] - 1
            p = p[~s[p]]
            same = t[p] == c
            if len(p):
                other = p[~same]
                if len(other):
                    dealt(larger, t, other)
            now = p[same]
        if parts:
            done[c] = np.concatenate(parts)
        if seeds[c]:
            p = np.concatenate(seeds[c])
            p = p[p > 0] - 1
            if len(p):
                dealt(larger, t, p)
    smaller: list[list[np.ndarray]] = [[] for _ in range(width)]
    out: list[np.ndarray] = []
    for c in range(width - 1, -1, -1):
        parts = []
        now = np.concatenate(smaller[c]) if smaller[c] else None
        while now is not None and len(now):
            parts.append(now)
            p = now[now > 0] - 1
            p = p[s[p]]
            same = t[p] == c
            other = p[~same]
            if len(other):
                dealt(smaller, t, other)
            now = p[same]
        down = done[c][::-1]
        p = down[down > 0] - 1
        p = p[s[p]]
        if len(p):
            dealt(smaller, t, p)
        out += [*parts, down]
    return np.concatenate(out)[::-1]


def names_of(t: np.ndarray, s: np.ndarray, by: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """A name for each LMS substring, ordered as they are; by: LMS suffixes in order of their substrings, lms: in text order."""
    n = len(t)
    u = t.astype(np.int64) * 2 + s
    size = np.append(np.diff(lms) + 1, n - lms[-1] + 1)  # up to and with the next LMS; the last one has the end
    length = np.zeros(n + 1, np.int64)
    length[lms] = size
    a, b = by[:-1], by[1:]
    same = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
    pairs = np.flatnonzero(same)
    sizes = length[a[pairs]]
    step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    equal = u[np.repeat(a[pairs], sizes) + step] == u[np.repeat(b[pairs], sizes) + step]
    if len(pairs):
        same[pairs] = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
    name = np.zeros(n, np.int64)
    name[by] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def induce_wide(t: np.ndarray, s: np.ndarray, lms: np.ndarray, width: int) -> np.ndarray:
    """What induce() does, for a wide alphabet: each suffix is put at its bucket's next free place."""
    n = len(t)
    ends = np.cumsum(np.bincount(t, minlength=width))
    text, smaller, order = t.tolist(), s.tolist(), [-1] * n
    tail = ends.tolist()
    for p in lms[::-1].tolist():
        c = text[p]
        tail[c] -= 1
        order[tail[c]] = p
    head = [0, *ends[:-1].tolist()]
    c = text[n - 1]  # the end of the string, the least of all, induces the last suffix
    order[head[c]] = n - 1
    head[c] += 1
    for i in range(n):
        p = order[i] - 1
        if p >= 0 and not smaller[p]:
            c = text[p]
            order[head[c]] = p
            head[c] += 1
    order = [p if p >= 0 and not smaller[p] else -1 for p in order]
    tail = ends.tolist()
    for i in range(n - 1, -1, -1):
        p = order[i] - 1
        if p >= 0 and smaller[p]:
            c = text[p]
            tail[c] -= 1
            order[tail[c]] = p
    return np.array(order, np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffix array of a string of small integers."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    s = classify(t)
    width = int(t.max()) + 1
    by_bucket = induce if width <= 512 else induce_wide
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    if len(lms) > 1:
        by = by_bucket(t, s, lms, width)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        names = names_of(t, s, by[is_lms[by]], lms)
        different = int(names.max()) + 1 == len(names)
        lms = lms[np.argsort(names) if different else suffix_array(names)]
    return by_bucket(t, s, lms, width)


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, most: int, valid: np.ndarray) -> np.ndarray:
    """For each place in the text, the common prefix with the suffix before it in the array, up to `most`; 0 where either of
    the two has fewer than `most` bytes before its end."""
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    wide = np.zeros(n + most + 8, np.uint8)
    wide[:n] = data
    blocks = np.lib.stride_tricks.as_strided(wide, (n + most, 8), (1, 1))
    out = np.zeros(n, np.int64)
    left = np.flatnonzero(valid & (before >= 0))
    left = left[valid[before[left]]]
    for k in range(0, most, 8):
        a = np.ascontiguousarray(blocks[left + k]).view(np.uint64)[:, 0]
        b = np.ascontiguousarray(blocks[before[left] + k]).view(np.uint64)[:, 0]
        x = a ^ b
        equal = x == 0
        low = x[~equal]
        low = low & (~low + np.uint64(1))
        out[left[~equal]] = np.minimum(k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3), most)
        left = left[equal]
    out[left] = most
    return out
