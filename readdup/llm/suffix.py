"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

The scans that induce the order go through the array in chunks: a chunk of entries is final as soon as none of the
entries it induces falls into the chunk itself, so it is handled at once, and cut where one does. That keeps the linear
number of placements with a number of steps far below it for any alphabet.
"""

from __future__ import annotations

import numpy as np


def _sorted(c: np.ndarray, size: int) -> np.ndarray:
    """Stable order of values below ``size``, by 16-bit digits, which numpy sorts by counting."""
    if len(c) < 1 << 12 and size > 1 << 16:
        return c.argsort(kind="stable")
    order = c.astype(np.uint16).argsort(kind="stable")
    if size > 1 << 16:
        order = order[(c[order] >> 16).astype(np.uint16).argsort(kind="stable")]
    return order


def _rank(c: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place how many equal values stand before it; the distinct values and their counts. Values are below ``size``."""
    n = len(c)
    order = _sorted(c, size)
    s = c[order]
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(s[1:], s[:-1], out=fresh[1:])
    first = fresh.nonzero()[0]
    counts = np.empty_like(first)
    np.subtract(first[1:], first[:-1], out=counts[:-1])
    counts[-1] = n - first[-1]
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n) - first.repeat(counts)
    return rank, s[first], counts


def _induce(t: np.ndarray, small: np.ndarray, starts: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The order of all suffixes, given the LMS suffixes ``lms`` in an order that is right within each first symbol."""
    n = len(t)
    sa = np.full(n, -1, np.int32)
    rank, symbols, counts = _rank(t[lms], len(starts))
    held = np.zeros(len(starts), np.int64)
    held[symbols] = counts
    sa[ends[t[lms]] - held[t[lms]] + rank] = lms
    # larger suffixes, left to right, from the heads of the buckets
    head, i, width = starts.copy(), 0, 256
    while i < n:
        j = min(n, i + width)
        source = (sa[i:j] > 0).nonzero()[0]
        before = sa[i + source] - 1
        larger = ~small[before]
        source, before = source[larger], before[larger]
        if len(before):
            c = t[before]
            rank, symbols, counts = _rank(c, len(starts))
            slot = head[c] + rank
            low = int(slot.min())
            if low < j:
                j, keep = low, source < low - i
                before, c, slot = before[keep], c[keep], slot[keep]
                _, symbols, counts = _rank(c, len(starts))
                width = max(32, 2 * (j - i))
            else:
                width = min(2 * width, 1 << 20)
            sa[slot] = before
            head[symbols] += counts
        else:
            width = min(2 * width, 1 << 20)
        i = j
    # smaller suffixes, right to left, from the tails; the LMS ones are placed anew
    sa[1:][small[sa[1:]] & (sa[1:] >= 0)] = -1
    tail, j, width = ends.copy(), n, 256
    while j > 0:
        i = max(0, j - width)
        source = (sa[i:j][::-1] > 0).nonzero()[0]
        before = sa[j - 1 - source] - 1
        smaller = small[before]
        source, before = source[smaller], before[smaller]
        if len(before):
            c = t[before]
            rank, symbols, counts = _rank(c, len(starts))
            slot = tail[c] - 1 - rank
            high = int(slot.max())
            if high >= i:
                i, keep = high + 1, source < j - high - 1
                before, c, slot = before[keep], c[keep], slot[keep]
                _, symbols, counts = _rank(c, len(starts))
                width = max(32, 2 * (j - i))
            else:
                width = min(2 * width, 1 << 20)
            sa[slot] = before
            tail[symbols] -= counts
        else:
            width = min(2 * width, 1 << 20)
        j = i
    return sa


def _suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Of symbols below ``size`` that end in the only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32)
    # smaller (S) or larger (L) than the next suffix; equal symbols are as the next one is
    change = np.append(np.flatnonzero(t[1:] != t[:-1]), n - 1)
    rises = np.append(t[change[:-1]] < t[change[:-1] + 1], True)
    small = np.repeat(rises, np.diff(np.append(-1, change)))
    small[n - 1] = True
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts).astype(np.int32)
    starts = (ends - counts).astype(np.int32)
    order = _induce(t, small, starts, ends, lms)
    by_substring = order[is_lms[order]]
    # names: equal LMS substrings (up to the next LMS place, included) share one
    following = np.append(lms[1:], np.int32(n - 1))
    length = np.zeros(n, np.int32)
    length[lms] = following - lms + 1
    a, b = by_substring[:-1], by_substring[1:]
    alike = np.flatnonzero(length[a] == length[b])
    differs = np.ones(len(b), bool)
    if len(alike):
        each = length[a[alike]]
        at = np.cumsum(each) - each
        inner = np.arange(int(each.sum())) - np.repeat(at, each)
        differs[alike] = ~np.logical_and.reduceat(t[np.repeat(a[alike], each) + inner] == t[np.repeat(b[alike], each) + inner], at)
    name = np.zeros(n, np.int32)
    name[by_substring] = np.append(0, np.cumsum(differs))
    distinct = int(name[by_substring[-1]]) + 1
    if distinct < len(lms):
        by_substring = lms[_suffix_array(name[lms], distinct)]
    return _induce(t, small, starts, ends, by_substring)


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The places of all suffixes of a byte array (of up to 2^31 bytes) in ascending order; a suffix that is another's beginning comes first."""
    return _suffix_array(np.append(data.astype(np.int32) + 1, 0).astype(np.int32), 257)[1:] if len(data) else np.empty(0, np.int32)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place how many bytes its suffix shares with the suffix before it in the order, ``most`` at most."""
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    padded = np.concatenate([data, np.zeros(most + 16, np.uint8)])
    words = np.zeros(n + most + 8, np.uint64)  # eight bytes from each place on, the first one lowest
    for k in range(8):
        words |= padded[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    here, there = order[1:], order[:-1]
    room = np.minimum(n - np.maximum(here, there), most)
    for step in range(0, most, 8):
        x = words[here + step] ^ words[there + step]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8)
        out[here] = np.minimum(step + same, room)
        go = (x == 0) & (room > step + 8)
        here, there, room = here[go], there[go], room[go]
        if not len(here):
            break
    return out
