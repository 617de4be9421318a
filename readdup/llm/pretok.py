"""Vectorised splitting of texts into the units that public BPE vocabularies merge within.

Two rules, each as the pattern of its vocabulary states it: ``spaced`` (a unit carries one space before it; white
space is kept) and ``bare`` (white space is dropped, digits stand alone). Both know the contractions 's 't 're 've
'm 'll 'd where a unit starts with an apostrophe.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np

from .words import mix, run_hashes

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points of Unicode's White_Space property.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    found = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    found[WHITE] = SPACE
    return found


def split(texts: list[str], bare: bool) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined text; start and end of each unit in it; how many units lie before each text, total last; a hash of each unit."""
    text = "".join(texts)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    if not n:
        none = np.empty(0, np.int64)
        return text, none, none, np.zeros(len(texts) + 1, np.int64), np.empty(0, np.uint64)
    kind = classes()[code]
    edge = np.zeros(n + 1, bool)  # where a text starts or all end
    edge[at] = True
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start |= edge
    runs = np.flatnonzero(start)
    kinds = kind[runs[:-1]]
    quotes = runs[:-1][(code[runs[:-1]] == 39) & (np.diff(runs) == 1)]
    if bare:
        start[:n] |= kind == NUMBER
    else:
        follows = runs[1:-1][(kinds[:-1] == SPACE) & ~edge[runs[1:-1]]]  # runs that white space stands before
        start[follows - 1] = True
        start[follows[code[follows - 1] == 32]] = False
    quotes = quotes[start[quotes] & ~edge[quotes + 1]]
    quotes = quotes[kind[quotes + 1] == LETTER]
    if len(quotes):
        one = code[quotes + 1]
        after = np.minimum(quotes + 2, n - 1)
        two = np.where(edge[quotes + 2] | (quotes + 2 >= n), 0, code[after])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for which, more in ((short, 2), (long, 3)):
            q = quotes[which]
            start[q + 1] = False
            start[q + more] = True
    starts = np.flatnonzero(start[:n])
    hashes = run_hashes(mix(code.astype(np.uint64) + np.uint64(1)), starts)
    ends = np.append(starts[1:], n)
    if bare:
        keep = kind[starts] != SPACE
        starts, ends, hashes = starts[keep], ends[keep], hashes[keep]
    return text, starts, ends, np.searchsorted(starts, at), hashes


class Units:
    """What is known of each unit, found by its 64-bit hash; new units are made in batches. Starts anew beyond ``most``."""

    def __init__(self, make: Callable[[list[str]], None], clear: Callable[[], None], most: int):
        self.make, self.clear, self.most = make, clear, most
        self.forget()

    def forget(self) -> None:
        self.keys, self.places = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.clear()

    def find(self, text: str, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The place of each unit among those made so far."""
        if len(self.keys) > self.most:
            self.forget()
        fresh, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, fresh)
        known = np.zeros(len(fresh), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == fresh[inside]
        if not known.all():
            lacking = first[~known]
            self.make([text[a:b] for a, b in zip(starts[lacking].tolist(), ends[lacking].tolist(), strict=True)])
            n = len(self.keys)
            self.places = np.insert(self.places, at[~known], np.arange(n, n + len(lacking)))
            self.keys = np.insert(self.keys, at[~known], fresh[~known])
            at = np.searchsorted(self.keys, fresh)
        return self.places[at][back]


class Ragged:
    """Rows of numbers of any length, appended in batches."""

    def __init__(self, dtype: type):
        self.flat, self.at, self.used, self.n = np.empty(1 << 16, dtype), np.zeros(1 << 12, np.int64), 0, 0

    def append(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(lengths) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.empty_like(self.at)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.at[self.n + 1 : self.n + 1 + len(lengths)] = self.used + np.cumsum(lengths)
        self.used, self.n = self.used + len(flat), self.n + len(lengths)

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of these rows one after another, and how many come before each, with the total last."""
        begin, ends = self.at[which], np.zeros(len(which) + 1, np.int64)
        lengths = self.at[which + 1] - begin
        np.cumsum(lengths, out=ends[1:])
        return self.flat[np.repeat(begin - ends[:-1], lengths) + np.arange(ends[-1])], ends
