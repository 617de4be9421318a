"""Scores by which the best read of a duplicate set is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import RANDOM, SUM_OF_BASE_QUALITIES
from .cigar import reference_length
from .flags import QC_FAIL, UNMAPPED, has, has_mate

#: Half the range of a 16-bit score, so that a pair's sum fits; what a failed quality check costs; qualities below count nothing.
MOST, FAILED, LEAST_QUALITY = 16383, 16384, 15


def sum_of_base_qualities(qual: Column) -> Column:
    """Sum of the qualities of at least 15 in a phred+33 text, 16383 at most; an absent text (``*``) has none."""
    qualities = F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)
    total = F.aggregate(qualities, F.lit(0), lambda n, q: n + F.when(q >= LEAST_QUALITY, q).otherwise(0))
    return F.when(qual == "*", 0).otherwise(F.least(total, F.lit(MOST)))


def mapped_reference_length(cigar: Column, mate_cigar: Column | None = None) -> Column:
    """Aligned reference bases, with the mate's where its CIGAR is to count and the mate is mapped; each 16383 at most."""
    own = F.when(has(UNMAPPED), 0).otherwise(F.least(reference_length(cigar), F.lit(MOST)))
    if mate_cigar is None:
        return own
    return own + F.when(has_mate() & mate_cigar.isNotNull(), F.least(reference_length(mate_cigar), F.lit(MOST))).otherwise(0)


_32 = 0xFFFFFFFF


def times(a: Column, b: int) -> Column:
    """a * b modulo 2^32 for numbers below 2^32, in steps that fit 64 bits."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftright(a, 16)
    return (low * F.lit(b) + F.shiftleft((high * F.lit(b)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_32))


def turned(x: Column, bits: int) -> Column:
    """A rotation to the left by ``bits`` of 32."""
    return F.shiftleft(x, bits).bitwiseAND(F.lit(_32)).bitwiseOR(F.shiftright(x, 32 - bits))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def opposite(b: int) -> int:
    """The number that undoes a multiplication by ``b`` modulo 2^32."""
    return pow(b, -1, 1 << 32)


C1, C2, END1, END2 = 0xCC9E2D51, 0x1B873593, 0x85EBCA6B, 0xC2B2AE35
#: The seed that Spark's own hash() starts with.
SPARKS_SEED = 42


def number_for(seed: int) -> int:
    """The int whose Spark hash is ``seed``: every step of the hash of one int can be undone. Before other values it makes hash() begin with that seed."""
    h = seed ^ (seed >> 16)
    h = h * opposite(END2) & _32
    h ^= (h >> 13) ^ (h >> 26)
    h = h * opposite(END1) & _32
    h ^= h >> 16
    h = ((h ^ 4) - 0xE6546B64) * opposite(5) & _32  # 4 bytes were hashed
    k = (((h >> 13) | (h << 19)) & _32) ^ SPARKS_SEED
    k = k * opposite(C2) & _32
    k = ((k >> 15) | (k << 17)) * opposite(C1) & _32
    return k - (1 << 32) if k >> 31 else k


def murmur3(text: Column, seed: int = 1) -> Column:
    """MurmurHash3 (32 bits, as a long) of a text of ASCII, as names of reads are, taken as 16-bit characters, two at a time.

    Spark's hash() is the same function over whole pairs of characters. A last one that has no other is mixed in
    differently there, so of a text of odd length the pairs before it are hashed, the end of that hash is undone, and
    the last character and the end follow.
    """
    size = F.length(text)
    odd = size % 2
    pairs = F.hash(F.lit(number_for(seed)), F.encode(F.substring(text, F.lit(1), size - odd), "UTF-16LE")).cast("long").bitwiseAND(F.lit(_32))
    last = turned(times(F.ascii(F.right(text, F.lit(1))).cast("long"), C1), 15)
    h = let(pairs, lambda h: h.bitwiseXOR(F.shiftright(h, 16)))
    h = let(h, lambda h: times(h, opposite(END2)))
    h = let(h, lambda h: h.bitwiseXOR(F.shiftright(h, 13)).bitwiseXOR(F.shiftright(h, 26)))
    h = let(h, lambda h: times(h, opposite(END1)))
    h = let(h, lambda h: h.bitwiseXOR(F.shiftright(h, 16)).bitwiseXOR(2 * (size - 1).cast("long")))
    h = h.bitwiseXOR(let(last, lambda k: times(k, C2))).bitwiseXOR(2 * size.cast("long"))
    h = let(let(h, lambda h: h.bitwiseXOR(F.shiftright(h, 16))), lambda h: times(h, END1))
    h = let(let(h, lambda h: h.bitwiseXOR(F.shiftright(h, 13))), lambda h: times(h, END2))
    h = let(h, lambda h: h.bitwiseXOR(F.shiftright(h, 16)))
    return F.when(text.isNotNull(), F.when(odd == 1, h).otherwise(pairs))


def random_score(name: Column) -> Column:
    """A score by the read's name alone, from -8191 to 8192, so that mates have the same."""
    return (murmur3(F.coalesce(name, F.lit(""))).bitwiseAND(F.lit(0x3FFF)) - 8191).cast("int")


def read_score(strategy: str, mate_cigar: Column | None = None) -> Column:
    """A read's score from its columns qname, flag, cigar and qual; a failed quality check ranks it below all that passed."""
    if strategy == SUM_OF_BASE_QUALITIES:
        raw = sum_of_base_qualities(F.col("qual"))
    elif strategy == RANDOM:
        raw = random_score(F.col("qname"))
    else:
        raw = mapped_reference_length(F.col("cigar"), mate_cigar)
    return (raw - F.when(has(QC_FAIL), FAILED).otherwise(0)).cast("int")
