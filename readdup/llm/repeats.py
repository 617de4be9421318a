"""Removal of repeated byte strings across documents by suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id. Plan:

1. equal texts are one class; of the rest only its first document is searched;
2. every window of LENGTH bytes has a minimiser, the first of least hash among its strings of GRAM bytes, and a key:
   the minimiser with half of the window's other bytes, before it if the window has so many there, else behind it.
   Equal windows have equal keys. Tasks pack their documents' keys into a few blobs by hash; those in two classes or more
   are frequent. One that a task itself sees in two classes is settled there and sent on once, so no key sends more than
   one entry a task;
3. runs of windows with one frequent key are strings of their own. Each distinct one of a task goes once to the shard of
   its key, so that all equal windows meet in a shard, however far apart their documents are;
4. a shard's strings are sorted by induced sorting into a suffix array, and permuted common prefixes of LENGTH or more
   group equal windows, each group with its least doc_id. Strings that are alone with their key, or with the bytes on
   either side of it, share no window with any other and need no sorting;
5. the strings of a crowded key (a common line with other neighbours in each document) are dealt out as single windows
   instead, which are strings of one window under a key of all their bytes: equal ones meet in an aggregation;
6. what a string's windows have as least doc_id is joined back to where the string occurs: windows with a smaller one
   than their own document's are cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import documents, flat, remove, shared_dir, slices, stored, table, tidy, tidy_group
from .suffix import common_prefixes, suffix_array
from .words import mix

LENGTH, GRAM = 50, 8
#: Text bytes that are searched for keys at a time; that a task packs into one set of blobs; for which there is one bucket; string bytes of a shard.
SCAN_BYTES, PACK_BYTES, BUCKET_BYTES, SHARD_BYTES = 256 << 10, 32 << 20, 32 << 20, 4 << 20
#: Strings of one key, each counted once a task, beyond which they are dealt out as single windows.
CROWDED = 4096
#: Stands for a null doc_id, which counts as larger than every other.
LAST = np.iinfo(np.int64).max
SETTLED = 0xFFFF
_rng = np.random.Generator(np.random.PCG64(20240207))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
#: Powers of an odd base and of its inverse modulo 2^64, for hashes of runs of bytes.
_BASE = 0xD1342543DE82EF95
_powers = np.multiply.accumulate(np.full(1 << 12, _BASE, np.uint64))
_inverses = np.multiply.accumulate(np.full(1 << 12, pow(_BASE, -1, 1 << 64), np.uint64))


def gram_hashes(raw: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place on, by doubling."""
    power, whole, done = _BYTE[raw], None, 0
    length, factor = 1, _FACTOR
    while True:
        if k & length:
            if whole is None:
                whole = power
            else:
                n = len(raw) - done - length + 1
                whole = whole[:n] * np.uint64(factor) + power[done : done + n]
            done += length
        if 2 * length > k:
            return mix(whole)
        n = len(power) - length
        power = power[:n] * np.uint64(factor) + power[length:]
        length, factor = 2 * length, factor * factor % (1 << 64)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers."""
    two = raw[:-1] | (raw[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2] | (two[2:].astype(np.uint32) << np.uint32(16))
    return four[:-4] | (four[4:].astype(np.uint64) << np.uint64(32))


def hashes_at(raw: np.ndarray, words: np.ndarray | None, place: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each of the places on; ``words`` are the eights() of ``raw``."""
    if k < 8 or words is None:
        return gram_hashes(raw, k)[place]
    h = np.full(len(place), k, np.uint64)
    for step in (*range(0, k - 8, 8), k - 8):
        h = mix((h + np.uint64(_FACTOR)) ^ words[place + step])
    return h


def shape(length: int) -> tuple[int, int]:
    """Bytes of a minimiser, and how many more on one side of it make a key."""
    gram = min(GRAM, length)
    return gram, (length - gram) // 2


def key_runs(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one key: (first window, end, hash of the key, row, where the key stands behind the first window).

    Windows do not cross rows. The last is -1 where a run has its key in several places, as in strings that repeat themselves.
    """
    none = np.empty(0, np.int64)
    gram, side = shape(length)
    n, span = len(raw) - length + 1, length - gram + 1
    rows = np.flatnonzero(np.diff(at) >= length)
    if not len(rows):
        return none, none, np.empty(0, np.uint64), none, none
    words = eights(raw) if gram == 8 else None
    # the hash of each gram above its place, so that the least is the first of least hash
    mixed = gram_hashes(raw, gram) if words is None else (words ^ (words >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    least, reach = (mixed & _HIGH) | np.arange(len(mixed), dtype=np.uint64), 1
    while 2 * reach <= span:
        least = np.minimum(least[: len(least) - reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    place = (least & _LOW).astype(np.int64)
    place -= side * (place - np.arange(n) >= side)
    first, stop = at[rows], at[rows + 1] - length + 1
    step = np.zeros(n + 1, np.int8)
    step[first] += 1
    np.subtract.at(step, stop, 1)
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    fresh = np.empty(n, bool)
    fresh[0] = True
    np.not_equal(place[1:], place[:-1], out=fresh[1:])
    fresh[first] = True
    begin = np.flatnonzero(inside & fresh)
    value = hashes_at(raw, words, place[begin], gram + side)
    row = rows[np.searchsorted(first, begin, side="right") - 1]
    apart = np.append(True, (value[1:] != value[:-1]) | (row[1:] != row[:-1]))
    several = np.append(apart[1:], True) < apart  # the next run joins this one
    begin, value, row, several = begin[apart], value[apart], row[apart], several[apart]
    end = np.minimum(np.append(begin[1:], len(raw)), at[row + 1] - length + 1)
    return begin, end, value, row, np.where(several, -1, place[begin] - begin)


def run_ids(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, from one running sum."""
    global _powers, _inverses
    while len(_powers) < len(raw):
        _powers, _inverses = (np.concatenate([x, x * x[-1]]) for x in (_powers, _inverses))
    sums = np.append(np.uint64(0), np.cumsum(_BYTE[raw] * _powers[: len(raw)]))
    return mix(mix((sums[stop] - sums[start]) * _inverses[start]) + (stop - start).astype(np.uint64))


def frequent(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """(key, hot): for each class (key, text) its windows' keys, as upper bits of their hashes, that are in two classes or more.

    Keys are dealt to 2^bits buckets by their first bits; of the next ones a bucket sees 32, or as many as 48 leave.
    """
    schema = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("hashes", "classes", "table", "done", "done_keys"))])
    bucket_of, rest, cut = np.uint64(48 - bits), np.uint64(0xFFFFFFFF), np.uint64(max(0, 16 - bits))

    def pack(values: list[np.ndarray], rows: list[np.ndarray], keys: list[np.ndarray]) -> pa.RecordBatch:
        names, local = np.unique(np.concatenate(keys), return_inverse=True)
        both = np.sort((np.concatenate(values) & np.uint64(0xFFFFFFFFFFFF0000)) | local[np.concatenate(rows)].astype(np.uint64))
        both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
        value, owner = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64)
        lead = np.append(True, value[1:] != value[:-1])[: len(value)]
        group = np.flatnonzero(lead)
        several = np.repeat(np.diff(np.append(group, len(value))) > 1, np.diff(np.append(group, len(value))))
        edges = np.append(np.searchsorted(value, np.arange(1 << bits, dtype=np.uint64) << bucket_of), len(value)) if bits < 12 else np.append(np.flatnonzero(np.append(True, (value[1:] >> bucket_of) != (value[:-1] >> bucket_of))[: len(value)]), len(value))
        short = ((value >> cut) & rest).astype("<u4")
        out: dict[str, list] = {c: [] for c in schema.names}
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if a == b:
                continue
            sent, done = lead[a:b], several[a:b]
            met, of = np.unique(owner[a:b][sent], return_inverse=True)
            for c, x in zip(schema.names, (int(value[a] >> bucket_of), short[a:b][sent].tobytes(), np.where(done[sent], SETTLED, of).astype("<u2").tobytes(), names[met].astype("<i8").tobytes(), short[a:b][done].tobytes(), names[owner[a:b][done]].astype("<i8").tobytes()), strict=True):
                out[c].append(x)
        return table(schema, **out)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, rows, keys, size, n = [], [], [], 0, 0
        for batch in batches:
            for part in slices(batch, most=SCAN_BYTES):
                if values and (n + part.num_rows >= SETTLED or size >= PACK_BYTES):
                    yield pack(values, rows, keys)
                    values, rows, keys, size, n = [], [], [], 0, 0
                raw, at = flat(part.column(1))
                _, _, value, row, _ = key_runs(raw, at, length)
                values.append(value)
                rows.append(row + n)
                keys.append(np.asarray(part.column(0)))
                size, n = size + len(raw), n + part.num_rows
        if values:
            yield pack(values, rows, keys)

    def meet(group: pa.Table) -> pa.Table:
        hashes, keys, settled, out_h, out_k = [], [], [], [], []
        for h, c, t, d, dk in zip(*(group.column(x).to_pylist() for x in schema.names[1:]), strict=True):
            place, names = np.frombuffer(c, "<u2").astype(np.int64), np.append(np.frombuffer(t, "<i8"), 0)
            hashes.append(np.frombuffer(h, "<u4"))
            keys.append(names[np.minimum(place, len(names) - 1)])
            settled.append(place == SETTLED)
            out_h.append(np.frombuffer(d, "<u4"))
            out_k.append(np.frombuffer(dk, "<i8"))
        both = np.sort((np.concatenate(hashes).astype(np.uint64) << np.uint64(32)) | np.arange(sum(map(len, hashes)), dtype=np.uint64))
        value, order = both >> np.uint64(32), (both & _LOW).astype(np.int64)
        key, known = np.concatenate(keys)[order], np.concatenate(settled)[order]
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        spread = (np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first)) | np.logical_or.reduceat(known, first)
        hot = np.repeat(spread, np.diff(np.append(first, len(value)))) & ~known
        key, value = np.concatenate([key[hot], *out_k]), np.concatenate([value[hot].astype(np.uint32), *out_h])
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order].astype(np.int64) | (group.column("bucket")[0].as_py() << (48 - bits - int(cut)))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), pa.array(value))
        return pa.table({"key": pa.array(key[first]), "h": lists})

    sent = docs.select("key", "text").mapInArrow(tidy(send), "bucket int, hashes binary, classes binary, table binary, done binary, done_keys binary")
    return sent.groupBy("bucket").applyInArrow(tidy_group(meet), "key long, h array<long>").groupBy("key").agg(F.flatten(F.collect_list("h")).alias("hot"))


_PIECES = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("s", pa.binary()), ("off", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("key", pa.int64()), ("doc", pa.int64()), ("start", pa.int32())])


def pieces(texts: DataFrame, length: int, bits: int) -> DataFrame:
    """Strings of windows with one frequent key, from (key, doc, text, hot).

    Two kinds of rows: a task's distinct strings (h, id, s, off: where the key stands, low, high: the doc_ids it is in),
    and where each occurs (h, id, key, doc, start).
    """
    cut = np.uint64(16 + max(0, 16 - bits))

    def first_of(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order by string, where each string starts in it, and the first of each."""
        order = np.lexsort((ids, h))
        x, y = h[order], ids[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(x)])
        return order, first, order[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, ids, off, low, high = (np.concatenate([x[i] for x in held]) for i in (0, 1, 3, 4, 5))
            strings = [s for x in held for s in x[2]]
            order, first, lead = first_of(h, ids)
            n = len(lead)
            out = table(_PIECES, h=h[lead], id=ids[lead], s=[strings[i] for i in lead.tolist()], off=off[lead], low=np.minimum.reduceat(low[order], first), high=np.maximum.reduceat(high[order], first), key=pa.nulls(n, pa.int64()), doc=pa.nulls(n, pa.int64()), start=pa.nulls(n, pa.int32()))
            held.clear()
            return out

        for batch in batches:
            for part in slices(batch, most=SCAN_BYTES):
                raw, at = flat(part.column(2))
                begin, end, value, row, off = key_runs(raw, at, length)
                lists = part.column(3)
                of = np.repeat(np.arange(len(lists), dtype=np.uint64), np.asarray(pa.compute.list_value_length(lists)))
                hot = np.sort((of << np.uint64(48)) | np.asarray(lists.flatten()).astype(np.uint64))
                asked = (row.astype(np.uint64) << np.uint64(48)) | (value >> cut)
                found = hot[np.minimum(np.searchsorted(hot, asked), max(0, len(hot) - 1))] == asked if len(hot) else np.zeros(len(asked), bool)
                if not found.any():
                    continue
                begin, end, row, off = begin[found], end[found] + length - 1, row[found], off[found]
                h, ids, owner = (value[found] >> cut).astype(np.int64), run_ids(raw, begin, end).view(np.int64), np.asarray(part.column(1))[row]
                order, first, lead = first_of(h, ids)
                whole = raw.tobytes()
                strings = [whole[a:b] for a, b in zip(begin[lead].tolist(), end[lead].tolist(), strict=True)]
                held.append((h[lead], ids[lead], strings, off[lead], np.minimum.reduceat(owner[order], first), np.maximum.reduceat(owner[order], first)))
                size += int((end[lead] - begin[lead]).sum())
                none, n = pa.nulls(len(h), pa.int64()), len(h)
                yield table(_PIECES, h=h, id=ids, s=pa.nulls(n, pa.binary()), off=pa.nulls(n, pa.int32()), low=none, high=none, key=np.asarray(part.column(0))[row], doc=owner, start=begin - at[row])
                if size > PACK_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return texts.select("key", "doc", "text", "hot").mapInArrow(tidy(run), "h long, id long, s binary, off int, low long, high long, key long, doc long, start int")


def least_owners(strings: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each window of each string the least owner of a string that holds the same ``length`` bytes."""
    span = length - shape(length)[0] + 1
    whole = {i: first_windows(s, length) for i, s in enumerate(strings) if len(s) - length + 1 > 2 * span}
    if whole:  # sort what is new of strings that repeat themselves
        parts = [(i, a, b) for i, s in enumerate(strings) for a, b in (whole[i][0] if i in whole else [(0, len(s) - length + 1)])]
        found = _least_owners([strings[i][a : b + length - 1] for i, a, b in parts], owners[[i for i, _, _ in parts]], length)
        out = [np.empty(len(s) - length + 1, np.int64) for s in strings]
        for (i, a, b), x in zip(parts, found, strict=True):
            out[i][a:b] = x
        for i, (_, first) in whole.items():
            out[i] = out[i][first]
        return out
    return _least_owners(strings, owners, length)


def _least_owners(strings: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    parted = b"\xff".join(strings)
    data = np.frombuffer(parted, np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    own = np.full(len(data), LAST)
    windows = sizes - length + 1
    inner = np.repeat(starts, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    own[inner] = np.repeat(owners, windows)
    order = suffix_array(data)
    shared = common_prefixes(data, order, length)[order] >= length
    group = np.flatnonzero(~shared)
    own[order] = np.repeat(np.minimum.reduceat(own[order], group), np.diff(np.append(group, len(order))))
    return [own[a : a + w] for a, w in zip(starts.tolist(), windows.tolist(), strict=True)]


def first_windows(s: bytes, length: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Ranges of the windows of a string that did not occur in it before, and for each window the first equal one.

    A string of many windows with one minimiser repeats itself, so few of its windows are new.
    """
    h = gram_hashes(np.frombuffer(s, np.uint8), length)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    new = np.zeros(len(h) + 2, np.int8)
    new[first + 1] = 1
    edges = np.flatnonzero(np.diff(new))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)), first[back]


def may_share(strings: list[bytes], h: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """Which strings may hold a window of another one with the same key ``h``, which stands at ``off``.

    A shared window has bytes around the key, half of them before it or half of them behind it. Strings that share
    neither half with another have no such window. Where a string has its key several times, all strings of that key are
    kept.
    """
    gram, side = shape(length)
    key, half = gram + side, (length - gram - side + 1) // 2
    raw, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings], np.int64)
    at = np.cumsum(sizes) - sizes
    if half == 0 or len(raw) < 8:
        return np.ones(len(strings), bool)
    keep = np.isin(h, h[off < 0])
    words = eights(raw)
    for place, fits in ((at + off - half, off >= half), (at + off + key, (off >= 0) & (off + key + half <= sizes))):
        who = np.flatnonzero(fits)
        _, back, counts = np.unique(mix(h[who].view(np.uint64)) ^ hashes_at(raw, words, place[who], half), return_inverse=True, return_counts=True)
        keep[who[counts[back] > 1]] = True
    return keep


def shard_owners(strings: DataFrame, length: int, shards: int) -> DataFrame:
    """(h, id, runs): for each string with a window of a smaller owner than one of its documents, its runs of windows with one least owner."""
    kind = "h long, id long, runs array<struct<off: int, n: int, owner: long>>"

    def run(group: pa.Table) -> pa.Table:
        known: dict[tuple[int, int], list] = {}
        for h, i, s, low, high, off in zip(*(group.column(c).to_pylist() for c in ("h", "id", "s", "low", "high", "off")), strict=True):
            entry = known.get((h, i))
            if entry is None:
                known[h, i] = [s, low, high, off]
            else:
                entry[1], entry[2] = min(entry[1], low), max(entry[2], high)
        together: dict[int, int] = {}
        for h, _ in known:
            together[h] = together.get(h, 0) + 1
        sorted_keys = [k for k in known if together[k[0]] > 1]
        if sorted_keys:
            keep = may_share([known[k][0] for k in sorted_keys], np.array([k[0] for k in sorted_keys], np.int64), np.array([known[k][3] for k in sorted_keys], np.int64), length)
            sorted_keys = [k for k, may in zip(sorted_keys, keep.tolist(), strict=True) if may]
        found = dict(zip(sorted_keys, least_owners([known[k][0] for k in sorted_keys], np.array([known[k][1] for k in sorted_keys], np.int64), length), strict=True)) if sorted_keys else {}
        # runs of windows with one least owner: of sorted strings by change, of the others the whole string
        keys = list(known)
        at = {k: i for i, k in enumerate(keys)}
        windows = np.array([len(x[0]) - length + 1 for x in known.values()], np.int64)
        low, high = (np.array([x[c] for x in known.values()], np.int64) for c in (1, 2))
        done = np.array([at[k] for k in found], np.int64)
        rest = np.setdiff1d(np.arange(len(keys)), done)
        of, off, n, owner = rest, np.zeros(len(rest), np.int64), windows[rest], low[rest]
        if len(done):
            flat_ = np.concatenate(list(found.values()))
            ends = np.cumsum(windows[done])
            fresh = np.append(True, flat_[1:] != flat_[:-1])
            fresh[ends[:-1]] = True
            begin = np.flatnonzero(fresh)
            row = np.searchsorted(ends, begin, side="right")
            of, off, n, owner = (np.concatenate(x) for x in ((of, done[row]), (off, begin - (ends - windows[done])[row]), (n, np.diff(np.append(begin, len(flat_)))), (owner, flat_[begin])))
        useful = owner < high[of]
        of, off, n, owner = of[useful], off[useful], n[useful], owner[useful]
        order = np.argsort(of, kind="stable")
        of, off, n, owner = of[order], off[order], n[order], owner[order]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
        cells = pa.StructArray.from_arrays([pa.array(off, pa.int32()), pa.array(n, pa.int32()), pa.array(owner, pa.int64())], ["off", "n", "owner"])
        h, i = (pa.array([keys[k][c] for k in of[first].tolist()], pa.int64()) for c in (0, 1))
        return pa.table({"h": h, "id": i, "runs": pa.ListArray.from_arrays(pa.array(np.append(first, len(of)), pa.int32()), cells)})

    return strings.select("h", "id", "s", "off", "low", "high", F.pmod("h", F.lit(shards)).alias("shard")).groupBy("shard").applyInArrow(tidy_group(run), kind)


def window_owners(strings: DataFrame, length: int) -> DataFrame:
    """What shard_owners() gives, of strings whose key is crowded: equal single windows meet in an aggregation, whichever strings they are in."""
    each = strings.groupBy("h", "id").agg(F.max("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    windows = F.transform(F.sequence(F.lit(1), F.octet_length("s") - (length - 1)), lambda i: F.xxhash64(F.col("s").substr(i, F.lit(length))))
    dealt = each.select("h", "id", "low", "high", F.posexplode(windows).alias("off", "w"))
    least = dealt.groupBy("h", "w").agg(F.min("low").alias("owner"))
    found = dealt.join(least, ["h", "w"]).where("owner < high")
    return found.groupBy("h", "id").agg(F.collect_list(F.struct("off", F.lit(1).alias("n"), "owner")).alias("runs"))


def cut_spans(data: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of the bytes without the spans, which may overlap; how many bytes and how many maximal spans went."""
    kept, at, removed, n = [], 0, 0, 0
    last = -1
    for a, b in sorted(spans):
        if a > last:
            kept.append(data[at:a])
            n += 1
            removed += b - a
            at = last = b
        elif b > last:
            removed += b - last
            at = last = b
    return b"".join([*kept, data[at:]]), removed, n


def remove_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) with n_bytes, n_removed, n_spans and kept (binary).

    With ``as_text``, kept is a string without the bytes of characters that a span has cut in two.

    Defined cases: null texts are empty; texts shorter than ``length`` keep all; strings never cross documents; rows of
    equal doc_id do not remove from each other; a null doc_id counts as larger than all others, and rows with null
    doc_ids keep what only they share; repeated rows are one class; an empty table gives an empty one. Texts of any length
    are searched whole. Equal texts are told by MD5. Columns called like the new ones are replaced.
    """
    spark = docs.sparkSession
    work = shared_dir(spark)
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept", "_key", "_low", "_spans", "_later")
    own = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("class", F.md5("text")).withColumn("key", F.xxhash64("text"))
    classes = stored(own.groupBy("class").agg(F.min("key").alias("key"), F.min("doc").alias("low"), F.max(F.octet_length("text").cast("long")).alias("size")), f"{work}/classes")
    total = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bits = max(3, int(total // BUCKET_BYTES).bit_length())
    hot = stored(frequent(own, length, bits), f"{work}/hot")
    first = classes.select("key", F.col("low").alias("doc")).join(hot, "key")
    found = stored(pieces(own.join(first, ["key", "doc"]), length, bits), f"{work}/pieces")
    remove(spark, f"{work}/hot")
    strings = found.where("s is not null")
    size = strings.agg(F.coalesce(F.sum(F.octet_length("s").cast("long")), F.lit(0))).first()[0]
    crowded = stored(strings.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("h"), f"{work}/crowded")
    owners = shard_owners(strings.join(crowded, "h", "left_anti"), length, max(8, -(-size // SHARD_BYTES))).unionByName(window_owners(strings.join(crowded, "h", "left_semi"), length))
    owners = stored(owners, f"{work}/owners")
    at = found.where("key is not null").select("h", "id", "key", "doc", "start").join(owners, ["h", "id"])
    at = at.select("key", "doc", "start", F.inline("runs")).where("owner < doc")
    spans = at.groupBy("key", "doc").agg(F.collect_list(F.struct((F.col("start") + F.col("off")).alias("a"), (F.col("start") + F.col("off") + F.col("n") + length - 1).alias("b"))).alias("_spans"))
    plan = classes.join(spans.withColumnRenamed("doc", "low"), ["key", "low"], "left").select(F.col("class").alias("_key"), F.col("low").alias("_low"), "_spans")
    plan = stored(plan, f"{work}/plan")
    for name in ("pieces", "owners", "crowded", "classes"):
        remove(spark, f"{work}/{name}")
    keyed = docs.withColumn("_class", F.md5(F.coalesce("text", F.lit(""))))
    todo = keyed.join(plan, F.col("_class") == F.col("_key")).withColumn("_later", F.coalesce("doc_id", F.lit(LAST)) > F.col("_low")).drop("_class", "_key", "_low")
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows: list[list] = [[], [], [], []]
                of = {name: i for i, name in enumerate(part.schema.names)}
                for text, spans, later in zip(*(part.column(of[c]).to_pylist() for c in ("text", "_spans", "_later")), strict=True):
                    data = (text or "").encode()
                    whole = later and len(data) >= length
                    kept, removed, n = (b"", len(data), 1) if whole else cut_spans(data, [(s["a"], s["b"]) for s in spans or ()])
                    for column, x in zip(rows, (len(data), removed, n, kept), strict=True):
                        column.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
                if as_text:
                    rows[3] = [x.decode("utf-8", "ignore") for x in rows[3]]
                yield pa.RecordBatch.from_arrays([*(part.column(of[c]) for c in names), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    more = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [StructField("kept", StringType() if as_text else BinaryType())]
    return todo.select(*names, "_spans", "_later").mapInArrow(tidy(cut), StructType([*docs.schema, *more]))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 50-byte strings that an earlier one has."""
    done = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
