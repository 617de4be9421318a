"""Exact Jaccard join of documents' word-shingle sets, down to the groups that links connect.

The join skips work by the relations between sets:

* equal sets are one class, searched once;
* classes are indexed by the prefix of their shingles under one global order (common shingles last, else by hash), so
  that two linked sets share an indexed shingle. An index list stands in order of set size, then position. A set passes
  the list from its own place on: where an entry's position leaves too few shingles for the threshold, all entries of
  that size behind it are skipped, and the list ends where sizes do;
* lists of many sets that have the same two centres, their sets of least hashes, are mostly lists of the same sets, and
  are one family, in which each set stands once. A family is cut into blocks by size, position and ring, and pairs of
  blocks that cannot hold a link are skipped whole. The ring is an answer that others are derived from: every set of the
  family is compared with the centres, and two sets are linked only if their distances from a centre differ by no more
  than a link's distance;
* sets that links connect form a group. Blocks tell sets of the first centre's group from others, and blocks of one
  group are not compared with each other: what its sets are linked to, the group is linked to;
* the pairs of blocks that are left are cells of bounded size with whole sets in them. A cell finds all its links
  exactly, by one product of its incidence matrix, and gives a forest that connects what they connect, so its rows are
  never more than its sets.

Which shingles count as common only steers the order, and how long a list counts as long only the way through; any choice
gives the same groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import stored_by
from .common import WORD, documents, flat, remove, shared_dir, slices, stored, table, tidy
from .components import components
from .words import mix, shingle_sets

#: Shingles that are ordered last at most (8 bytes each, broadcast), and the least documents they are in.
MOST_COMMON, COMMON_FROM = 100_000, 64
#: Sets of a list up to which its pairs are listed; beyond it, it is a long one.
LONG_LIST = 64
#: Sets and shingles of a block, about; columns of a matrix product.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 1024, 1 << 19, 4096
#: Classes (24 bytes each) that are broadcast at most.
MOST_SENT = 1_000_000
#: Bytes of all centres' sets that are broadcast at most.
MOST_CENTRES = 16 << 20
#: Counts that a task keeps between rounds of its sketch of frequent shingles.
SKETCH = 1 << 16
_I64 = pa.int64()


def class_key(shingles: np.ndarray, salt: int = 0) -> int:
    """A 64-bit key of a set of shingle hashes; equal sets have equal keys."""
    with np.errstate(over="ignore"):
        own = mix(shingles + np.uint64(salt))
        folded = np.array([np.sum(own), np.bitwise_xor.reduce(mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5))), len(shingles)], np.uint64)
        return int(mix(np.array([np.sum(mix(folded + np.arange(3, dtype=np.uint64)) * np.array([3, 5, 7], np.uint64))], np.uint64)).view(np.int64)[0])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of a set: bit i tells whether an odd number of its shingles hash to i. About four bits a shingle, a power of two of words.

    The sketch of the symmetric difference is the XOR of both sketches, so that has no more bits than the difference
    has shingles. A longer sketch is brought to a shorter one's length by XOR of its halves.
    """
    size = 1 << max(0, (len(shingles) - 1).bit_length() - 4)
    bits = np.bincount((mix(shingles ^ np.uint64(0x5BD1E995)) & np.uint64(64 * size - 1)).astype(np.int64), minlength=64 * size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound for how many shingles are in one of two sets only, from their sketches."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many shingles two sorted sets have in common."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def prefix_length(n: int, num: int, den: int) -> int:
    """How many first shingles of a set of n must be indexed: two sets linked at num/den share one of them."""
    return n - -(-num * n // den) + 1


def _sets(batches: Iterator[pa.RecordBatch], k: int, column: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch, batch.schema.names[column]):
            yield part, shingle_sets(*flat(part.column(column)), k)


_READ = pa.schema([("doc_id", _I64), ("text_hash", _I64), ("n_shingles", _I64), ("key", _I64), ("check", _I64), ("sketch", pa.binary()), ("token", _I64), ("times", _I64)])


def read_sets(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """What one pass over all texts gives, as two kinds of rows.

    A row a document: (doc_id, text_hash, n_shingles, key, check, sketch), of which the last three are null for empty
    sets. And counts of shingles in prefixes by hash (token, times): each task counts with a bounded sketch, in which the
    rarest are forgotten when it is full.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts, waiting, held = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

        def fold(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([tokens, *waiting])
            weights = np.concatenate([counts, np.ones(len(every) - len(tokens), np.int64)])
            tokens, back = np.unique(every, return_inverse=True)
            counts = np.bincount(back, weights, minlength=len(tokens)).astype(np.int64)
            keep = counts >= 2
            if keep.sum() > SKETCH:
                keep = counts > np.partition(counts, -SKETCH)[-SKETCH]
            return tokens[keep], counts[keep]

        for part, sets in _sets(batches, k, 2):
            n, none = part.num_rows, pa.nulls(part.num_rows, _I64)
            yield table(_READ, doc_id=part.column(0), text_hash=part.column(1), n_shingles=[len(s) for s in sets], key=[class_key(s) if len(s) else None for s in sets], check=[class_key(s, 1) if len(s) else None for s in sets], sketch=[sketch(s).tobytes() if len(s) else None for s in sets], token=none, times=none)
            waiting += [s[: prefix_length(len(s), num, den)] for s in sets if len(s)]
            held += sum(map(len, waiting[-n:])) if n else 0
            if held > 2_000_000:
                tokens, counts = fold(tokens, counts)
                waiting.clear()
                held = 0
        tokens, counts = fold(tokens, counts)
        if len(tokens):
            none = pa.nulls(len(tokens), _I64)
            yield table(_READ, doc_id=none, text_hash=none, n_shingles=none, key=none, check=none, sketch=pa.nulls(len(tokens), pa.binary()), token=tokens.view(np.int64), times=counts)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(tidy(run), "doc_id long, text_hash long, n_shingles long, key long, check long, sketch binary, token long, times long")


def common_shingles(counts: DataFrame) -> np.ndarray:
    """Sorted hashes of the most frequent shingles of (token, times); at most MOST_COMMON come to the driver."""
    top = counts.groupBy("token").agg(F.sum("times").alias("n")).where(F.col("n") >= COMMON_FROM).orderBy(F.desc("n"), "token").limit(MOST_COMMON).select("token").toArrow()
    return np.sort(np.asarray(top.column(0).combine_chunks()).astype(np.int64).view(np.uint64))


def postings(docs: DataFrame, k: int, num: int, den: int, common: np.ndarray) -> DataFrame:
    """(token, key, n, pos): the index entries of each class's prefix, once a task; pos counts from 0 in the global order."""
    late = docs.sparkSession.sparkContext.broadcast(common)
    schema = pa.schema([("token", _I64), ("key", _I64), ("n", pa.int32()), ("pos", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, met = late.value, set()
        for _, sets in _sets(batches, k, 0):
            fresh = {key: s for s in sets if len(s) and (key := class_key(s)) not in met}
            met |= fresh.keys()
            if not fresh:
                continue
            every = np.concatenate(list(fresh.values()))
            is_last = last[np.minimum(np.searchsorted(last, every), len(last) - 1)] == every if len(last) else np.zeros(len(every), bool)
            tokens, at = [], 0
            for s in fresh.values():
                own = is_last[at : at + len(s)]
                at += len(s)
                tokens.append((np.concatenate([s[~own], s[own]]) if own.any() else s)[: prefix_length(len(s), num, den)])
            counts = np.array([len(t) for t in tokens])
            sizes = np.array([len(s) for s in fresh.values()], np.int32)
            yield table(schema, token=np.concatenate(tokens).view(np.int64), key=np.repeat(np.array(list(fresh), np.int64), counts), n=np.repeat(sizes, counts), pos=np.concatenate([np.arange(c, dtype=np.int32) for c in counts]))

    return docs.select("text").mapInArrow(tidy(run), "token long, key long, n int, pos int")


def listed_pairs(token: np.ndarray, key: np.ndarray, n: np.ndarray, pos: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a < b) of keys of one list that may be linked by size and position; entries in order of (token, n, pos)."""
    size, n, left = len(token), n.astype(np.int64), (n - pos).astype(np.int64)
    list_end = np.searchsorted(token, token, side="right")
    run = np.append(np.flatnonzero((token[1:] != token[:-1]) | (n[1:] != n[:-1])) + 1, size)  # where sizes change
    behind = run[np.searchsorted(run, np.arange(size), side="right")]
    i = np.arange(size)
    j, a, b = i + 1, [], []
    while len(i):
        inside = j < list_end[i]
        i, j = i[inside], j[inside]
        both = num * (n[i] + n[j])
        go = (den * n[i] >= num * n[j]) & ((num + den) * left[i] >= both)  # sizes only grow, so else nothing is left for i
        i, j, both = i[go], j[go], both[go]
        fits = (num + den) * left[j] >= both
        a.append(key[i[fits]])
        b.append(key[j[fits]])
        j = np.where(fits, j + 1, behind[j])  # behind this entry positions of its size only grow
    x, y = np.concatenate([*a, key[:0]]), np.concatenate([*b, key[:0]])
    found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return found[0], found[1]


def short_list_pairs(index: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of lists (token, key, n, pos) of at most LONG_LIST sets; a pair of several lists may come several times."""
    schema = pa.schema([("a", _I64), ("b", _I64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)]
        for batch in batches:
            whole = [np.concatenate([x, np.asarray(c)]) for x, c in zip(kept, batch.columns, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1])) if len(whole[0]) else 0  # the last list may go on
            kept = [x[cut:] for x in whole]
            a, b = listed_pairs(*(x[:cut] for x in whole), num, den)
            yield table(schema, a=a, b=b)
        a, b = listed_pairs(*kept, num, den)
        yield table(schema, a=a, b=b)

    ordered = index.select("token", "key", "n", "pos").repartition("token").sortWithinPartitions("token", "n", "pos")
    return ordered.mapInArrow(tidy(run), "a long, b long")


def possible(pairs: DataFrame, sets: DataFrame, apart: float) -> DataFrame:
    """The pairs (a, b) of classes whose Jaccard distance may be ``apart`` or less, by their sketches.

    ``sets`` is (key, n, sketch). No pair at that distance is lost.
    """
    x = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    y = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n_a, n_b, s, t in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                keep.append(least_difference(s, t) <= apart / (2 - apart) * (n_a + n_b) + 1e-6)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(tidy(run), "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(key, set, long): the sorted hashes of each class of ``wanted`` (key, check, doc_id, long), from one of its documents.

    Few classes are sent to the documents, many meet them in a shuffle.
    """
    schema = pa.schema([("key", _I64), ("set", pa.binary()), ("long", pa.bool_())])
    own = wanted.select("key", "check", "long", F.col("doc_id").alias("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Where a doc_id has several texts, those of other classes go."""
        for part, sets in _sets(batches, k, 3):
            keys, checks = part.column(0).to_pylist(), part.column(1).to_pylist()
            mine = [i for i, s in enumerate(sets) if len(s) and class_key(s) == keys[i] and class_key(s, 1) == checks[i]]
            yield table(schema, key=[keys[i] for i in mine], set=[sets[i].tobytes() for i in mine], long=part.column(2).take(pa.array(mine, pa.int64())))

    own = F.broadcast(own) if own.count() <= MOST_SENT else own
    return docs.join(own, F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "check", "long", "text").mapInArrow(tidy(run), "key long, set binary, long boolean").dropDuplicates(["key"])


def linked_pairs(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are linked."""
    x = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a"))
    y = sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2), batch.column(3), strict=True):
                u, v = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                both = shared(u, v)
                keep.append(den * both >= num * (len(u) + len(v) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(tidy(run), "a long, b long")


def families(index: DataFrame) -> DataFrame:
    """(family, c0, c1, key, n, pos): the sets of long lists (token, key, n, pos) that have the centres c0 and c1; pos is a set's first one."""
    pick = [F.min(F.struct(F.xxhash64("key", F.lit(i)), F.col("key").alias("key"))).getField("key").alias(f"c{i}") for i in range(2)]
    centres = index.groupBy("token").agg(*pick).withColumn("family", F.xxhash64("c0", "c1"))
    return index.join(centres, "token").groupBy("family", "c0", "c1", "key").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))


def centred(members: DataFrame, sets: DataFrame, num: int, den: int, path: str) -> DataFrame:
    """(family, key, n, pos, ring, centre, link) of each set of the families; the centres' sets are stored at ``path``.

    ``centre`` is the first one, ``ring`` the distance from it in steps of a link's distance, and ``link`` has the
    centres that the set is linked to. Centres whose sets are few bytes are sent to the members, others meet them in a
    shuffle.
    """
    centres = members.select("family", F.posexplode(F.array("c0", "c1")).alias("nth", "c")).distinct()
    centres = centres.join(sets.select(F.col("key").alias("c"), F.col("set").alias("middle")), "c")
    centres = centres.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("nth", "c", "middle"))).alias("middles"), F.sum(F.octet_length("middle")).alias("bytes"))
    centres = stored(centres, path)
    size = centres.agg(F.coalesce(F.sum(F.col("bytes") + 64), F.lit(0))).first()[0]
    centres = F.broadcast(centres.drop("bytes")) if size <= MOST_CENTRES else centres.drop("bytes")
    schema = pa.schema([("family", _I64), ("key", _I64), ("n", pa.int32()), ("pos", pa.int32()), ("ring", pa.int32()), ("centre", _I64), ("link", pa.list_(_I64))])
    wide = (1 - num / den) * (1 + 1e-9) + 1e-12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple[int, np.ndarray]]] = {}  # the centres of families met last
        for batch in batches:
            ring, centre, link = [], [], []
            for t, key, s, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), batch.column(5), strict=True):
                if t not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[t] = [(m["c"], np.frombuffer(m["middle"], np.uint64)) for m in found.as_py()]
                middles = known[t]
                own = np.frombuffer(s.as_buffer(), np.uint64)
                both = [shared(own, m) for _, m in middles]
                either = [len(own) + len(m) - x for x, (_, m) in zip(both, middles, strict=True)]
                ring.append(int((1 - both[0] / either[0]) / wide))
                centre.append(middles[0][0])
                link.append([c for (c, _), x, y in zip(middles, both, either, strict=True) if c != key and den * x >= num * y])
            yield table(schema, family=batch.column(0), key=batch.column(1), n=batch.column(2), pos=batch.column(3), ring=ring, centre=centre, link=link)

    both = members.select("family", "key", "n", "pos").join(sets, "key").join(centres, "family").select("family", "key", "n", "pos", "set", "middles")
    return both.mapInArrow(tidy(run), "family long, key long, n int, pos int, ring int, centre long, link array<long>")


def block_pairs(entries: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Entries (family, key, n, pos, ring, group, inside) in their blocks, and the pairs of blocks that may hold a link between groups.

    Kinds of entries have one side (inside the first centre's group or not), size class, ring and eighth of the prefix.
    In that order kinds with few sets or shingles share a block, and one with many is dealt by hash to parts of the
    size of a block. Only counts of kinds meet in a family's window, however large it is.
    """
    kind = ["family", "inside", "c", "ring", "eighth"]
    classed = entries.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int"))
    classed = classed.withColumn("eighth", F.floor(8 * F.col("pos") / (F.col("n") - F.ceil(F.col("n") * num / den) + 1)).cast("int")).select(*kind, "key", "n", "pos", "group")
    left = F.col("n") - F.col("pos")
    weight = F.greatest(F.lit(1 / BLOCK_SETS), F.col("n") / BLOCK_SHINGLES)
    kinds = classed.groupBy(*kind).agg(F.sum(weight).alias("load"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(left).alias("left"), F.min("group").alias("g0"), F.max("group").alias("g1"))
    before = Window.partitionBy("family").orderBy(*kind[1:]).rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("block", F.floor(F.coalesce(F.sum("load").over(before), F.lit(0.0))).cast("long"))
    blocks = kinds.groupBy("family", "block").agg(
        F.ceil(F.sum("load")).cast("int").alias("parts"), F.min("n0").alias("n0"), F.max("n1").alias("n1"), F.max("left").alias("left"),
        F.min("ring").alias("r0"), F.max("ring").alias("r1"), F.min("g0").alias("g0"), F.max("g1").alias("g1"),
    )
    placed = classed.join(kinds.select(*kind, "block"), kind).join(blocks.select("family", "block", "parts"), ["family", "block"])
    placed = placed.select("family", "block", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "n", "pos", "group")
    columns = [c for c in blocks.columns if c != "family"]
    x, y = blocks.select("family", *(F.col(c).alias(f"x_{c}") for c in columns)), blocks.select("family", *(F.col(c).alias(f"y_{c}") for c in columns))
    near = (
        (F.col("x_block") <= F.col("y_block"))
        & (den * F.col("x_n1") >= num * F.col("y_n0")) & (den * F.col("y_n1") >= num * F.col("x_n0"))
        & (F.col("x_r0") - F.col("y_r1") <= 1) & (F.col("y_r0") - F.col("x_r1") <= 1)
        & ((num + den) * F.least("x_left", "y_left") >= num * (F.col("x_n0") + F.col("y_n0")))
        & (F.least("x_g0", "y_g0") != F.greatest("x_g1", "y_g1"))
    )
    pairs = x.join(y, "family").where(near).select("family", F.col("x_block").alias("b1"), F.col("y_block").alias("b2"), F.explode(F.sequence(F.lit(0), F.col("x_parts") - 1)).alias("p1"), "y_parts")
    pairs = pairs.select("family", "b1", "p1", "b2", F.explode(F.sequence(F.lit(0), F.col("y_parts") - 1)).alias("p2")).where("b1 <> b2 or p1 <= p2")
    return placed, pairs


def cell_links(left: list[tuple], right: list[tuple] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest (node, root of its tree) of the links between sets (key, n, pos, group, set) of different groups: of two blocks, or of one."""
    rows = left + (right or [])
    key, n, pos, group = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    m, rest = len(left), n - pos
    a, b = (slice(0, m), slice(m, None)) if right is not None else (slice(None), slice(None))
    both = n[a, None] + n[None, b]
    may = (group[a, None] != group[None, b]) & (den * np.minimum(n[a, None], n[None, b]) >= num * np.maximum(n[a, None], n[None, b])) & ((num + den) * np.minimum(rest[a, None], rest[None, b]) >= num * both)
    if right is None:
        may &= key[:, None] < key[None, :]
    u, v = np.nonzero(may)
    if not len(u):
        return key[:0], key[:0]
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    shift = m if right is not None else 0
    if len(u) * (1e-5 + 1e-8 * float(n.mean())) < 1e-10 * both.size * float(n.sum()) / 4:
        met = np.array([shared(sets[i], sets[shift + j]) for i, j in zip(u.tolist(), v.tolist(), strict=True)], np.int64)
    else:
        tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
        several = np.bincount(column, minlength=len(tokens)) > 1  # a shingle of one set is in no intersection
        place = np.cumsum(several) - 1
        row, use = np.repeat(np.arange(len(rows)), n), several[column]
        row, column = row[use], place[column[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        inner = np.zeros((m if right is not None else len(rows), len(rows) - shift), np.float64 if n.max() >= 1 << 24 else np.float32)
        edges = np.searchsorted(column, np.arange(0, int(several.sum()) + COLUMNS, COLUMNS))
        for block, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            wide = np.zeros((len(rows), COLUMNS), inner.dtype)
            wide[row[i:j], column[i:j] - block * COLUMNS] = 1
            inner += wide[a] @ wide[b].T
        met = inner[u, v].astype(np.int64)
    linked = den * met >= num * (both[u, v] - met)
    u, v = u[linked], v[linked] + shift
    root = np.arange(len(rows))
    while len(u):
        least = root.copy()
        np.minimum.at(least, u, root[v])
        np.minimum.at(least, v, root[u])
        np.minimum.at(least, root, least.copy())  # a tree follows its least node
        least = least[root]
        while (least != least[least]).any():
            least = least[least]
        if (least == root).all():
            break
        root = least
    moved = np.flatnonzero(root != np.arange(len(rows)))
    return key[moved], key[root[moved]]


def cells(placed: DataFrame, pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that connect what all links between groups in pairs of blocks connect."""
    schema = pa.schema([("a", _I64), ("b", _I64)])
    side = lambda b, p, i: pairs.select("family", F.col(b).alias("block"), F.col(p).alias("part"), "b1", "p1", "b2", "p2", F.lit(i).alias("side"))
    ends = side("b1", "p1", 0).unionByName(side("b2", "p2", 1).where("b1 <> b2 or p1 <> p2"))
    name = ["family", "b1", "p1", "b2", "p2"]

    def check(rows: list[list[tuple]]) -> pa.RecordBatch | None:
        first, *second = rows
        a, b = cell_links(first, second[0] if second else None, num, den)
        return table(schema, a=a, b=b) if len(a) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:5] != now:
                    if held and (out := check(held)):
                        yield out
                    now, held = row[:5], [[]]
                if row[5] and len(held) < 2:
                    held.append([])
                held[row[5]].append(row[6:])
        if held and (out := check(held)):
            yield out

    met = ends.join(placed, ["family", "block", "part"]).join(sets, "key").select(*name, "side", "key", "n", "pos", "group", "set")
    return met.repartition(*name).sortWithinPartitions(*name, "side").mapInArrow(tidy(run), "a long, b long")


def linked_classes(docs: DataFrame, index: DataFrame, reps: DataFrame, k: int, num: int, den: int, work: str) -> DataFrame:
    """(node, root) of the classes that are linked to another; see the module's text. ``index``: (token, key, n, pos, m); ``reps``: (key, check, doc_id, n, sketch)."""
    apart = 1 - num / den + 1e-9
    few, long = index.where(F.col("m") <= LONG_LIST), index.where(F.col("m") > LONG_LIST)
    pairs = stored(possible(short_list_pairs(few, num, den).distinct(), reps, apart), f"{work}/pairs")
    members = stored(families(long), f"{work}/members")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key"), F.lit(False).alias("long"))
    wanted = ends.unionByName(members.select("key", F.lit(True).alias("long"))).groupBy("key").agg(F.max("long").alias("long"))
    sets = stored_by(sets_of(docs, wanted.join(reps.select("key", "check", "doc_id"), "key"), k), "key", f"{work}/sets")
    long_sets = sets.where("long").select("key", "set")
    entries = stored(centred(members, long_sets, num, den, f"{work}/centres"), f"{work}/entries")
    to_centres = entries.select(F.col("key").alias("a"), F.explode("link").alias("b"))
    label = stored(components(linked_pairs(pairs, sets, num, den).unionByName(to_centres)), f"{work}/label")
    remove(docs.sparkSession, f"{work}/pairs")
    # sets of one group need no comparison; the rest of a family meets in cells, and links join groups
    group = F.coalesce("root", "key")
    own = entries.drop("link").join(label.withColumnRenamed("node", "key"), "key", "left").withColumn("group", group).drop("root")
    middle = label.select(F.col("node").alias("centre"), F.col("root").alias("_root"))
    own = own.join(middle, "centre", "left").withColumn("inside", F.col("group") == F.coalesce("_root", "centre"))
    found = stored(cells(*block_pairs(own, num, den), long_sets, num, den), f"{work}/found")
    of = lambda c: label.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    joined = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    more = stored(components(joined), f"{work}/more")
    for name in ("sets", "members", "centres", "entries", "found"):
        remove(docs.sparkSession, f"{work}/{name}")
    upper = more.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    lone = more.join(label.select("node"), "node", "left_anti")
    return label.join(upper, "root", "left").select("node", F.coalesce("_top", "root").alias("root")).unionByName(lone)


def grouped(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """join_groups() with the hash of each document's text and its group: (doc_id, text_hash, n_shingles, component_id, root, apart). Empty sets have no root."""
    docs = docs.select("doc_id", "text")
    work = shared_dir(docs.sparkSession)
    read = stored(read_sets(docs, k, num, den), f"{work}/read")
    meta = read.where("token is null")
    every = stored(postings(docs, k, num, den, common_shingles(read.where("token is not null").select("token", "times"))), f"{work}/postings")
    # a list of one class has no pair
    lists = every.groupBy("token").agg(F.min("key").alias("_low"), F.max("key").alias("_high"), F.count(F.lit(1)).alias("m")).where("_low <> _high").select("token", "m")
    index = stored(every.join(lists, "token").dropDuplicates(["token", "key"]), f"{work}/index")
    remove(docs.sparkSession, f"{work}/postings")
    reps = meta.where("key is not null").groupBy("key", "check").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    reps = stored(reps, f"{work}/reps")
    labels = linked_classes(docs, index, reps, k, num, den, work)
    # of unlinked classes both keys count
    least = reps.join(labels, F.col("key") == F.col("node"), "left").select("key", "check", "doc_id", F.coalesce("root", "key").alias("root"), F.when(F.col("root").isNull(), F.col("check")).otherwise(F.lit(0)).alias("apart"))
    groups = least.groupBy("root", "apart").agg(F.min("doc_id").alias("component_id"))
    placed = least.select("key", "check", "root", "apart").join(groups, ["root", "apart"]).select(F.col("key").alias("_key"), F.col("check").alias("_check"), "component_id", "root", "apart")
    done = meta.join(placed, (F.col("key") == F.col("_key")) & (F.col("check") == F.col("_check")), "left")
    return done.select("doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root", "apart")


def join_groups(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each document (doc_id, text) under links of Jaccard >= num/den.

    component_id is the least doc_id that links reach. Defined cases: a text with fewer than k words has its whole word
    sequence as its one shingle; null texts and texts without words have no shingles, no links and their own doc_id;
    repeated rows are documents of equal sets; a null doc_id is never a component_id unless it stands alone; texts of
    any length are read whole; other columns are ignored. Classes are told by 128 bits, shingles by 64.
    """
    return grouped(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each group of ``docs``: the one of least doc_id, then least hash of the text, nulls last.

    Each row is judged by its own text, also where a doc_id is repeated or null. Rows without words are in no group and
    stay. All columns of ``docs`` stay, and only they.
    """
    row = ["_none", "_id", "_hash"]
    names = [F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id")]
    placed = grouped(docs, k, num, den).where("root is not null").select("root", "apart", *names, F.col("text_hash").alias("_hash"))
    first = placed.groupBy("root", "apart").agg(F.min(F.struct(*row)).alias("_first")).select("_first.*")
    wordless = ~F.coalesce("text", F.lit("")).rlike(WORD)
    named = docs.where(~wordless).select("*", *names, F.xxhash64("text").alias("_hash"))
    # rows of equal doc_id and text are in one group, so one of them goes on
    return named.join(first, row).dropDuplicates(row).select(*docs.columns).unionByName(docs.where(wordless))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that links of Jaccard 0.85 on 4-word shingles connect."""
    return join_groups(documents(spark, sf_dir), 4, 85, 100)
