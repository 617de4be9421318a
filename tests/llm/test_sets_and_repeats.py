"""Operators over documents against brute force on small and awkward tables."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from readdup.llm import components, jaccard, mixing, repeats
from readdup.llm.suffix import common_prefixes, suffix_array

random.seed(11)
WORDS = [f"w{i}" for i in range(400)]


def text(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def edited(t, n):
    words = t.split(" ")
    for _ in range(n):
        words[random.randrange(len(words))] = random.choice(WORDS)
    return " ".join(words)


def awkward():
    """Copies, chains of near copies, shared passages, short, empty, null and repeated rows, null ids, one long text."""
    base, passage = text(120), text(60)
    rows = [(0, base), (1, base), (2, base.upper()), (3, None), (4, ""), (5, " \n\t"), (6, "one"), (7, "ONE"), (8, "a b c"), (9, "a b c"), (10, passage), (11, text(40) + " " + passage), (12, passage + " " + text(30)), (None, base), (None, text(20)), (13, text(5000)), (14, "é" * 60), (15, "x" + "é" * 59)]
    chain = base
    for i in range(16, 40):
        chain = edited(chain, 1)
        rows.append((i, chain))
    rows += [(i, edited(base, random.randint(1, 6))) for i in range(40, 70)] + [(i, text(random.randint(1, 9))) for i in range(70, 90)]
    return rows + [(10, passage), (1, base), (90, "x x x x x x x x x x x"), (91, "x x x x x")]


SCHEMA = "doc_id long, text string, key string, n_removed int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "k", 7) for d, t in rows], SCHEMA)


def shingles(t, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute_groups(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return sorted((repr(d), len(s), repr(least.get(g, d))) for (d, _), s, g in zip(rows, sets, group, strict=True))


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_jaccard_groups(spark, k, num, den):
    rows = awkward()
    got = jaccard.join_groups(frame(spark, rows), k, num, den).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute_groups(rows, k, num, den)


def test_jaccard_order_of_shingles_does_not_matter(spark, monkeypatch):
    rows = awkward()
    monkeypatch.setattr(jaccard, "COMMON_FROM", 2)
    monkeypatch.setattr(jaccard, "MOST_SENT", 0)
    got = jaccard.join_groups(frame(spark, rows), 4, 85, 100).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute_groups(rows, 4, 85, 100)


@pytest.mark.parametrize("block", [3, 1024])
def test_jaccard_long_lists(spark, monkeypatch, block):
    """Families around a text with ever more edits, and outsiders that share its beginning: blocks, rings and cells."""
    monkeypatch.setattr(jaccard, "LONG_LIST", 2)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    if block == 3:  # both ways to the centres are tried
        monkeypatch.setattr(jaccard, "MOST_CENTRES", -1)
    rows = awkward()
    for start in (1000, 2000):
        base = text(60)
        rows += [(start + i, edited(base, i // 6)) for i in range(60)] + [(start + 100 + i, base[: 40 + 3 * i] + " " + text(30 + i)) for i in range(20)]
    got = jaccard.join_groups(frame(spark, rows), 4, 85, 100).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in got) == brute_groups(rows, 4, 85, 100)


def test_cells_of_many_near_copies_give_few_rows(spark, monkeypatch):
    """A cell's rows are a forest, however many links it has."""
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 2**63, 150, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > share], rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)])) for share in np.repeat([0.0, 0.02, 0.08, 0.2, 0.5], 40)]
    rows = [(i, len(s), 0, i, s.tobytes()) for i, s in enumerate(sets)]
    want = {frozenset((i, j)) for i, s in enumerate(sets) for j, t in enumerate(sets[:i]) if 100 * len(np.intersect1d(s, t)) >= 85 * len(np.union1d(s, t))}

    def reach(links, n):
        root = list(range(n))
        for a, b in links:
            x, y = root[a], root[b]
            root = [y if r == x else r for r in root]
        return {frozenset(i for i in range(n) if root[i] == r) for r in set(root)}

    a, b = jaccard.cell_links(rows, None, 85, 100)
    assert len(a) < len(rows) < len(want)
    assert all(int(x) != int(y) for x, y in zip(a, b, strict=True))
    assert reach(zip(a.tolist(), b.tolist(), strict=True), len(rows)) == reach(map(tuple, want), len(rows))
    a, b = jaccard.cell_links(rows[::2], rows[1::2], 85, 100)
    across = [tuple(p) for p in want if sum(p) % 2]
    assert reach(zip(a.tolist(), b.tolist(), strict=True), len(rows)) == reach(across, len(rows))
    assert len(jaccard.cell_links([(*r[:3], 5, r[4]) for r in rows], None, 85, 100)[0]) == 0


def test_listed_pairs_lose_no_link():
    rng = np.random.default_rng(9)
    for _ in range(60):
        m = int(rng.integers(1, 120))
        token, n = rng.integers(0, 5, m), rng.integers(1, 40, m).astype(np.int32)
        pos = (rng.random(m) * (n - np.ceil(0.85 * n) + 1)).astype(np.int32)
        key = rng.permutation(m)
        order = np.lexsort((pos, n, token))
        token, n, pos, key = token[order], n[order], pos[order], key[order]
        a, b = jaccard.listed_pairs(token, key, n, pos, 85, 100)
        want = set()
        for i in range(m):
            for j in range(i):
                small, large = sorted((int(n[i]), int(n[j])))
                if token[i] == token[j] and 100 * small >= 85 * large and 185 * min(n[i] - pos[i], n[j] - pos[j]) >= 85 * (small + large):
                    want.add((min(key[i], key[j]), max(key[i], key[j])))
        assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_one_of_each(spark):
    rows = [(3, text(50)), (1, None), (2, "")]
    rows += [(4, rows[0][1]), (3, rows[0][1]), (None, "z")]
    got = jaccard.one_of_each(frame(spark, rows)).collect()
    assert sorted(repr(r.doc_id) for r in got) == ["1", "2", "3", "None"]


def test_one_of_each_judges_every_row_by_its_text(spark):
    rows = awkward() + [(300, text(40)), (300, text(40)), (301, "new " + text(30)), (None, None), (None, " "), (302, "a b c")]
    rows += [(301, rows[0][1]), (None, rows[-6][1] + " end"), (None, edited(rows[11][1], 1)), (-4, rows[3][1]), (4, "")]
    sets = [shingles(t, 5) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in jaccard.one_of_each(frame(spark, rows)).collect())
    members = {}
    for (d, t), s, g in zip(rows, sets, group, strict=True):
        if s:
            members.setdefault(g, set()).add((d is None, d or 0, t))
    assert [r for r in got if not shingles(r[2], 5)] == sorted((d is None, d or 0, t or "") for (d, t), s in zip(rows, sets, strict=True) if not s)
    kept = [r for r in got if shingles(r[2], 5)]
    assert len(kept) == len(members)
    for those in members.values():
        (mine,) = [r for r in kept if r in those]
        assert mine[:2] == min(those)[:2]


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    assert jaccard.join_groups(none, 4, 85, 100).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    sized = none.select("doc_id", F.lit("s").alias("source"), mixing.words_in(F.col("text")).alias("size"))
    assert mixing.mix(sized).count() == 0


def test_sketches_bound_differences():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, rng.integers(1, 300), dtype=np.uint64)]))
        assert jaccard.least_difference(jaccard.sketch(a).tobytes(), jaccard.sketch(b).tobytes()) <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 100), (7, 7), (300, 100)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length=50):
    first = {}
    last = repeats.LAST
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            g = b[i : i + length]
            first[g] = min(first.get(g, last), last if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (last if d is None else d):
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((repr(d), len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length", [3, 9, 20, 50])
def test_equal_windows_have_equal_keys(length):
    for letters in (b"ab", b"abcdefgh ", bytes(range(256))):
        data = [bytes(random.choice(letters) for _ in range(random.randint(0, 120))) * random.choice([1, 3]) for _ in range(20)]
        data += [d[7:90] + d[:40] for d in data]
        raw, at = np.frombuffer(b"".join(data), np.uint8), np.append(0, np.cumsum([len(d) for d in data]))
        key = {}
        gram, side = repeats.shape(length)
        seen = 0
        for a, b, v, row, off in zip(*(x.tolist() for x in repeats.key_runs(raw, at, length)), strict=True):
            for i in range(a, b):
                window = bytes(raw[i : i + length])
                assert at[row] <= i and i + length <= at[row + 1] and key.setdefault(window, v) == v
                seen += 1
            if off >= 0:
                place = bytes(raw[a + off : a + off + gram + side])
                assert all(place in bytes(raw[i : i + length]) for i in range(a, b))
        assert seen == sum(max(0, len(d) - length + 1) for d in data)


def check_repeats(spark, rows):
    done = repeats.remove_repeats(frame(spark, rows))
    assert sorted(done.columns) == sorted(["doc_id", "text", "key", "n_bytes", "n_removed", "n_spans", "kept"])
    got = [(repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in done.collect()]
    assert sorted(got) == brute_repeats(rows)


@pytest.mark.parametrize("crowded", [0, 3, repeats.CROWDED])
def test_repeats(spark, monkeypatch, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    rows = awkward() + [(200, "ab" * 300), (201, "zz" + "ab" * 200 + "q"), (202, "ab" * 25), (203, "b" + "ab" * 24), (204, "0" * 49), (205, "0" * 49), (206, "0" * 51)]
    check_repeats(spark, rows)


def test_one_line_between_other_neighbours(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CROWDED", 50)
    line = "this line of words stands in every document of all"
    rows = [(i, f"{text(6)} {line[: 30 + i % 21]} {text(8)}") for i in range(500)]
    check_repeats(spark, rows)


def test_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SCAN_BYTES", 1 << 10)
    monkeypatch.setattr(repeats, "PACK_BYTES", 4 << 10)
    long = text(20_000)
    check_repeats(spark, [(1, long), (2, f"x {long[5000:90000]} y"), (3, long[200:300] + text(30)), (4, "-" * 40_000), (5, None), (6, "")])


def test_repeats_as_text(spark):
    done = repeats.remove_repeats(frame(spark, [(1, "é" * 60), (2, "x" + "é" * 60 + "y")]), as_text=True)
    assert {r.doc_id: r.kept for r in done.collect()} == {1: "é" * 60, 2: "xy"}


def test_suffix_arrays():
    for _ in range(400):
        letters = random.choice([b"ab", b"abc", bytes(range(256)), b"a"])
        d = bytes(random.choice(letters) for _ in range(random.randint(0, 60))) * random.choice([1, 1, 1, 4])
        a = np.frombuffer(d, np.uint8)
        order = suffix_array(a)
        want = sorted(range(len(d)), key=lambda i: d[i:])
        assert order.tolist() == want
        shared = common_prefixes(a, order, 20)
        for x, y in zip(want, want[1:], strict=False):
            n = 0
            while n < 20 and max(x, y) + n < len(d) and d[x + n] == d[y + n]:
                n += 1
            assert shared[y] == n


def test_may_share_loses_no_window():
    passage = bytes(random.choice(b"abcdefgh ") for _ in range(80))
    strings = [passage[i : i + random.randint(50, 60)] for i in range(0, 20, 3)] + [bytes(random.choice(b"abcdefgh ") for _ in range(55)) for _ in range(10)]
    strings = [s for s in strings if len(s) >= 50]
    h, off = np.zeros(len(strings), np.int64), np.zeros(len(strings), np.int64)
    for i, s in enumerate(strings):
        _, _, value, _, places = repeats.key_runs(np.frombuffer(s, np.uint8), np.array([0, len(s)]), 50)
        h[i], off[i] = int(value[0] >> np.uint64(16)), places[0]
    keep = repeats.may_share(strings, h, off, 50)
    for i, s in enumerate(strings):
        for j, t in enumerate(strings):
            if i != j and h[i] == h[j] and {s[a : a + 50] for a in range(len(s) - 49)} & {t[a : a + 50] for a in range(len(t) - 49)}:
                assert keep[i] and keep[j]


def brute_targets(sizes, weights, share):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()) * share / 100, set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        got = {s: left * w[s] / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if got[s] > 2 * sizes[s]}
        if not over:
            return got | {s: 2.0 * sizes[s] for s in full}
        full |= over


def test_mixing(spark):
    rows = [(i, random.choice(["a", "b", "b", "b", "c", None, "Z"]), " ".join(["x"] * random.choice([0, 1, 3, 50, 400]))) for i in range(300)] + [(7, "b", "x x"), (7, "b", "x x"), (None, "a", "x"), (8, "c", None), (9, "tiny", "x")]
    sized = spark.createDataFrame(rows, "doc_id long, source string, text string").select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))
    got = mixing.mix(sized, [5, 2, 1], 150, 2, shard_words=2000).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = brute_targets(sizes, [5, 2, 1], 150)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 16 * 4
    again = mixing.mix(sized.repartition(3), [5, 2, 1], 150, 2, shard_words=2000).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_highest_quotients(spark):
    rows = [(g, i, float(random.choice([0, 1, 1, 2, 7, 50, 1000]))) for g in range(4) for i in range(1 + 9 * g)]
    seats = {0: 5, 1: 0, 2: 17, 3: 1000}
    df = spark.createDataFrame([(g, i, v, seats[g]) for g, i, v in rows], "g long, i long, v double, s long")
    got = {(r.g, r.i): r.out for r in mixing.highest_quotients(df, ["g"], "v", "s", ["i"], "out").collect()}
    for g, n in seats.items():
        have = {i: 0 for gg, i, _ in rows if gg == g}
        votes = {i: v for gg, i, v in rows if gg == g}
        for _ in range(n if any(votes.values()) else 0):
            have[max(have, key=lambda i: (votes[i] / (2 * have[i] + 1), -i))] += 1
        assert {i: got[g, i] for i in have} == have


def test_mix_with_clashing_columns(spark):
    rows = [(i if i % 7 else None, "ab"[i % 2], i % 9) for i in range(60)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long")
    clash = sized.select("*", *(F.lit("x").alias(c) for c in mixing.WORKING), F.lit(1).alias("other"))
    plain = mixing.mix(sized, shard_words=50)
    got = mixing.mix(clash, shard_words=50)
    assert sorted(got.columns) == sorted([*plain.columns, "other"])
    assert sorted(map(repr, got.drop("other").select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))


def test_mixed_documents(spark):
    rows = [(i, "a" if i % 3 else None, " ".join(["x"] * (1 + i % 50))) for i in range(200)] + [(500, "a", None), (501, "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mixed_documents(docs).collect()
    assert got and max(sum(r.doc_id == i for r in got) for i in range(200)) <= 2
    assert not [r for r in got if r.doc_id >= 500]
