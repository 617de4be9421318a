"""Queries without SQL, and the pipeline's stages, over a small folder of tables against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_sets_and_repeats import brute_repeats, brute_targets, shingles

from readdup.llm import mixing, quality, queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with copies, near copies, shared passages, junk, null and empty texts and repeated rows; labels; pages; conversations."""
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    base, passage = [text(90) for _ in range(12)], text(15)
    texts = [*base, *base[:3]]
    for b in base[:8]:
        parts = b.split(" ")
        parts[rng.randrange(len(parts))] = "changed"
        texts.append(" ".join(parts))
    texts += [f"{text(20)} {passage} {text(20)}" for _ in range(15)]
    texts += [" ".join(rng.choice(words).upper() + "!!" for _ in range(rng.randint(5, 60))) for _ in range(40)]
    texts += [text(rng.randint(1, 120)) for _ in range(120)] + [None, "", " \n ", "é" * 70, "x " * 400]
    rows = [(i, t, "en", rng.choice(["a", "a", "a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[3], (None, base[0], "en", "b", 5), (None, None, None, None, None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("!!" not in (t or "")), 0) for i, t in enumerate(texts) if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    pages = [(1, "u", "<p>a<p>b"), (2, "v", None), (2, "v", None), (None, "w", "<ul><li>x</ul>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return str(path), rows


def by_pairs(machine, text, n_chars):
    """A score by the sum over all pairs of features."""
    of, bucket, weight, stats = quality.features(pa.array([text], pa.string()), [pa.array([n_chars], pa.int64())])
    _, f, x = machine.rows(of, bucket, weight, stats)
    inner = machine.v[f] @ machine.v[f].T * np.outer(x, x)
    z = machine.w0 + (machine.w[f] * x).sum() + np.triu(inner, 1).sum()
    return 1 / (1 + np.exp(-z))


def test_quality(spark, folder):
    path, rows = folder
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    machine = quality.train(docs, labels)
    got = sorted((repr(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in queries.queries()["op4_quality"](spark, path).collect())
    want = []
    for d, t, _, _, n in rows:
        s = by_pairs(machine, t, n)
        want.append((repr(d), d is not None and zlib.crc32(str(d).encode()) % 5 == 0, round(s, 9), int(s >= 0.3)))
    assert got == sorted(want)


def test_codec_files_and_pages(spark, folder):
    path, rows = folder
    found = queries.queries()
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for d, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((repr(d), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found["op6_bpe_codec"](spark, path).collect()) == sorted(want)
    library, at, want = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, found["op9_token_files"](spark, path).collect()), key=lambda r: r[1]) == want
    assert sorted((repr(r.page_id), r.text, r.n_chars) for r in found["op7_html_text"](spark, path).collect()) == [("1", "a\n\nb", 4), ("2", "", 0), ("2", "", 0), ("None", "- x", 3)]


def test_repeats(spark, folder):
    path, rows = folder
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.queries()["op10_suffix_dedup"](spark, path).collect())
    assert got == brute_repeats([(d, t) for d, t, *_ in rows])


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_pipeline_by_stages(spark, folder):
    """Every stage against brute force on what the stage before it kept, and run() against the last one."""
    path, rows = folder
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    frame = lambda rows: spark.createDataFrame(rows, DOCUMENTS)
    take = lambda name, rows: sorted((tuple(r) for r in stages[name](spark, frame(rows), path).collect()), key=repr)

    machine = quality.train(frame(rows), spark.read.parquet(f"{path}/labels.parquet"))
    kept = take("quality classifier", rows)
    assert kept == sorted((r for r in rows if by_pairs(machine, r[1], r[4]) >= 0.3), key=repr) and 100 < len(kept) < len(rows)

    one = take("n-gram Jaccard join", kept)
    sets, group = [shingles(r[1], 5) for r in kept], list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    first = {}
    for i, (r, g) in enumerate(zip(kept, group, strict=True)):
        if sets[i]:
            first[g] = min(first.get(g, (True, 0, "")), (r[0] is None, r[0] or 0, r[1]))
    wordless = [r for r, s in zip(kept, sets, strict=True) if not s]
    assert Counter((r[0] is None, r[0] or 0, r[1]) for r in one if words(r[1])) == Counter(first.values())
    assert sorted((r for r in one if not words(r[1])), key=repr) == sorted(wordless, key=repr) and len(one) < len(kept)

    cut = take("suffix-array dedup", one)
    want = sorted((d, n - gone) for d, n, gone, _, _ in brute_repeats([(r[0], r[1]) for r in one]))
    assert sorted((repr(r[0]), len(r[1].encode())) for r in cut) == want
    digest = {(d, k) for d, _, _, _, k in brute_repeats([(r[0], r[1]) for r in one])}
    assert {(repr(r[0]), hashlib.sha256(r[1].encode()).hexdigest()) for r in cut} == digest and all(r[4] == len(r[1]) for r in cut)

    mixed = take("mixing sources to target weights", cut)
    copies = Counter(mixed)
    assert set(copies) <= {r for r in cut} and max(copies.values()) <= 2
    sizes = Counter()
    for r in cut:
        sizes[r[3]] += words(r[1])
    targets = brute_targets(dict(sizes), [5, 2, 1], 150)
    most = max(words(r[1]) for r in cut)
    for source, target in targets.items():
        # whole blocks, and at most two documents a shard that a run cuts and rounding moves
        shards = -(-sizes[source] // mixing.SHARD_WORDS) + 1
        assert abs(sum(words(r[1]) * n for r, n in copies.items() if r[3] == source) - target) <= 16 + shards * most

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda rows: sorted((repr(r[0]), r[1], r[2]) for r in rows)
    encoded = [(r[0], len(e), e) for r in mixed if (e := library.encode(r[1] or "", add_special_tokens=False).ids) is not None]
    assert ids(take("BPE encoding and decoding", mixed)) == ids(encoded)
    assert ids(tuple(r) for r in corpus_pipeline.run(spark, path).collect()) == ids(encoded)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, folder, name):
    path, rows = folder
    done = dict(corpus_pipeline.STAGES)[name](spark, spark.createDataFrame(rows, DOCUMENTS).limit(0), path)
    assert done.count() == 0
    if name != "BPE encoding and decoding":
        assert done.columns == [c.split()[0] for c in DOCUMENTS.split(", ")]
