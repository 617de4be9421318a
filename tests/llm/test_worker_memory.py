"""What Python workers keep of a task that has ended: they outlive it, and count beside the joins of their executor."""

from __future__ import annotations

import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from readdup.llm import bpe, jaccard, quality, repeats, token_files
from readdup.llm.common import give_back, slices, tidy

public_tokenizers = pytest.importorskip("public_tokenizers")
pytestmark = pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from Linux's smaps")


def unused(spark) -> int:
    """MB that the idle worker with most of it could give back, which it then does."""

    def anonymous() -> int:
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10

    def look(batches):
        for _ in batches:
            pass
        time.sleep(0.5)  # so that each task has a worker of its own
        before = anonymous()
        give_back()
        yield pa.RecordBatch.from_pydict({"mb": [before - anonymous()]})

    return max(r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(look, "mb long").collect())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("%x" % rng.getrandbits(48) for _ in range(400))) for i in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def test_token_files_leave_no_unused_memory(spark, texts, tmp_path):
    unused(spark)
    assert token_files.write_tokens(texts, str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"), 0).collect()[0].n_docs == 1500
    assert unused(spark) < 40


STAGES = {
    "quality": lambda docs: quality.score(docs, quality.fit([], np.empty((0, quality.STATS)), np.empty(0)), ()),
    "sets": lambda docs: jaccard.read_sets(docs, 5, 80, 100),
    "keys": lambda docs: repeats.frequent(docs.selectExpr("doc_id AS key", "text"), 50, 3),
    "strings": lambda docs: repeats.pieces(docs.selectExpr("doc_id AS key", "doc_id AS doc", "text", "array(0L) AS hot"), 50, 3),
    "ids": lambda docs: bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json")),
}


@pytest.mark.parametrize("stage", STAGES)
def test_stages_of_the_pipeline_leave_no_unused_memory(spark, texts, stage):
    unused(spark)
    STAGES[stage](texts).collect()
    assert unused(spark) < 20


def test_units_are_shown_to_digests_alone():
    codec = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    ids = codec.encode(["some words", "", "more <|endoftext|> of them"])
    assert codec.ids.n and not codec.shown and not codec.read
    n, hashes, _ = codec.digests(["some words", "some new words", ""])
    assert n[0] == len(ids[0]) and hashes[0] == hashlib.sha256(" ".join(map(str, ids[0].tolist())).encode()).hexdigest()
    assert len(codec.shown) == len(codec.read) == codec.ids.n


def test_tidy_passes_rows_and_errors():
    batch = pa.RecordBatch.from_pydict({"text": ["a", "b", None]})
    assert [b.num_rows for b in tidy(lambda batches: (p for b in batches for p in slices(b, most=1)))(iter([batch, batch]))] == [1, 2, 1, 2]

    def broken(batches):
        yield next(batches)
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        list(tidy(broken)(iter([batch])))
