"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct hashed words, weighted 1 + log(count) to unit length, and each statistic's bin
as an indicator. The score is the logistic function of

    w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

so all pairwise interactions cost as much as one pass over the features. Training runs in one task by Adagrad over a
bounded sample of labelled rows, and only the model comes to the driver; scoring is one map over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import documents, flat, slices, tidy
from .words import word_hashes

#: Labelled rows that a model is fitted on at most: those of least hash, however many there are.
TRAIN_ROWS = 20_000
WORD_BITS, BINS, FACTORS, EPOCHS, BATCH, RATE, DECAY = 15, 12, 8, 12, 256, 0.05, 1e-5
THRESHOLD = 0.3
#: Byte classes that are counted, as shares of all bytes.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"!", b"|", b"#$%&*@^~<>{}[]\\/=+_", b".,;:?'\"()-", b"\n", b" \t\r\x0b\x0c", bytes(range(128, 256))]
STATS = len(CLASSES) + 5


def features(text: pa.Array, metadata: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hashed word, weight) of each distinct word of each text, and the rows' statistics with the metadata behind them."""
    raw, at = flat(text)
    n, size = len(at) - 1, np.diff(at).astype(float)
    stats = np.zeros((n, STATS + len(metadata)))
    for j, members in enumerate(CLASSES):
        belongs = np.zeros(256, np.int64)
        belongs[list(members)] = 1
        sums = np.append(0, np.cumsum(belongs[raw]))
        stats[:, j] = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(size, 1)
    words, bounds = word_hashes(raw, at)
    count = np.diff(bounds)
    row = np.repeat(np.arange(n), count)
    cells, times = np.unique((row.astype(np.uint64) << np.uint64(WORD_BITS)) | (words >> np.uint64(64 - WORD_BITS)), return_counts=True)
    of, bucket = (cells >> np.uint64(WORD_BITS)).astype(np.int64), (cells & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    again = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    many = np.maximum(count, 1)
    j = len(CLASSES)
    stats[:, j] = np.log1p(size)
    stats[:, j + 1] = size / many
    stats[:, j + 2] = np.bincount(of, minlength=n) / many
    stats[:, j + 3] = np.bincount(row[1:][again], minlength=n) / many
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    stats[:, j + 4] = most / many
    for k, column in enumerate(metadata):
        stats[:, STATS + k] = np.log1p(np.maximum(0, np.nan_to_num(np.asarray(column.cast(pa.float64()).fill_null(0)))))
    weight = 1 + np.log(times)
    length = np.sqrt(np.bincount(of, weight**2, minlength=n))
    return of, bucket, weight / length[of], stats


@dataclass
class Machine:
    """w0, w and v over words first, then a block of bins for each statistic."""

    edges: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def columns(self, stats: np.ndarray) -> np.ndarray:
        """The feature of each row's bin of each statistic."""
        bins = np.stack([np.searchsorted(e, s, side="left") for e, s in zip(self.edges, stats.T, strict=True)], axis=1)
        return (1 << WORD_BITS) + np.arange(stats.shape[1]) * BINS + bins

    def rows(self, of: np.ndarray, bucket: np.ndarray, weight: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features as (row, feature, value)."""
        n, s = stats.shape
        return np.concatenate([of, np.repeat(np.arange(n), s)]), np.concatenate([bucket, self.columns(stats).ravel()]), np.concatenate([weight, np.full(n * s, s**-0.5)])

    def raw(self, n: int, of: np.ndarray, feature: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum before the logistic function, and the factors' sums for the gradient."""
        linear = np.bincount(of, self.w[feature] * x, minlength=n)
        sums = np.empty((n, self.v.shape[1]))
        squares = np.zeros(n)
        for f in range(self.v.shape[1]):
            vx = self.v[feature, f] * x
            sums[:, f] = np.bincount(of, vx, minlength=n)
            squares += np.bincount(of, vx * vx, minlength=n)
        return self.w0 + linear + 0.5 * ((sums**2).sum(1) - squares), sums

    def scores(self, text: pa.Array, metadata: list[pa.Array]) -> np.ndarray:
        of, bucket, weight, stats = features(text, metadata)
        z = self.raw(len(stats), *self.rows(of, bucket, weight, stats))[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(parts: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray, label: np.ndarray, seed: int = 5) -> Machine:
    """Fit on rows given as (hashed words, weights) and statistics. Without both labels the score is constant."""
    n, s = stats.shape
    size = (1 << WORD_BITS) + s * BINS
    rng = np.random.Generator(np.random.PCG64(seed))
    edges = np.stack([np.quantile(stats[:, j], np.arange(1, BINS) / BINS) if n else np.zeros(BINS - 1) for j in range(s)])
    share = (label.sum() + 0.5) / (n + 1)
    m = Machine(edges, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    if n == 0 or label.min() == label.max():
        m.v[:] = 0
        return m
    g_w, g_v, g_0 = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    columns = m.columns(stats)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            rows = order[i : i + BATCH]
            counts = np.array([len(parts[r][0]) for r in rows])
            k = len(rows)
            of = np.concatenate([np.repeat(np.arange(k), counts), np.repeat(np.arange(k), s)])
            feature = np.concatenate([*(parts[r][0] for r in rows), columns[rows].ravel()])
            x = np.concatenate([*(parts[r][1] for r in rows), np.full(k * s, s**-0.5)])
            z, sums = m.raw(k, of, feature, x)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[rows]) / k
            met, at = np.unique(feature, return_inverse=True)
            step = np.bincount(at, error[of] * x) + DECAY * m.w[met]
            g_w[met] += step**2
            m.w[met] -= RATE * 4 * step / np.sqrt(g_w[met])
            for f in range(FACTORS):
                v = m.v[feature, f]
                step = np.bincount(at, error[of] * x * (sums[of, f] - v * x)) + DECAY * m.v[met, f]
                g_v[met, f] += step**2
                m.v[met, f] -= RATE * step / np.sqrt(g_v[met, f])
            g_0 += error.sum() ** 2
            m.w0 -= RATE * error.sum() / np.sqrt(g_0)
    return m


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model learns from; a null doc_id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: tuple[str, ...] = ("n_chars",), most: int = TRAIN_ROWS) -> Machine:
    """Fit on labelled documents that are not held out, at most ``most`` of them, those of least hash of doc_id.

    Repeated labels of a doc_id count as the largest, repeated documents as often as they stand; null labels, doc_ids
    and documents without a label are left out. A row's features are no more than the hashed words there are.
    """
    key = F.xxhash64(F.col("doc_id").cast("string"))
    sample = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    sample = sample.orderBy(key, "doc_id").limit(most)  # at most 16 bytes a row
    chosen = docs.select("doc_id", "text", *metadata).join(F.broadcast(sample), "doc_id")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                of, bucket, weight, stats = features(part.column(1), [part.column(2 + k) for k in range(len(metadata))])
                at = np.append(0, np.cumsum(np.bincount(of, minlength=part.num_rows)))
                cut = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                columns = [part.column(0), pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in cut]), pa.array([weight[a:b].astype(np.float32).tobytes() for a, b in cut]), pa.array([x.tobytes() for x in stats]), part.column(2 + len(metadata))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "words", "weights", "stats", "label"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        parts = [(np.frombuffer(w, np.int32).astype(np.int64), np.frombuffer(x, np.float32).astype(float)) for _, w, x, _, _ in rows]
        stats = np.array([np.frombuffer(x, float) for _, _, _, x, _ in rows]).reshape(len(rows), STATS + len(metadata))
        m = fit(parts, stats, np.array([float(r[4] > 0) for r in rows]))
        yield pa.RecordBatch.from_arrays([pa.array([m.w0]), *(pa.array([np.ascontiguousarray(x, float).tobytes()], pa.binary()) for x in (m.edges, m.w, m.v))], names=["w0", "edges", "w", "v"])

    rows = chosen.mapInArrow(tidy(featured), "doc_id long, words binary, weights binary, stats binary, label int")
    got = rows.repartition(1).mapInArrow(tidy(fitted), "w0 double, edges binary, w binary, v binary").first()
    if got is None:  # no row at all starts no task
        return fit([], np.empty((0, STATS + len(metadata))), np.empty(0))
    edges, w, v = (np.frombuffer(got[c], float) for c in ("edges", "w", "v"))
    return Machine(edges.reshape(-1, BINS - 1), got["w0"], w, v.reshape(-1, FACTORS))


def score(docs: DataFrame, machine: Machine, metadata: tuple[str, ...] = ("n_chars",), column: str = "score") -> DataFrame:
    """The rows of ``docs`` with a score from 0 to 1.

    Null texts count as empty, null metadata as 0; no row is lost or merged; texts of any length are read whole; a column
    called like the new one is replaced, other columns stay.
    """
    docs = docs.drop(column)
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                of = {name: i for i, name in enumerate(part.schema.names)}
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.value.scores(part.column(of["text"]), [part.column(of[m]) for m in metadata]))], names=[*part.schema.names, column])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema, StructField(column, DoubleType())]))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score by a model of the labelled rows that are not held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    done = score(docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
    return done.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
