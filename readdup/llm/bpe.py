"""Byte-pair encoding and decoding of whole texts in batched numpy merge rounds.

Texts are normalised and split into units (pretok.py). The symbols of all units that a worker has not met yet stand in
one flat array. In each round every neighbouring pair's rank is found by binary search over the vocabulary's sorted
pair keys, the lowest-rank pair of each unit is merged at all its places (left to right where they overlap), and units
without a ranked pair leave the array. Each distinct unit is merged once per worker; texts are gathers over units.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, slices, table, tidy
from .pretok import Ragged, Units, split

#: Distinct units that a worker remembers before it starts anew.
REMEMBERED = 1_000_000
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in shown else next(free)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary with word ends (``word_bpe``) in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.names = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for name, i in (ids | self.special).items():
            self.names[i] = name
        self.size = len(self.names)
        pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]], np.int64).reshape(-1, 3)
        keys, order = pairs[:, 0] * self.size + pairs[:, 1], np.arange(len(pairs))
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[by_key], order[by_key]
        self.merged = pairs[:, 2]
        shown = byte_symbols()
        self.inner = np.array([ids[c] for c in shown], np.int64)
        self.last = np.array([ids[c + self.suffix] for c in shown], np.int64)
        self.split_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")

    def merge(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after another, and each unit's number of ids."""
        lengths = np.array([len(u) for u in units], np.int64)
        raw = np.frombuffer(b"".join(units), np.uint8)
        sym, unit = self.inner[raw], np.repeat(np.arange(len(units)), lengths)
        ends = np.cumsum(lengths) - 1
        sym[ends] = self.last[raw[ends]]
        none = len(self.merged)
        done_sym, done_unit = [], []
        while len(sym):
            # rank of the pair that starts at each symbol; none at a unit's last
            pair = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.full(len(sym), none)
            rank[:-1] = np.where((self.keys[at] == pair) & (unit[1:] == unit[:-1]), self.ranks[at], none)
            first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            counts = np.diff(np.append(first, len(unit)))
            best = np.repeat(np.minimum.reduceat(rank, first), counts)
            alive = best < none
            if not alive.all():
                done_sym.append(sym[~alive])
                done_unit.append(unit[~alive])
                sym, unit, rank, best = sym[alive], unit[alive], rank[alive], best[alive]
                if not len(sym):
                    break
            hit = rank == best
            # of pairs that overlap (the same symbol again and again) every second one counts, from the left
            places = np.flatnonzero(hit)
            chain = np.append(True, np.diff(places) != 1)
            nth = np.arange(len(places)) - np.repeat(np.flatnonzero(chain), np.diff(np.append(np.flatnonzero(chain), len(places))))
            places = places[nth % 2 == 0]
            sym[places] = self.merged[rank[places]]
            keep = np.ones(len(sym), bool)
            keep[places + 1] = False
            sym, unit = sym[keep], unit[keep]
        sym, unit = np.concatenate([*done_sym, np.empty(0, np.int64)]), np.concatenate([*done_unit, np.empty(0, np.int64)])
        return sym[np.argsort(unit, kind="stable")], np.bincount(unit, minlength=len(units))


class Codec:
    """Encodes texts as the tokenizers library does without special tokens of its own, and decodes ids as it does."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.units = Units(self.make, self.clear, REMEMBERED)

    def clear(self) -> None:
        self.ids = Ragged(np.uint32)
        self.n_ids = np.empty(0, np.int64)
        self.shown: list[bytes] = []
        self.read: list[bytes] = []

    def make(self, words: list[str]) -> None:
        for i in range(0, len(words), 1 << 16):
            self.ids.append(*self.vocabulary.merge([w.encode() for w in words[i : i + (1 << 16)]]))

    def show(self) -> None:
        """What digests join of the units that are new since the last call; who wants ids alone makes none of it."""
        flat, at = self.ids.rows(np.arange(len(self.shown), self.ids.n))
        ids, at, names = flat.tolist(), at.tolist(), self.vocabulary.names
        for a, b in zip(at[:-1], at[1:], strict=True):
            self.shown.append(b" ".join([b"%d" % x for x in ids[a:b]]))
            self.read.append(" ".join([names[x] for x in ids[a:b]]).encode())

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character's own lower case (so a capital sigma has one form everywhere)."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def pieces(self, texts: list[str]) -> tuple[list[str], list[list[int]] | None]:
        """What lies between the strings of special tokens; for texts that hold some, the ids after each piece."""
        found = [self.vocabulary.split_special.findall(t) if "<|" in t else [] for t in texts]
        if not any(found):
            return [self.normal(t) for t in texts], None
        pieces, marks = [], []
        for t, specials in zip(texts, found, strict=True):
            parts = self.vocabulary.split_special.split(t) if specials else [t]
            pieces += [self.normal(p) for p in parts]
            marks.append([*(self.vocabulary.special[s] for s in specials), -1])
        return pieces, marks

    def units_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]] | None]:
        pieces, marks = self.pieces(texts)
        text, starts, ends, bounds, hashes = split(pieces, bare=True)
        return self.units.find(text, starts, ends, hashes), bounds, marks

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        which, bounds, marks = self.units_of(texts)
        flat, at = self.ids.rows(which)
        at = at[bounds].tolist()
        if marks is None:
            return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        out, k = [], 0
        for own in marks:
            parts = []
            for m in own:
                parts += [flat[at[k] : at[k + 1]], np.array([m] if m >= 0 else [], np.uint32)]
                k += 1
            out.append(np.concatenate(parts))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The vocabulary's strings of all ids, special ones too, joined by a space."""
        names = self.vocabulary.names
        return " ".join([names[i] for i in ids.tolist()])

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, and SHA-256 of the decimal ids and of the decoded text, without making them one by one."""
        which, bounds, marks = self.units_of(texts)
        if marks is not None:
            out = self.encode(texts)
            return [len(x) for x in out], [hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in out], [hashlib.sha256(self.decode(x).encode()).hexdigest() for x in out]
        self.show()
        counts = np.zeros(len(which) + 1, np.int64)
        np.cumsum(self.ids.at[which + 1] - self.ids.at[which], out=counts[1:])
        n = np.diff(counts[bounds]).tolist()
        shown, read, w, b = self.shown, self.read, which.tolist(), bounds.tolist()
        ids = [hashlib.sha256(b" ".join([shown[x] for x in w[i:j]])).hexdigest() for i, j in zip(b[:-1], b[1:], strict=True)]
        back = [hashlib.sha256(b" ".join([read[x] for x in w[i:j]])).hexdigest() for i, j in zip(b[:-1], b[1:], strict=True)]
        return n, ids, back


@cache
def codec(path: str) -> Codec:
    """One per worker process, so that tasks share what is known of units."""
    return Codec(path)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) of each document (doc_id, text); null texts are empty and have no ids. Rows keep their number and doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for part in slices(batch):
                yield table(_IDS, doc_id=part.column(0), ids=[x.astype(np.int32) for x in own.encode([t or "" for t in part.column(1).to_pylist()])])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document; cases as in encode_documents()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            for part in slices(batch):
                n, ids, back = own.digests([t or "" for t in part.column(1).to_pylist()])
                yield table(_DIGEST, doc_id=part.column(0), n_tokens=n, ids_sha256=ids, decoded_sha256=back)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoded text, as digests."""
    import public_tokenizers

    return digest_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
