"""Word shingles as 64-bit hashes, and exact Jaccard verification of candidate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sieved, texts_of

SIZE = 5
#: Bytes of words whose hashes a worker keeps before it starts anew, and those that an entry takes besides.
CACHE, ENTRY = 16 << 20, 180
_P, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    held = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word)
        self.held += len(word) + ENTRY
        return out


class Shingler:
    """Distinct hashes of a text's word shingles, sorted. A-Z is lower-cased; words are ``[^\\x20\\x09-\\x0D]+``.

    With fewer words than a shingle, the whole sequence is one; without words there are none. 64-bit hashes stand for
    the shingles: that two differing shingles of a pair of documents collide has odds of about 1e-13.
    """

    def __init__(self, size: int = SIZE):
        self.size, self.known = size, _Hashes()

    def all(self, text: str) -> np.ndarray:
        w = text.encode("utf-8", "surrogatepass").lower().split()
        if not w:
            return np.empty(0, np.uint64)
        if self.known.held > CACHE:
            self.known = _Hashes()
        h = np.fromiter(map(self.known.__getitem__, w), np.uint64, len(w))
        size = min(self.size, len(w))
        n = len(h) - size + 1
        out = h[:n] + np.uint64(size)
        for k in range(1, size):
            out = out * _P + h[k : n + k]
        out ^= out >> np.uint64(32)
        out *= _M
        return out ^ (out >> np.uint64(29))

    def __call__(self, text: str) -> np.ndarray:
        return np.unique(self.all(text))


def set_id(s: np.ndarray) -> int:
    """A 64-bit name of a shingle set; sets of different texts of a corpus share one with odds of (texts squared) / 2^64."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def sets_of(docs: DataFrame, wanted: DataFrame, size: int = SIZE) -> DataFrame:
    """(cls, tokens) for the classes in ``wanted`` (cls, th): th is xxhash64 of the text of one document of the class.

    Texts aren't shuffled: those that a sieve over th lets pass are shingled where they are, and their sets meet the
    wanted classes."""
    wanted = cut(wanted)
    texts = sieved(docs.select(F.xxhash64("text").alias("th"), "text"), F.col("th"), wanted.select("th")).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for b in batches:
            sets = [shingle(t) for t in texts_of(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(map(set_id, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cls", "tokens"])

    return texts.mapInArrow(run, "cls long, tokens binary").join(wanted.select("cls").distinct().hint("merge"), "cls", "left_semi").groupBy("cls").agg(F.first("tokens").alias("tokens"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b, ...) of pairs of classes whose sets have 100 * intersection >= percent * union."""
    sets, names = cut(sets), pairs.columns
    p = pairs.join(sets.select(F.col("cls").alias("a"), F.col("tokens").alias("s")), "a").join(sets.select(F.col("cls").alias("b"), F.col("tokens").alias("t")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for s, t in zip(b.column(0), b.column(1)):
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                both = np.concatenate((s, t))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared) and shared > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(keep) for i in range(2, b.num_columns)], names=names)

    return p.select("s", "t", *names).mapInArrow(run, pairs.schema)


def against(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (cls, hub) with linked, shared (size of the intersection), n, and extra: the tokens of cls that hub lacks, if they are at most half."""
    sets = cut(sets)
    p = pairs.select("cls", "hub").join(sets.select("cls", F.col("tokens").alias("s")), "cls").join(sets.select(F.col("cls").alias("hub"), F.col("tokens").alias("t")), "hub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked, shared, size, extra = [], [], [], []
            for s, t in zip(b.column(2), b.column(3)):
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                own = np.setdiff1d(s, t, assume_unique=True)
                both = len(s) - len(own)
                linked.append(100 * both >= percent * (len(t) + len(own)) and both > 0), shared.append(both), size.append(len(s))
                extra.append(own.view(np.int64) if 2 * both >= len(s) else None)
            cols = [pa.array(linked, pa.bool_()), pa.array(shared, pa.int32()), pa.array(size, pa.int32()), pa.array(extra, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["cls", "hub", "linked", "shared", "n", "extra"])

    return p.select("cls", "hub", "s", "t").mapInArrow(run, "cls long, hub long, linked boolean, shared int, n int, extra array<long>")
