"""MinHash fingerprints, and near duplicates by banded signatures (operator 2)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORDS, components, cut, documents, linked_in_bands, partitions, ranked_in_bands, small_batches, texts_of
from .shingles import SIZE, Shingler, set_id, sets_of, verified

#: Permutations, rows of a band, and the likeness from which documents are near duplicates.
PERMUTATIONS, ROWS, PERCENT, SEED = 64, 4, 75, 20240
#: Shingles hashed at a time, by all permutations at once: so few that their values stay in a core's cache.
BLOCK = 256


class MinHasher:
    """Signatures of PERMUTATIONS values: for each the least of a universal hash of the text's word shingles.

    Hash j of x is the upper half of a_j * x + b_j modulo 2^64, a_j odd (multiply-shift, 2-universal). A text without
    words has the signature of no shingle, equal for all such texts and unlike any other.
    """

    def __init__(self, permutations: int = PERMUTATIONS, seed: int = SEED, size: int = SIZE):
        rng = np.random.default_rng(seed)
        draw = lambda: np.frombuffer(rng.bytes(8 * permutations), "<u8").astype(np.uint64)
        self.a, self.b, self.shingle = draw() | np.uint64(1), draw(), Shingler(size)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), BLOCK):
            h = shingles[i : i + BLOCK, None] * self.a
            h += self.b
            np.minimum(least, h.min(axis=0), out=least)
        return (least >> np.uint64(32)).astype(np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        return self.of(self.shingle.all(text))


def likeness(s: np.ndarray, t: np.ndarray) -> float:
    """Share of equal values: an estimate of the Jaccard likeness of the shingle sets."""
    return float((s == t).mean())


def neighbours(docs: DataFrame, n: int) -> DataFrame:
    """Documents dealt by descending doc_id into ``n`` ranges, each sorted and closed by the document that follows it.

    Adds _last: true for that closing copy. Ranges begin at doc_ids that exist, so that a range's follower is known
    without looking at the other: it is the document at which the next range begins (after the last, the very first).
    Order: doc_id descending, null last, then text.
    """
    id_ = F.col("doc_id").cast("long")
    near = docs.select(F.percentile_approx(id_, F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5)), 10_000).alias("at")).first()["at"]
    near = np.array(sorted({*(near or [])}) if n > 1 else [], np.int64)

    @F.pandas_udf("int")
    def about(known: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(near, known.to_numpy(np.int64), side="right").astype(np.int32))

    # quantiles pass through doubles; the greatest id of each range is one that exists
    tops = sorted(r["top"] for r in docs.where("doc_id IS NOT NULL").groupBy(about(id_)).agg(F.max(id_).alias("top")).collect())
    top = tops.pop() if tops else None
    at = np.array(tops, np.int64)
    ranges = len(at) + 1

    @F.pandas_udf("array<int>")
    def dealt(known: pd.Series, none: pd.Series) -> pd.Series:
        # pandas would make a column of longs with nulls one of doubles: nulls come as a column of their own
        v, null = known.to_numpy(np.int64), none.to_numpy(bool)
        # ranges go from the greatest ids down; a boundary opens the range below the greater ids
        own = np.where(null, ranges - 1, len(at) - np.searchsorted(at, v, side="left"))
        opens = np.isin(v, at) & ~null
        first = (v == top) & ~null if top is not None else np.zeros(len(v), bool)
        return pd.Series([[int(o)] + ([-int(o)] if p else []) + ([-ranges] if f else []) for o, p, f in zip(own, opens, first)])

    # k: row of range k; -k: closing copy for range k - 1
    d = docs.withColumn("_k", F.explode(dealt(F.coalesce(id_, F.lit(0).cast("long")), id_.isNull())))
    # range 0 has no negative of its own: its opening document closes the last range, as -ranges
    d = d.withColumn("_last", F.col("_k") < 0).withColumn("_range", F.when(F.col("_k") < 0, -F.col("_k") - 1).otherwise(F.col("_k")).cast("int"))
    return d.repartitionById(ranges, F.col("_range")).sortWithinPartitions("_range", "_last", F.desc_nulls_last("doc_id"), F.asc_nulls_first("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by the first as many of the next
    document by descending doc_id (null ids last, equal ids by text; after the last comes the first). Null text counts
    as empty; a single document is its own next. Repeated rows follow one another and are rows of their own. Other
    columns have no effect. Texts are shuffled once.
    """
    src = neighbours(docs.select("doc_id", "text"), partitions(docs.sparkSession)).select("doc_id", "text", "_last", "_range")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash, of_range, first, before = MinHasher(), None, None, None

        def line(own, follower) -> tuple:
            (doc_id, text, sig), (_, other, other_sig) = own, follower
            n = len(text)
            edited = text[: n - n // 3] + other[: n // 3]
            edited_sig = minhash(edited) if edited != text else sig
            digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            return doc_id, n, digest, sig.astype(">u4").tobytes().hex(), edited_sig.astype(">u4").tobytes().hex(), likeness(sig, edited_sig), likeness(sig, other_sig)

        def batch(rows: list) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            cols = zip(*rows) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=names)

        closed = False
        for b in batches:
            rows = []
            for doc_id, text, last, at in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if at != of_range:
                    if before is not None and not closed:
                        rows.append(line(before, first))
                    of_range, first, before, closed = at, None, None, False
                if closed:
                    continue
                now = (doc_id, text, before[2] if before is not None and before[1] == text else minhash(text))
                if before is not None:
                    rows.append(line(before, now))
                first, before, closed = first or now, now, last
            yield batch(rows)
        if before is not None and not closed:
            yield batch([line(before, first)])

    return src.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """doc_id, component_id: documents tied by verified pairs of near duplicates; component_id is the least doc_id.

    Signatures are cut into bands of ``rows`` values. Classes of equal shingle sets that share a band are ranked by their
    number of documents, and ``linked_in_bands`` connects every two of them whose exact Jaccard likeness is verified,
    without listing a band's pairs. Documents without words are duplicates of nothing; null ids don't name a component.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHasher()
        for b in batches:
            ids, bands = [], []
            for t in texts_of(b.column(2)):
                s = minhash.shingle(t)
                ids.append(set_id(s))
                parts = minhash.of(s).reshape(-1, rows) if len(s) else ()
                bands.append([xxhash.xxh3_64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(parts)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["th", "doc_id", "cls", "bands"])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sizes and parity bits of sets, as ``parity`` makes them of rows."""
        for b in batches:
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(1)]
            odd = [np.packbits(np.bincount((x & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1, bitorder="little").view("<i8") for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, sets), pa.int64()), *(pa.array([int(x[i]) for x in odd], pa.int64()) for i in range(WORDS))], names=["node", "size", *(f"w{i}" for i in range(WORDS))])

    d = cut(docs.select(F.xxhash64("text").alias("th"), "doc_id", "text").mapInArrow(run, f"th long, doc_id {kind}, cls long, bands array<long>"))
    named = d.where(F.size("bands") > 0).groupBy("cls").agg(F.min("th").alias("th"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("bands").alias("bands"))
    ranked = ranked_in_bands(named.select(F.col("cls").alias("node"), "n", F.explode("bands").alias("band")))
    sets = lambda nodes: sets_of(docs, named.join(nodes.withColumnRenamed("node", "cls").hint("merge"), "cls").select("cls", "th"))
    marks = lambda nodes: sets(nodes).mapInArrow(marked, "node long, size long, " + ", ".join(f"w{i} long" for i in range(WORDS)))
    check = lambda pairs: verified(pairs, sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), percent)
    found = cut(components(linked_in_bands(ranked, marks, check, percent)))
    per = named.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("component", "cls").alias("component"))
    least = per.join(per.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("cls", "component_id")
    out = d.select("doc_id", F.when(F.size("bands") > 0, F.col("cls")).alias("cls")).join(least, "cls", "left")
    return out.select("doc_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands of the fingerprints joined and verified, over all documents."""
    small_batches(spark)
    return near_duplicates(documents(spark, sf_dir))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fingerprints(documents(spark, sf_dir))
