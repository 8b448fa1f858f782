"""Alignment of two tokenizers' tokens over the same bytes (operator 12)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, small_batches, texts_of
from .packing import Encoder, tokenizer_path

BYTES_FILE, PIECES_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links of a chunk of documents; bytes after which a worker forgets its words, at the end of a chunk; bytes of an entry besides what it holds.
LINKS, CACHE, ENTRY = 1_000_000, 96 << 20, 400
TEXTS = 64


class Overlaps(NamedTuple):
    """Elementary intervals of two partitions of the same bytes: each is the overlap of one token of either side."""

    ends: np.ndarray
    owner_a: np.ndarray
    owner_b: np.ndarray
    shared: np.ndarray  # the interval's end is an end of both sides, so a group ends there


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> Overlaps:
    ends = np.union1d(a_end, b_end)
    ends = ends[ends > 0]
    a, b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    return Overlaps(ends, a, b, (a_end[a] == ends) & (b_end[b] == ends))


def products(a_end: np.ndarray, b_end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of a, token of b, number of the end) of all pairs of tokens that end at each of the ends ``at``: the product of
    the tokens of either side there, of which there are several only if tokens are empty."""
    low_a, low_b = np.searchsorted(a_end, at), np.searchsorted(b_end, at)
    n_a, n_b = np.searchsorted(a_end, at, "right") - low_a, np.searchsorted(b_end, at, "right") - low_b
    n = n_a * n_b
    of = np.repeat(np.arange(len(at)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return low_a[of] + k // n_b[of], low_b[of] + k % n_b[of], of


class Known(NamedTuple):
    """What is kept of a word, or of a whole text: counts, groups as text (each with ``;`` behind), and links by number."""

    n_a: int
    n_b: int
    n_groups: int
    groups: bytes
    links: bytes


NONE = Known(0, 0, 0, b"", b"")


class Aligner:
    """Aligns texts by the tokens of a byte-level BPE file (A, over a space and the text) and of a piece model (B, which adds the space).

    Neither tokenizer merges across a single space between two words, so both have an end there: words are aligned once,
    with the space before them, many at a time, and kept; a text's groups are those of its words. Texts with other
    white space around a space are aligned whole. A word, or text, whose tokens don't give back its bytes is bad.
    """

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece

        encoder = Encoder(bytes_path)
        self.a, self.a_bytes = encoder.whole, encoder.tokens()
        model = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.b = lambda texts: model.encode(texts, num_threads=1)
        pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.apart = not any(p.lstrip("▁").find("▁") >= 0 for p in pieces)
        self.a_len, self.b_len = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        digits = len(str(max(len(self.a_bytes), len(self.b_bytes))))
        numbers = np.array([str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))], f"S{digits}").view(np.uint8).reshape(-1, digits)
        self.signs = np.concatenate([np.concatenate([numbers, np.full((len(numbers), 1), ord(c), np.uint8)], axis=1) for c in ",|;"])
        self.n = len(numbers)
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, Known | None] = {}
        self.pairs: dict[int, int] = {}
        self.held = 0

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """(ids of A, ids of B) of each text; None if either's bytes aren't a space and the text."""
        out: list[tuple[list[int], list[int]] | None] = []
        for t, b in zip(texts, self.b(texts)):
            raw, a = b" " + t.encode("utf-8", "surrogatepass"), self.a(" " + t)
            good = b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw
            out.append((a, b) if good else None)
        return out

    def align(self, texts: list[str]) -> list[Known | None]:
        """What is kept of each text. All are aligned as one, in which each text's end is one of both sides."""
        both = self.tokens(texts)
        good = [x for x in both if x]
        if not good:
            return [None] * len(texts)
        n_a, n_b = (np.array([len(x[i]) for x in good]) for i in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(x[i] for x in good), np.int64) for i in (0, 1))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        own_end = a_end[np.cumsum(n_a) - 1]
        o = overlaps(a_end, b_end)
        ends = o.ends[o.shared]
        groups = np.searchsorted(ends, own_end, "right")
        # A's tokens of a group, then B's
        of = np.concatenate([2 * np.searchsorted(ends, a_end), 2 * np.searchsorted(ends, b_end) + 1])
        order = np.argsort(of, kind="stable")
        side, last = of[order] % 2, np.append(np.diff(of[order]) != 0, True)
        signs = self.signs[np.concatenate([a, b])[order] + self.n * np.where(last, 1 + side, 0)]
        filled = signs != 0
        text = signs[filled].tobytes()
        text_end = np.cumsum(filled.sum(axis=1))[np.cumsum(n_a + n_b) - 1]
        i, j, end = products(a_end, b_end, ends)
        keys, which = np.unique(a[i] << 32 | b[j], return_inverse=True)
        numbers = np.array([self.pairs.setdefault(k, len(self.pairs)) for k in keys.tolist()], np.uint32)
        links = numbers[which].tobytes()
        link_end = 4 * np.searchsorted(end, groups)
        rows = zip(n_a.tolist(), n_b.tolist(), np.diff(groups, prepend=0).tolist(), chain([0], text_end.tolist()), text_end.tolist(), chain([0], link_end.tolist()), link_end.tolist())
        done = (Known(x, y, g, text[t0:t1], links[l0:l1]) for x, y, g, t0, t1, l0, l1 in rows)
        return [next(done) if x else None for x in both]

    def __call__(self, texts: list[str]) -> list[Known]:
        """Of each text; those without tokens, or with bad ones, have none."""
        split = [t.split(" ") if t and self.apart else [] for t in texts]
        new = {w for x in split for w in x if w not in self.words}
        whole = {w for w in new if not w or w[0].isspace() or w[-1].isspace()}
        if new := list(new - whole):
            for w, k in zip(new, self.align(new)):
                self.words[w] = k
                self.held += ENTRY + len(w) + (len(k.groups) + len(k.links) if k else 0)
        out = []
        for t, x in zip(texts, split):
            if not t:
                out.append(NONE)
            elif not x or whole and not whole.isdisjoint(x):
                out.append(self.align([t])[0] or NONE)
            elif None in (found := list(map(self.words.__getitem__, x))):
                out.append(NONE)
            else:
                n_a, n_b, n, groups, links = zip(*found)
                out.append(Known(sum(n_a), sum(n_b), sum(n), b"".join(groups), b"".join(links)))
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(*paths: str) -> Aligner:
    """A worker's aligner: its words serve the tasks that follow, too."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def groups(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """The documents with ``groups``, in order: ids of A, ids of B, and the bytes of a space and the text that they cover, from ``start`` up to ``end``."""
    names = [f"_k{i}" for i in range(len(docs.columns))]
    src = docs.toDF(*names).withColumn("_text", F.col(names[docs.columns.index("text")]))
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(bytes_path, pieces_path)
        for b in batches:
            found = []
            for t in texts_of(b.column(b.num_columns - 1)):
                both = aligner.tokens([t])[0] if t else None
                row, at = [], 0
                if both:
                    a_end, b_end = (np.cumsum(n[x]) for n, x in zip((aligner.a_len, aligner.b_len), both))
                    o = overlaps(a_end, b_end)
                    i = j = 0
                    for end in o.ends[o.shared].tolist():
                        k, l = (int(np.searchsorted(x, end, "right")) for x in (a_end, b_end))
                        row.append({"a": both[0][i:k], "b": both[1][j:l], "start": at, "end": end})
                        i, j, at = k, l, end
                found.append(row)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=[*b.schema.names[:-1], "groups"])

    fields = T.StructType(src.schema.fields[:-1] + T.StructType.fromDDL("groups array<struct<a:array<int>,b:array<int>,start:long,end:long>>").fields)
    return src.mapInArrow(run, fields).toDF(*docs.columns, "groups")


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str, keep: list[str], links_of_chunk: int = LINKS) -> DataFrame:
    """The kept columns with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Texts are tokenized once. A chunk of consecutive documents has a row for each of its pairs of ids, with their number,
    so what is shuffled for the corpus-wide counts doesn't grow with the links but with the distinct pairs of chunks; a
    document's links stand as numbers of its chunk's pairs, and meet their counts again by chunk. No task holds more
    than a chunk, and no table of pairs is broadcast or collected. Null and empty texts, and those whose tokens don't
    give back a space and the text, have zeros and an empty hash. Rows are treated apart: repeated ones have equal
    results and count each; null ids stay null. No documents: no rows. Other columns have no effect.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    src = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col("text").alias("_text"))
    more = T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, chunk long, number int, a int, b int, n long")
    schema = T.StructType(src.schema.fields[:-1] + more.fields)
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        align, part, chunk, links, seen, kept = _aligner(bytes_path, pieces_path), TaskContext.get().partitionId(), 0, [], 0, None

        def record(given: list, values: list[list], size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*given, *(pa.nulls(size, k) if v is None else pa.array(v, k) for v, k in zip(values, kinds))], names=schema.names)

        def pairs() -> pa.RecordBatch:
            n = np.bincount(np.frombuffer(b"".join(links), np.uint32), minlength=len(align.pairs))
            at = np.flatnonzero(n)
            keys = np.fromiter(align.pairs, np.int64, len(align.pairs))[at]
            return record([pa.nulls(len(at), k) for k in kept], [None] * 6 + [np.full(len(at), (part << 32) + chunk), at.astype(np.int32), (keys >> 32).astype(np.int32), (keys & 0xFFFFFFFF).astype(np.int32), n[at]], len(at))

        for b in batches:
            kept = [c.type for c in b.columns[:-1]]
            for at in range(0, b.num_rows, TEXTS):
                some = b.slice(at, TEXTS)
                found = align([t or "" for t in some.column(some.num_columns - 1).to_pylist()])
                sha = [hashlib.sha256(k.groups[:-1]).hexdigest() if k.n_a else "" for k in found]
                packed = [pa.compress(k.links, "zstd", asbytes=True) if k.links else b"" for k in found]
                yield record(some.columns[:-1], [[k.n_a for k in found], [k.n_b for k in found], [k.n_groups for k in found], [len(k.links) // 4 for k in found], sha, packed, [(part << 32) + chunk] * len(found), None, None, None, None], len(found))
                links += [k.links for k in found]
                seen += sum(len(k.links) for k in found) // 4
                if seen >= links_of_chunk:
                    yield pairs()
                    chunk, links, seen = chunk + 1, [], 0
                    if align.held > CACHE:
                        align.forget()
        if seen:
            yield pairs()

    rows = cut(src.mapInArrow(run, schema))
    pairs = rows.where("number IS NOT NULL").select("chunk", "number", "a", "b", "n")
    counts = cut(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")))
    stat = counts.join(counts.groupBy("b").agg(F.max("count").alias("most")).hint("merge"), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))
    told = pairs.join(stat.hint("merge"), ["a", "b"]).select(F.col("chunk").alias("of"), "number", "count", "best")
    out = T.StructType(src.schema.fields[:-1] + T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right["number"].to_numpy()
        count, best = (np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64) for _ in range(2))
        count[number], best[number] = right["count"].to_numpy(), right["best"].to_numpy()
        n_best, total = [], []
        for n, held in zip(left["n_links"].to_pylist(), left["links"].to_pylist()):
            i = np.frombuffer(pa.decompress(held, 4 * n, "zstd", asbytes=True) if n else b"", np.uint32)
            n_best.append(int(best[i].sum())), total.append(int(count[i].sum()))
        cols = {c: left[c] for c in [*names, *_COUNTS]} | {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": left["groups_sha256"]}
        return pa.table({f.name: cols[f.name] for f in out.fields})

    docs_ = rows.where("number IS NULL").select("chunk", *names, *_COUNTS, "groups_sha256", "links")
    return docs_.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(add, out).toDF(*keep, *out.names[len(keep) :])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return aligned(documents(spark, sf_dir), tokenizer_path(BYTES_FILE), tokenizer_path(PIECES_FILE), ["doc_id"])
