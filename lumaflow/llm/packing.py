"""Best-fit-decreasing packing of token sequences (operator 7)."""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, prefix_sums, small_batches, texts_of

CAPACITY = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
#: Bytes after which a worker's cache of encoded words starts anew, and those that one entry takes besides its text.
CACHE, ENTRY = 16 << 20, 200
#: Unicode white space in runs too long for a pattern with a look-ahead: its engine's stack grows with the run.
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids of a text as the byte-level BPE file of ``tokenizers`` gives them, as little-endian 32-bit bytes.

    Where a text holds an added token of the file, that is its id, and what stands between is encoded by itself.
    Merges never cross a single space between two words, so words are encoded once and kept, with the space before
    them; the first word has none. Texts with a run of white space around a space are encoded whole. A run of 4,096 or more
    is a piece by itself, but for its last character if more text follows: what the file's pattern makes of it, without
    asking the pattern. The merging itself is done by tiktoken over the file's own vocabulary, whose ids are its merge ranks: the same ids in a fifth of the
    time (tests compare both).
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        merging = lambda pattern: tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.short, self.as_one = merging(PATTERN), cache(lambda: merging(r"[\s\S]+"))
        self.ranks, self.starts = ranks, {i for t, i in ranks.items() if t[:1] == b" "}
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.added = {t: self.bytes_of([i]) for t, i in special.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def tokens(self) -> list[bytes]:
        """The bytes of each id; an id that no text gives has none."""
        out = [b""] * (max(self.ranks.values()) + 1)
        for t, i in self.ranks.items():
            out[i] = t
        return out

    @staticmethod
    def bytes_of(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def whole(self, text: str) -> list[int]:
        """ids of a text without added tokens."""
        if len(text) < 4096:
            return self.short(text)
        out, at = [], 0
        for run in LONG_BLANK.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += self.short(text[at : run.start()]) + self.as_one()(text[run.start() : end])
            at = end
        return out + self.short(text[at:])

    def __call__(self, text: str) -> bytes:
        if self.parts and self.parts.search(text):
            return b"".join(self.added.get(part) or self.ordinary(part) for part in self.parts.split(text) if part)
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        known = self.known
        if self.held > CACHE:
            known.clear()
            self.held = 0
        if new := [w for w in {*rest} if w not in known]:
            if any(not w or w[0].isspace() or w[-1].isspace() for w in new):
                return self.bytes_of(self.whole(text))
            # only a word's first token starts with a space
            ids = self.whole(" " + " ".join(new))
            at = [i for i, x in enumerate(ids) if x in self.starts] + [len(ids)]
            known.update((w, self.bytes_of(ids[i:j])) for w, i, j in zip(new, at, at[1:]))
            self.held += sum(map(len, new)) + 4 * len(ids) + ENTRY * len(new)
        if not first or first[-1].isspace():
            return self.bytes_of(self.whole(text))
        return self.bytes_of(self.whole(first)) + b"".join(map(known.__getitem__, rest))


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, keep: list[str] | None = None) -> DataFrame:
    """A row for each piece: the kept columns, piece, start, length, ids_crc32. Only documents longer than ``capacity`` are cut; the first piece may be shorter than the others."""
    keep = keep if keep is not None else ["doc_id"]
    src = docs.select(*keep, F.col("text").alias("_text"))
    schema = T.StructType([*src.drop("_text").schema.fields, T.StructField("piece", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, t in enumerate(texts_of(b.column(b.num_columns - 1))):
                ids = encode(t) + END_ID.to_bytes(4, "little")
                total = len(ids) // 4
                first = (total - 1) % capacity + 1
                for n, at in enumerate([0, *range(first, total, capacity)]):
                    end = first if n == 0 else at + capacity
                    row.append(k), piece.append(n), start.append(at), length.append(end - at), crc.append(zlib.crc32(ids[4 * at : 4 * end]))
            cols = [b.column(i).take(pa.array(row, pa.int64())) for i in range(b.num_columns - 1)]
            new = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([*cols, *new], names=[*b.schema.names[:-1], "piece", "start", "length", "ids_crc32"])

    return src.mapInArrow(run, schema)


class Capacities:
    """Segment tree over remaining capacities: how many open groups of bins there are for each, the tightest fit by descent."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, at: int, by: int) -> None:
        at += self.size
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of an open bin that is ``least`` or more, in logarithmic time."""
        at = least + self.size
        if self.count[at]:
            return least
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: (length, first item, items, per bin, first bin, offset).

    Pieces of one length are alike, so the state of the packing is how many bins have which space left; bins that hold
    the same lengths are one group with consecutive numbers. Items of a length go to the tightest bins that fit, as
    many in each as fit (what best fit does with equal items), then to new bins. This is exactly best-fit decreasing
    over all pieces, yet its work and its rows depend on ``capacity`` alone: at most some thousand rows, however many
    documents. Items [first item, + items) of the length fill bins from ``first bin`` on, ``per bin`` each, from ``offset``.
    """
    tree, open_, out, bins = Capacities(capacity), {}, [], 0

    def put(space: int, first: int, n: int) -> None:
        if n and space:
            open_.setdefault(space, []).append((first, n))
            tree.add(space, 1)

    for length in sorted((x for x in lengths if lengths[x]), reverse=True):
        item, left = 0, lengths[length]
        while left:
            space = tree.tightest(length) if length <= capacity else None
            if space is None:
                per = capacity // length
                space, first, n = capacity, bins, -(-left // per)
                bins += n
            else:
                first, n = open_[space].pop()
                tree.add(space, -1)
                per = space // length
            full, rest = min(n, left // per), 0
            if full:
                out.append((length, item, full * per, per, first, capacity - space))
                put(space - per * length, first, full)
                item, left = item + full * per, left - full * per
            if full < n and left:
                rest, left = left, 0
                out.append((length, item, rest, rest, first + full, capacity - space))
                put(space - rest * length, first + full, 1)
                item, full = item + rest, full + 1
            put(space, first + full, n - full)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    Rows of a length are numbered by distributed prefix sums over hash ranges; the plan, made on the driver from at
    most ``capacity`` counts, says where the n-th of them goes. Sequences are gapless from offset 0.
    """
    spark = pieces.sparkSession
    order = order or ["doc_id", "piece", "ids_crc32"]
    p = cut(pieces.withColumn("_range", F.pmod(F.xxhash64(*order), F.lit(1024))).withColumn("_one", F.lit(1)))
    counts = {r["length"]: r["count"] for r in p.groupBy("length").count().collect()}
    rows = plan(counts, capacity)
    if not rows:
        rows = [(0, 0, 0, 1, 0, 0)]
    # a length's steps: at most some thousand in all, as one array of steps for each length
    steps: dict[int, list[tuple[int, ...]]] = {}
    for r in rows:
        steps.setdefault(r[0], []).append(tuple(map(int, r[1:])))
    table = spark.createDataFrame([(k, v) for k, v in steps.items()], "_length long, _steps array<struct<first:long,items:long,per:long,bin:long,at:long>>")
    n = prefix_sums(p, ["length"], "_range", order, "_one", "_n").join(F.broadcast(table), F.col("length") == F.col("_length"))
    n = n.withColumn("_step", F.element_at(F.filter("_steps", lambda s: s["first"] <= F.col("_n")), -1))
    inside = F.col("_n") - F.col("_step.first")
    n = n.withColumn("sequence_id", (F.col("_step.bin") + F.floor(inside / F.col("_step.per"))).cast("long"))
    n = n.withColumn("offset", (F.col("_step.at") + F.pmod(inside, F.col("_step.per")) * F.col("length")).cast("long"))
    return n.drop("_range", "_one", "_n", "_length", "_steps", "_step")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences. Null or empty text: one piece, the end id alone. Runs of white space of any length are encoded like other text. Repeated rows and equal keys are pieces of their own; null doc_ids stay null. No documents: no rows."""
    small_batches(spark)
    return pack(tokenized(documents(spark, sf_dir), tokenizer_path())).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
