"""Benchmark decontamination: windows of benchmark items found in documents by one automaton (operator 13)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, documents, small_batches, texts_of
from .licenses import fold

SIZE = 10
#: Characters of windows that one automaton holds, on average: some 200 MB in a worker.
CHARACTERS = 2_000_000
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
_ASCII = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_FOUND = "n_words long, runs array<struct<first:long,last:long>>, items array<string>"


def windows(items: DataFrame, size: int = SIZE, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(win, item), distinct: each item's runs of ``size`` consecutive words, joined by spaces; an item of fewer words is one window, one without words has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, t in zip(b.column(0).to_pylist(), texts_of(b.column(1))):
                words = fold(t).decode("utf-8", "surrogatepass").split(" ")[1:-1] if t else []
                words = [w for w in words if w]
                n = max(1, len(words) - size + 1) if words else 0
                for at in range(0, n, 10_000):
                    some = [" ".join(words[i : i + size]) for i in range(at, min(n, at + 10_000))]
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([item] * len(some), pa.string())], names=["win", "item"])

    return items.select(F.col(item_id).cast("string"), text).mapInArrow(run, "win string, item string").distinct()


class Finder:
    """Words of a text that lie in an occurrence of a window, as runs, and the items of the windows that occur."""

    def __init__(self, pairs: list[tuple[str, str | None]]):
        import ahocorasick

        by: dict[str, list[str | None]] = {}
        for w, item in pairs:
            by.setdefault(w, []).append(item)
        self.automaton, self.items, self.length = ahocorasick.Automaton(), list(by.values()), np.array([w.count(" ") + 1 for w in by], np.int64)
        for k, w in enumerate(by):
            self.automaton.add_word(f" {w} ", k)
        self.automaton.make_automaton()

    def __call__(self, folded: str) -> tuple[list[tuple[int, int]], set[str | None]]:
        """(runs of words, first and last, from 0), and items. ``folded`` has a space on either side of each word and is read once."""
        if not self.items or not (found := list(self.automaton.iter(folded))):
            return [], set()
        spaces = np.flatnonzero(np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        ends, which = np.array(found, np.int64).T
        last = np.searchsorted(spaces, ends) - 1
        cover = np.zeros(len(spaces) + 1, np.int64)
        np.add.at(cover, last - self.length[which] + 1, 1)
        np.add.at(cover, last + 1, -1)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(cover) > 0, [0]))))
        return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist())), {i for k in np.unique(which) for i in self.items[k]}


def joined(*lists: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words that are in a run of any of the lists; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(r for x in lists for r in x):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs' places in the original text: first code point, and the one after the last."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text.translate(_ASCII))]
    return [(at[i][0], at[j][1]) for i, j in runs]


def found(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, characters: int = CHARACTERS, **columns: str) -> DataFrame:
    """``docs`` with n_words, runs (first and last word of each contaminated run, from 0) and items (distinct ids as strings, sorted).

    One automaton over the benchmark's windows is sent to all tasks, and each text is read once by it. Windows are dealt
    to automata by hash so that each holds some ``characters`` and its size is bounded whatever the benchmark's; with more
    than one the documents pass through one after the other, with a cut between. Null and empty texts have no words. A
    window is known with each of its items, repeated items count once, an item without an id counts as the id "null". Rows are
    treated apart: repeated documents have equal results. An empty benchmark finds nothing.
    """
    pairs = cut(windows(benchmark, size, **columns))
    total = pairs.agg(F.sum(F.length("win") + 2)).first()[0] or 0
    parts = max(1, -(-total // characters))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("win", "item"), F.lit(parts)))
    names = [f"_k{i}" for i in range(len(docs.columns))]
    out = docs.toDF(*names).withColumns({"_words": F.lit(0).cast("long"), "_runs": F.lit(None).cast("array<struct<first:long,last:long>>"), "_items": F.lit(None).cast("array<string>")})
    out = out.withColumn("_text", F.col(names[docs.columns.index("text")]))
    schema = T.StructType([f for f in out.schema.fields if f.name in names] + T.StructType.fromDDL(_FOUND.replace("n_words", "_words").replace("runs", "_runs").replace("items", "_items")).fields)
    for part in range(parts):
        own = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in dealt.where(F.col("part") == part).select("win", "item").collect()])
        if part:
            out = cut(out).withColumn("_text", F.col(names[docs.columns.index("text")]))
        out = out.mapInArrow(_finding(own, part), schema)
    return out.toDF(*docs.columns, "n_words", "runs", "items")


_FINDERS: dict[str, Finder] = {}


def _finder(key: str, own) -> Finder:
    """The automaton of this key, made once a worker; the last one is kept for the tasks that follow."""
    if key not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[key] = Finder(own.value)
    return _FINDERS[key]


def _finding(own, part: int):
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(key, own)
        for b in batches:
            n_words, runs, items = [], [], []
            before = zip(b.column(b.num_columns - 3).to_pylist(), b.column(b.num_columns - 2).to_pylist()) if part else None
            for t in texts_of(b.column(b.num_columns - 1)):
                folded = fold(t)
                n_words.append(folded.count(b" ") - 1 if len(folded) > 2 else 0)
                r, i = find(folded.decode("utf-8", "surrogatepass"))
                i = {"null" if x is None else x for x in i}
                if before:
                    r0, i0 = next(before)
                    r, i = joined([(x["first"], x["last"]) for x in r0], r), i.union(i0)
                runs.append([{"first": x, "last": y} for x, y in r]), items.append(sorted(i))
            run_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            cols = [*b.columns[:-4], pa.array(n_words, pa.int64()), pa.array(runs, run_type), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-4], "_words", "_runs", "_items"])

    return run


def original(text: str | None, runs: list | None) -> list[dict] | None:
    return [{"start": a, "end": b} for a, b in spans(text or "", [(r["first"], r["last"]) for r in runs])] if runs else []


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, **more) -> DataFrame:
    """The documents that hold benchmark windows, as they are, with items and spans: the places in the original text (code points, end exclusive) of each run of hit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            at = [original(t, r) for t, r in zip(texts_of(b.column(b.num_columns - 1)), b.column(b.num_columns - 2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(at, kind)], names=[*b.schema.names[:-2], "spans"])

    names = [f"_k{i}" for i in range(len(docs.columns))]
    hit = found(docs, benchmark, size, **more).toDF(*names, "n_words", "runs", "items").where(F.size("runs") > 0)
    src = hit.select(*names, "items", "runs", F.col(names[docs.columns.index("text")]).alias("_text"))
    schema = T.StructType(src.schema.fields[:-2] + T.StructType.fromDDL("spans array<struct<start:long,end:long>>").fields)
    return src.mapInArrow(run, schema).toDF(*docs.columns, "items", "spans")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: see ``found``; null doc_ids stay null."""
    small_batches(spark)
    f = found(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    return f.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"))


_WORDS_SQL = "list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS_SQL.format("text")}, []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_WORDS_SQL.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) t(i) WHERE len(w) > 0),
size AS (SELECT DISTINCT k FROM win),
run AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM d, size, unnest(range(1, len(w) - k + 2)) t(i)),
hit AS (SELECT r, k, i, item FROM run JOIN win USING (k, s)),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM hit, unnest(range(i, i + k)) t(x) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""
