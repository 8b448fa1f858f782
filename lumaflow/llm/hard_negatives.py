"""Hard negatives for anchors, by sorting each anchor's integer scores (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions

#: Rows and components of a block of rows, at most; anchors of a block, on average; anchors scored at once.
ROWS, COMPONENTS, ANCHORS, AT_ONCE = 2048, 1 << 20, 1024, 128
LAST = np.iinfo(np.int64).max
_BLOCK = "block long, first long, dim int, ids array<long>, labels array<long>, q binary"


def components(q: np.ndarray) -> bytes:
    """Whole numbers held as doubles, in two bytes each if they fit; ``matrix`` reads both."""
    small = not len(q) or np.abs(q).max() < 1 << 15
    return (b"h" if small else b"d") + np.ascontiguousarray(q, np.int16 if small else np.float64).tobytes()


def matrix(held: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(held, np.int16 if held[:1] == b"h" else np.float64, offset=1).reshape(-1, dim) if dim else np.zeros((0, 0))


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b`` as whole numbers, exact: in floating point where every sum is one,
    else in Python's integers. Missing components count as 0; what a long can't hold becomes its limit."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * dim
    if most < 1 << 53:
        kind = np.float32 if most < 1 << 24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object)
    return np.clip(whole(a) @ whole(b).T, -LAST, LAST).astype(np.int64)


def blocks(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """The rows that take part, some thousands to a record, without a shuffle. A row's number is its block's ``first`` and its place."""
    src = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    src = src.where(F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(F.abs(x * 256) < float("inf"), F.lit(False))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, ids, labels, held, wide = TaskContext.get().partitionId(), 0, [], [], [], 0

        def record() -> pa.RecordBatch:
            q = np.zeros((len(held), wide))
            for row, v in zip(q, held):
                row[: len(v)] = v
            block = (part << 32) + n
            values = [block], [block << 11], [wide], [ids], [labels], [components(q.ravel())]
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=[x.split()[0] for x in _BLOCK.split(", ")])

        for b in batches:
            lists = b.column(2)
            ends = lists.offsets.to_numpy()
            flat = np.floor(256 * lists.values.to_numpy(zero_copy_only=False))
            for i, l, at, end in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ends, ends[1:]):
                if held and (len(held) == ROWS or (len(held) + 1) * max(wide, end - at) > COMPONENTS):
                    yield record()
                    n, ids, labels, held, wide = n + 1, [], [], [], 0
                ids.append(i), labels.append(l), held.append(flat[at:end])
                wide = max(wide, int(end - at))
        if held:
            yield record()

    assert ROWS == 1 << 11
    return src.mapInArrow(run, _BLOCK)


def _of(column: pa.Array) -> Iterator[tuple]:
    """(first, dim, ids, labels, q) of each record of blocks: ids with the null ones last in order."""
    for r in column:
        x = r.as_py()
        ids = np.array([LAST if i is None else i for i in x["ids"]], np.int64)
        yield x["first"], x["ids"], ids, np.array(x["labels"], np.int64), matrix(x["q"], x["dim"])


def anchors(found: DataFrame, every: int) -> DataFrame:
    """(uid, id, label, dim, q) of the rows of blocks whose id ``every`` divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for first, given, ids, labels, q in _of(b.column(0)):
                for k in (k for k, i in enumerate(given) if i is not None and i % every == 0):
                    for column, v in zip(out, (first + k, given[k], int(labels[k]), q.shape[1], components(q[k]))):
                        column.append(v)
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=["uid", "id", "label", "dim", "q"])

    return found.select(F.struct("*").alias("x")).mapInArrow(run, "uid long, id long, label long, dim int, q binary")


def _met(found: DataFrame, packed: DataFrame, n_blocks: int) -> DataFrame:
    """Each block of rows beside each block of anchors: a join on the anchor block and a part of the blocks of rows, so
    that few blocks of anchors still make many tasks."""
    parts = max(1, -(-4 * partitions(found.sparkSession) // n_blocks))
    rows = found.select(F.struct("*").alias("rows"), F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("ab"))
    return rows.join(packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).hint("merge"), ["ab", "part"]).select("rows", "anchors")


def first_alike(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, uids: np.ndarray, a_label: np.ndarray, a_uid: np.ndarray, a_q: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(anchor, row, score) of each anchor's first ``k`` other rows of its label, by places in the block."""
    for label in np.unique(a_label):
        own, alike = np.flatnonzero(a_label == label), np.flatnonzero(labels == label)
        if len(alike):
            for a, s in zip(own, scores(a_q[own], q[alike])):
                order = np.lexsort((ids[alike], -s))[: k + 1]
                order = order[uids[alike[order]] != a_uid[a]][:k]
                yield from ((int(a), int(alike[o]), int(s[o])) for o in order)


def first_unlike(ids: np.ndarray, labels: np.ndarray, q: np.ndarray, a_label: np.ndarray, a_q: np.ndarray, wanted: list[list[int]], percent: int, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, number of its wanted score, row, score): for each score p wanted of an anchor the first ``k`` rows of another
    label from p down to ``percent`` of it, read from the anchor's fully sorted scores."""
    s = scores(a_q, q)
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s))
    for a, upper in enumerate(wanted):
        down = -s[a, order[a]]
        unlike = labels[order[a]] != a_label[a]
        for n, p in enumerate(upper):
            low = -(-percent * p // 100)
            i, j = np.searchsorted(down, -p, "left"), np.searchsorted(down, -low, "right")
            for o in i + np.flatnonzero(unlike[i:j])[:k]:
                yield a, n, int(order[a, o]), int(-down[o])


def mine(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, percent: int = 80, **columns: str) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, embedding, label).

    Anchors are the rows whose id ``every`` divides. Every row meets every anchor, in blocks: an anchor's scores with a
    block are computed as whole numbers and sorted by score and id; binary search in them finds where a positive's
    range begins and ends. What is kept of a block, some rows for each anchor, is ranked once more over all blocks,
    each task's rows first. So an anchor's scores are sorted in runs, no task holds more than two blocks, and nothing
    passes through the driver but a count.

    Rows with a null label or vector, or with a component that is null or not finite (256 times the component, too),
    take no part. A null id is no anchor and comes last among equal scores. Components that one of two vectors lacks
    count as 0. Rows that repeat are rows of their own: each is an anchor, and positive or negative of others. Scores
    that a long can't hold become its limit. Empty tables give no rows. Other columns have no effect.
    """
    found = cut(blocks(vectors, **columns))
    own = cut(anchors(found, every))
    n_blocks = -(-max(1, own.count()) // ANCHORS)
    own = own.withColumn("ab", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("int"))

    def packed(of: DataFrame) -> DataFrame:
        return of.groupBy("ab").agg(F.collect_list(F.struct(*[c for c in of.columns if c != "ab"])).alias("anchors"))

    def pairs(batches: Iterator[pa.RecordBatch], look, names: list[str]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in names]
            for (first, given, ids, labels, q), with_ in zip(_of(b.column(0)), b.column(1)):
                group = with_.as_py()
                for at in range(0, len(group), AT_ONCE):
                    some = group[at : at + AT_ONCE]
                    wide = max(x["dim"] for x in some)
                    a_q = np.zeros((len(some), wide))
                    for row, x in zip(a_q, some):
                        row[: x["dim"]] = matrix(x["q"], x["dim"]).ravel() if x["dim"] else 0
                    for found_row in look(some, first, given, ids, labels, q, a_q):
                        for column, v in zip(out, found_row):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    def look_alike(some, first, given, ids, labels, q, a_q):
        a_label, a_uid = (np.array([x[c] for x in some], np.int64) for c in ("label", "uid"))
        for a, o, s in first_alike(ids, labels, q, first + np.arange(len(ids)), a_label, a_uid, a_q, positives):
            yield some[a]["uid"], first + o, given[o], s

    def look_unlike(some, first, given, ids, labels, q, a_q):
        a_label = np.array([x["label"] for x in some], np.int64)
        for a, n, o, s in first_unlike(ids, labels, q, a_label, a_q, [[p["score"] for p in x["wanted"]] for x in some], percent, negatives):
            yield some[a]["uid"], some[a]["wanted"][n]["positive"], first + o, given[o], s

    def best(df: DataFrame, keys: list[str], most: int) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)

    alike_names, unlike_names = ["uid", "row", "id", "score"], ["uid", "positive", "row", "id", "score"]
    ddl = lambda names: ", ".join(f"{n} long" for n in names)
    alike = best(_met(found, packed(own), n_blocks).mapInArrow(lambda it: pairs(it, look_alike, alike_names), ddl(alike_names)), ["uid"], positives)
    alike = cut(alike.select("uid", F.col("row").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # an anchor has at most ``positives`` of them
    wanted = alike.groupBy("uid").agg(F.collect_list(F.struct("positive", F.col("positive_score").alias("score"))).alias("wanted"))
    unlike = _met(found, packed(own.join(wanted.hint("merge"), "uid")), n_blocks).mapInArrow(lambda it: pairs(it, look_unlike, unlike_names), ddl(unlike_names))
    top = best(unlike, ["uid", "positive"], negatives).select("uid", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    known = alike.join(own.select("uid", F.col("id").alias("anchor_id")).hint("merge"), "uid")
    return top.join(known.hint("merge"), ["uid", "positive"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mine`` over all embeddings, with every seventh id's label moved on by one, as the contract says."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    return mine(e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS of, b.vec_id AS id, b.label, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE label = of QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.of WHERE 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
