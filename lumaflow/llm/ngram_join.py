"""N-gram Jaccard join with adaptive multi-match prefixes (operator 5)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, cut, documents, let_go, sieved, small_batches, texts_of
from .shingles import SIZE, Shingler, against, set_id, sets_of, verified

PERCENT = 75
#: Counters of the frequency sketch. It only orders tokens: any count gives the same links, at another cost.
COUNTERS, CHUNKS = 1 << 22, 64
#: The longest prefixes ask for so many shared tokens; comparing one pair costs about VERIFY times the set's size.
MOST_MATCHES, VERIFY = 6, 0.05
#: Classes that a task remembers, so that it doesn't give the prefix of each copy anew.
SEEN = 200_000


def _read(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """For each row its set's size and class; at the end the task's token counts, by chunk of the sketch."""
    from pyspark import TaskContext

    shingle, counts = Shingler(size), np.zeros(COUNTERS, np.uint32)
    names = ["th", "doc_id", "n", "cls", "chunk", "salt", "counts"]
    kind = None
    for b in batches:
        kind = b.column(1).type
        sets = [shingle(t) for t in texts_of(b.column(2))]
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        counts += np.bincount((tokens % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        k = len(sets)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(len, sets), pa.int64()), pa.array(map(set_id, sets), pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
    if kind is not None:
        salt = TaskContext.get().partitionId() % 64
        packed = [zlib.compress(c.tobytes(), 1) for c in np.split(counts, CHUNKS)]
        n = pa.nulls(CHUNKS, pa.int64())
        yield pa.RecordBatch.from_arrays([n, pa.nulls(CHUNKS, kind), n, n, pa.array(range(CHUNKS), pa.int32()), pa.array([salt] * CHUNKS, pa.int32()), pa.array(packed, pa.binary())], names=names)


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(COUNTERS // CHUNKS, np.uint32)
    for c in pdf["counts"]:
        total += np.frombuffer(zlib.decompress(c), np.uint32)
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})


def prefix(s: np.ndarray, sketch: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int, int]:
    """(tokens of the prefix, rarest first; shared tokens asked for; how common the set's tokens are on average).

    Two sets with the needed overlap o share at least m tokens among their first |s| - o + m tokens in one global order
    (here: count in the sketch, then hash). A longer prefix costs more lookups, the sum of its tokens' counts, and leaves
    at most that sum / m pairs to compare; m is chosen where both together cost least.
    """
    count = sketch[(s % np.uint64(len(sketch))).astype(np.int64)]
    order = np.lexsort((s, count))
    n, least = len(s), -(-percent * len(s) // 100)
    most = min(MOST_MATCHES, least)
    lookups = np.cumsum(count[order], dtype=np.float64)
    m = np.arange(1, most + 1)
    reach = lookups[n - least + m - 1]
    best = int(np.argmin(reach + VERIFY * n * reach / m)) + 1
    return s[order[: n - least + best]], best, int(256 * np.log2(1 + count.mean()))


def _prefixes(batches: Iterator[pa.RecordBatch], size: int, sketch: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    shingle, seen = Shingler(size), set()
    for b in batches:
        token, cls, n, pos, m, common = [], [], [], [], [], []
        if len(seen) > SEEN:
            seen.clear()
        for t in texts_of(b.column(0)):
            s = shingle(t)
            c = set_id(s)
            if not len(s) or c in seen:
                continue
            seen.add(c)
            p, asked, typical = prefix(s, sketch, percent)
            k = len(p)
            token.append(p.view(np.int64)), pos.append(np.arange(k, dtype=np.int32))
            for column, v in ((cls, c), (n, len(s)), (m, asked), (common, typical)):
                column.append(np.full(k, v, np.int64))
        if token:
            flat = [np.concatenate(x) for x in (token, cls, n, pos, m, common)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int16(), pa.int16())
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(flat, kinds)], names=["token", "cls", "n", "pos", "m", "common"])


def _needed(x, y, percent: int):
    """The overlap from which sets of these sizes link."""
    return F.floor((percent * (x["n"] + y["n"]) + (100 + percent) - 1) / (100 + percent))


def _alike_in_size(x, y, percent: int):
    return 100 * F.least(x["n"], y["n"]) >= percent * F.greatest(x["n"], y["n"])


def _may_link(x, y, percent: int, m=None):
    """Both places are in the prefixes that this pair of sizes needs: |s| - o + m, o the overlap at which the two sets link."""
    needed, m = _needed(x, y, percent), F.least(x["m"], y["m"]) if m is None else m
    return _alike_in_size(x, y, percent) & (x["pos"] < x["n"] - needed + m) & (y["pos"] < y["n"] - needed + m)


def classes(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """Rows (th, doc_id, n, cls) of the documents, and the frequency sketch of their tokens (COUNTERS numbers)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = cut(docs.select(F.xxhash64("text").alias("th"), "doc_id", "text").mapInArrow(lambda it: _read(it, size), f"th long, doc_id {kind}, n long, cls long, chunk int, salt int, counts binary"))
    parts = read.where("chunk IS NOT NULL").select("chunk", "salt", "counts")
    parts = parts.groupBy("chunk", "salt").applyInPandas(_total, "chunk int, counts binary").groupBy("chunk").applyInPandas(_total, "chunk int, counts binary")
    sketch = np.zeros((CHUNKS, COUNTERS // CHUNKS), np.uint32)
    for r in parts.collect():
        sketch[r["chunk"]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    # a table of its own: the sketches of all tasks needn't stay
    return cut(read.where("chunk IS NULL").select("th", "doc_id", "n", "cls")), sketch.reshape(-1)


def links(docs: DataFrame, rows: DataFrame, sketch: np.ndarray, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """(node, component) of classes of equal sets, by links between different sets of 100 * intersection >= percent * union.

    Only tokens of prefixes are shuffled, once; those that one class alone has fall away. In the first turn each token
    ties its other classes to one hub, the class with the commonest tokens, so a large group of near copies costs as
    many pairs as members, not their square. In the second turn pairs are compared that aren't in one component yet:
    those that share enough prefix tokens. The first of m shared ones is among the first |s| - o + 1 tokens of both, so
    only these places make pairs, and the pair's whole prefixes are counted then. And if x and y were both compared
    with hub h and the lesser overlap with h is below the o that x and y need, then only those are compared that share
    a token outside h: with c tokens of x in h at most c of the shared ones are, and the other o - c or more are among
    the few that x and y have besides. No link between components is lost.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(sketch)
    posts = docs.select("text").mapInArrow(lambda it: _prefixes(it, size, known.value, percent), "token long, cls long, n int, pos int, m short, common short")
    # one shuffle: the tokens that two classes have are told by a window over it
    of_token = Window.partitionBy("token")
    several = posts.withColumn("lo", F.min("cls").over(of_token)).withColumn("hi", F.max("cls").over(of_token)).where("lo < hi").drop("lo", "hi")
    live = cut(several.dropDuplicates(["token", "cls"]))
    named = rows.where("n > 0").groupBy("cls").agg(F.min("th").alias("th"))
    x, y = F.col("x"), F.col("y")

    def sets(pairs: DataFrame, a: str, b: str) -> DataFrame:
        wanted = pairs.select(F.col(a).alias("cls")).union(pairs.select(F.col(b).alias("cls"))).distinct()
        return sets_of(docs, named.join(wanted, "cls").select("cls", "th"), size)

    # first turn: to the hubs
    hubs = live.groupBy("token").agg(F.max(F.struct("common", "cls", "n", "pos", "m")).alias("y"))
    tied = live.select("token", F.struct("cls", "n", "pos", "m").alias("x")).join(hubs, "token").where("x.cls != y.cls").where(_may_link(x, y, percent))
    tied = tied.groupBy(F.col("x.cls").alias("cls"), F.col("y.cls").alias("hub")).agg(F.count("*").alias("shared"), F.min(F.least("x.m", "y.m")).alias("m")).where("shared >= m")
    tied = cut(tied.select("cls", "hub"))
    compared = cut(against(tied, sets(tied, "cls", "hub"), percent))
    found = compared.where("linked").select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"))
    joined = cut(components(found)).withColumnRenamed("node", "cls")

    # each class's main hub is the one most compared with, itself counted; what it has besides is its extra
    used = compared.groupBy("hub").agg(F.count("*").alias("uses"))
    own = used.select(F.col("hub").alias("cls"), "hub").join(rows.groupBy("cls").agg(F.first("n").cast("int").alias("n")), "cls").select("cls", "hub", F.col("n").alias("shared"), "n", F.array().cast("array<long>").alias("extra"))
    main = compared.where("extra IS NOT NULL").select("cls", "hub", "shared", "n", "extra").union(own).join(used, "hub")
    main = main.groupBy("cls").agg(F.max_by(F.struct("hub", "shared", "n", "extra"), F.struct("uses", "hub")).alias("h"))
    main = cut(main.join(joined, "cls", "left").select("cls", "h.hub", "h.shared", "h.n", "h.extra", F.coalesce("component", "cls").alias("component")))

    # second turn: the rest
    labelled = live.join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    open_ = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    left = labelled.join(open_, "token", "left_semi").join(main.select("cls", "hub", "shared"), "cls", "left")
    left = cut(left.select("token", F.struct("cls", "n", "pos", "m", "component", "hub", "shared").alias("x")))
    by_hub = F.coalesce((F.col("x.hub") == F.col("y.hub")) & (F.least("x.shared", "y.shared") < _needed(x, y, percent)), F.lit(False))
    pair = [F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")]
    rest = left.join(left.select("token", x.alias("y")), "token").where("x.component < y.component").where(_may_link(x, y, percent, 1) & ~by_hub)
    rest = cut(rest.select(*pair).distinct())
    # of a pair's whole prefixes m tokens are shared
    ordered = F.array_sort(F.collect_list(F.struct("x.pos", "token")))
    whole = left.groupBy("x.cls").agg(F.first("x.n").alias("n"), F.first("x.m").alias("m"), ordered.alias("p"))
    side = lambda c: whole.select(F.col("cls").alias(c), F.struct("n", "m", "p").alias(f"of_{c}"))
    rest = rest.join(side("a"), "a").join(side("b"), "b")
    s, t = F.col("of_a"), F.col("of_b")
    m = F.least(s["m"], t["m"])
    within = lambda z: F.transform(F.filter(z["p"], lambda e: e["pos"] < z["n"] - _needed(s, t, percent) + m), lambda e: e["token"])
    rest = rest.where(F.size(F.array_intersect(within(s), within(t))) >= m).select("a", "b")
    extra = main.select("hub", F.explode("extra").alias("token"), F.struct("cls", "n", "shared", "component").alias("x"))
    shared = extra.groupBy("hub", "token").agg(F.min("x.component").alias("lo"), F.max("x.component").alias("hi")).where("lo < hi").select("hub", "token")
    extra = cut(extra.join(shared, ["hub", "token"], "left_semi"))
    besides = extra.join(extra.select("hub", "token", x.alias("y")), ["hub", "token"]).where("x.component < y.component").where(_alike_in_size(x, y, percent))
    besides = besides.groupBy(*pair).agg(F.count("*").alias("k"), F.min(_needed(x, y, percent) - F.least("x.shared", "y.shared")).alias("m")).where("k >= m").select("a", "b")
    pairs = cut(rest.union(besides).distinct())
    more = verified(pairs, sets(pairs, "a", "b"), percent)
    return components(found.union(more))


def grouped(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """Rows (th, doc_id, n, component) of ``docs``: component names a group of linked classes, null without words."""
    rows, sketch = classes(docs, size)
    let_go(docs.sparkSession)
    found = cut(links(docs, rows, sketch, percent, size))
    out = rows.join(found.withColumnRenamed("node", "cls"), "cls", "left")
    return out.select("th", "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "cls")).alias("component"))


def join(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``.

    Documents with equal sets are one class and one component. A document without words or text links with nothing.
    component_id is the smallest doc_id of the component; rows without a doc_id belong to components but don't name
    them (null if none of theirs has one). Repeated rows are rows of their own. Other columns have no effect.
    """
    g = cut(grouped(docs, percent, size))
    named = g.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    out = g.join(named, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, percent: int = PERCENT, size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` that stay when of each component one document does: the smallest doc_id (null last), then text hash.

    Documents without words stay. Of rows that repeat a doc_id and a text one stays. What doesn't simply stay is looked
    up in the documents, so texts are only shuffled if a sieve can't tell that they stay.
    """
    g = cut(grouped(docs, percent, size))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = g.where("component IS NOT NULL").groupBy("component").agg(F.min(key).alias("first"))
    rows = g.where("component IS NOT NULL").groupBy("component", "doc_id", "th").agg(F.count("*").alias("k"))
    odd = rows.join(first, "component").withColumn("_gone", key != F.col("first")).where("_gone OR k > 1")
    odd = cut(odd.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "_gone"))
    d = sieved(docs.withColumn("_th", F.xxhash64("text")), F.col("_th"), odd.select("_t"), "left")
    doubtful = d.where("_may").join(odd.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    once = doubtful.where("_gone = false").dropDuplicates(["doc_id", "_th"])
    return d.where("NOT _may").select(*docs.columns).unionByName(doubtful.where("_gone IS NULL").select(*docs.columns)).unionByName(once.select(*docs.columns))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return join(documents(spark, sf_dir))
