"""Pieces that several operators share."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words, as a Java regular expression: ASCII white space.
BLANK = "[ \\t\\n\\x0B\\f\\r]+"


#: Rows of an Arrow batch, where the session has Spark's own 10,000: with texts of some kB each a batch takes some MB.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Gives a session that left the size of Arrow batches alone a smaller one, fit for whole documents. Buffers of batches
    live outside the heap, twice for each task, and grow to the largest batch seen."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def word_count(text: Column) -> Column:
    """Number of words, without keeping them: pieces between blanks, less the empty first and last."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANK))).cast("long")


def texts_of(column: pa.Array, rows: int = 64) -> Iterator[str]:
    """The column's texts, null as empty, some rows at a time: what Python holds besides the Arrow batch is bounded by these."""
    for i in range(0, len(column), rows):
        for t in column.slice(i, rows).to_pylist():
            yield t or ""


#: Longs of a sieve's bits: at most so many rows of 16 bytes are broadcast, whatever the table's size.
SIEVE = 1 << 18


def sieved(df: DataFrame, key: Column, wanted: DataFrame, how: str = "inner") -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in the one column of ``wanted``: all that are, and some others.

    One hash sets one bit of SIEVE longs. While ``wanted`` has less than some millions of rows hardly another row
    passes; beyond, more and more do. It only saves shuffling: the exact join that follows decides, at every size, so
    the plan is the same whatever the counts. With ``how`` "left" all rows stay and _may tells which pass.
    """
    placed = lambda d, k: d.withColumn("_h", F.xxhash64(k)).withColumn("_at", F.col("_h").bitwiseAND(SIEVE - 1)).withColumn("_bit", F.expr("shiftleft(1L, CAST((_h >> 40) & 63 AS INT))")).drop("_h")
    bits = cut(placed(wanted, F.col(wanted.columns[0])).groupBy("_at").agg(F.bit_or("_bit").alias("_bits")))
    d = placed(df, key).join(F.broadcast(bits), "_at", how)
    may = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    d = d.where(may) if how == "inner" else d.withColumn("_may", may)
    return d.drop("_at", "_bit", "_bits")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: lineage ends there.

    The folder is the session's ``spark.checkpoint.dir``, see ``shared_folder``. What the optimizer infers from the rows'
    conditions isn't carried over the cut: of wide conditions on renamed columns it would grow with every step.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(key, before)


def let_go(spark: SparkSession) -> None:
    """Has the driver look for tables that nothing refers to any more, so that their shuffle files and, where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on, their checkpoints go: in a loop they'd pile up until its
    heap happens to be full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a session with a local master may do without: driver and executors are
    one process there, and a folder of that machine is used. On a cluster a session without the setting is an error."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list, value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` in each group along (bucket, order), as ``out``.

    ``bucket`` is a range of the order with few values (thousands at most), null nowhere. A group is summed by bucket
    first, the small table of sums runs up over the buckets, and only rows of one bucket of one group are sorted
    together: a group with a third of all rows is spread over as many tasks as it has buckets. ``group`` columns may
    be null. ``df`` is read twice.
    """
    keys = [*group, bucket]
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_base")
    same = [df[k].eqNullSafe(sums[f"_k_{k}"]) for k in group] + [df[bucket] == sums[f"_k_{bucket}"]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(sums, on).drop(*[f"_k_{k}" for k in keys])
    return joined.withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_base")


#: Longs of a set's parity bits, and how many times more hubs each round has than all before.
WORDS, GROWTH = 16, 16


def parity(hashes: DataFrame) -> DataFrame:
    """(node, size, w0, w1, ...) of distinct rows (node, h): a set's size and WORDS longs of parity bits, as ``plausible`` takes
    them. Each hash toggles one bit; its word is part of the first key, so a row is one update and not WORDS of them."""
    word = F.shiftright("h", 6).bitwiseAND(WORDS - 1).cast("int")
    by = hashes.groupBy("node", word.alias("w")).agg(F.count("*").alias("n"), F.bit_xor(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("x"))
    return by.groupBy("node").agg(F.sum("n").alias("size"), *[F.coalesce(F.max(F.when(F.col("w") == i, F.col("x"))), F.lit(0).cast("long")).alias(f"w{i}") for i in range(WORDS)])


def plausible(l: str, r: str, percent: int) -> str:
    """SQL: whether sets with the sizes and parity bits in columns of these prefixes can be alike by ``percent``: two sets differ in at least as many elements as their parity bits differ in."""
    apart = " + ".join(f"bit_count({l}w{i} ^ {r}w{i})" for i in range(WORDS))
    return f"100 * least({l}size, {r}size) >= {percent} * greatest({l}size, {r}size) AND {100 + percent} * ({apart}) <= {100 - percent} * ({l}size + {r}size)"


def ranked_in_bands(posts: DataFrame) -> DataFrame:
    """(band, node, rank, hub), written, of rows (band, node, n): the members of bands that have several, each band's numbered
    from 1 by the largest n, then the least node; hub is the first."""
    # most bands have one member: those go before the others are put in order, as a sort by the band alone costs less
    several = posts.withColumn("members", F.count("*").over(Window.partitionBy("band"))).where("members > 1")
    of_band = Window.partitionBy("band").orderBy(F.desc("n"), "node")
    return cut(several.select("band", "node", F.row_number().over(of_band).alias("rank"), F.first("node").over(of_band).alias("hub")))


def linked_in_bands(ranked: DataFrame, marks: Callable[[DataFrame], DataFrame], verified: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Verified links (a, b) by which every two members of a band that are alike are connected.

    ``ranked`` (band, node, rank, hub): members of bands as ``ranked_in_bands`` numbers them; ``marks`` gives (node, size,
    w0, w1, ...) of a table of nodes; ``verified`` keeps the rows (a, b, ...) of pairs that are alike. In each round the next members of a band are
    its hubs, one in the first round, then GROWTH - 1 times as many as all before, and meet the later members that aren't
    known to be of their component, if the pair is ``plausible``. What links by then meets no other hub of its component:
    a group of near copies costs some pairs for each member, not the square. Bands of one component are closed. When all
    members have been hubs, no two of a band are left that neither met nor were known to be connected. Joins are merge
    joins at every size: a table that is broadcast would pass through the driver, each time. Pairs bring their labels
    along and the last round names nothing: each shuffle spared is one for each round.
    """
    def named(members: DataFrame, found: DataFrame, last: int) -> DataFrame:
        """The members of bands that stay open. Nodes take the least label that theirs is linked with, by ``found`` (x, y), in
        two steps; labels of one component may still differ, those of two components never agree."""
        to = lambda c: F.struct(F.col(c).alias("label"), F.least("x", "y").alias("to"))
        least = cut(found.select(F.explode(F.array(to("x"), to("y"))).alias("z")).groupBy("z.label").agg(F.min("z.to").alias("to")))
        further = least.join(least.select(F.col("label").alias("to"), F.col("to").alias("then")).hint("merge"), "to", "left").select("label", F.coalesce("then", "to").alias("to"))
        m = members.join(further.hint("merge"), "label", "left").select("band", "node", "rank", F.coalesce("to", "label").alias("label"))
        of_band = Window.partitionBy("band")
        m = m.withColumn("lo", F.min("label").over(of_band)).withColumn("hi", F.max("label").over(of_band)).withColumn("most", F.max("rank").over(of_band))
        return cut(m.where((F.col("lo") < F.col("hi")) & (F.col("most") > last)).select("band", "node", "rank", "label"))

    pair = [F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")]
    links = cut(verified(cut(ranked.where("rank > 1").select(*pair).distinct())))
    let_go(links.sparkSession)
    if ranked.where("rank > 2").isEmpty():
        return links
    open_ = named(ranked.withColumn("label", F.col("node")), links.select(F.col("a").alias("x"), F.col("b").alias("y")), 2)
    let_go(links.sparkSession)
    if open_.isEmpty():
        return links
    known = cut(marks(open_.select("node").distinct()))
    cols = [*[c for c in known.columns if c != "node"], "label"]
    at, last = 2, GROWTH
    while True:
        now = open_.join(known.hint("merge"), "node")
        hubs = now.where((F.col("rank") >= at) & (F.col("rank") < last)).select("band", F.col("node").alias("hub"), F.col("rank").alias("h_rank"), *[F.col(c).alias(f"h_{c}") for c in cols])
        met = now.where(F.col("rank") > at).hint("merge").join(hubs, "band").where(f"rank > h_rank AND label != h_label AND {plausible('h_', '', percent)}")
        found = cut(verified(cut(met.select(*pair, F.least("label", "h_label").alias("x"), F.greatest("label", "h_label").alias("y")).distinct())))
        links = links.union(found.select("a", "b"))
        if open_.where(F.col("rank") > last).isEmpty():
            let_go(links.sparkSession)
            return links
        open_ = named(open_, found, last)
        let_go(links.sparkSession)
        if open_.isEmpty():
            return links
        at, last = last, last * GROWTH


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links as (node, component), component the smallest node.

    Large-star and small-star turns (Kiveris et al. 2014) until all links are stars: each node has one link to a lesser
    one, which has none, so no turn is spent on finding that nothing changes. Links stay distributed; each turn is
    checkpointed, so a lost executor costs at most one step. The least neighbours are a table of their own, so that
    the join of a hub's links with them has a shuffle on either side and the engine's skew join can split it.
    Nodes without links are not in the result; self links and repeated links do no harm; null ends are dropped.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")))
        # one shuffle serves the least link and its join; there is a row for each link at most
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).repartition("u")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").where("u > v").distinct())
        let_go(e.sparkSession)
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(links: DataFrame) -> bool:
    """Whether distinct links (u, v), u > v, are stars with the least node in the middle."""
    end = lambda c, k: F.struct(F.col(c).alias("node"), F.lit(k).alias("up"))
    ends = links.select(F.explode(F.array(end("u", 1), end("v", 0))).alias("x")).groupBy("x.node").agg(F.sum("x.up").alias("ups"), F.min("x.up").alias("least"))
    return ends.where("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()
