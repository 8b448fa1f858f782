"""Fuzzy line deduplication by MinHash, with DataFrame functions only (operator 6)."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, documents, linked_in_bands, parity, ranked_in_bands, sieved

#: Characters of a shingle; shorter lines are only compared as wholes.
SHINGLE, PERCENT = 8, 75
#: Values of a signature: each is the least hash of the line's shingles in another order, hash XOR a number of its own.
VALUES, BANDS = 9, 12
_rng = random.Random(6)
ORDERS = [_rng.getrandbits(64) - (1 << 63) for _ in range(VALUES)]


def _triples(values: int, bands: int) -> list[tuple[int, ...]]:
    """Bands of three values of which any two have one in common at most, taken from all triples in a seeded order."""
    for seed in itertools.count():
        every, out = [*itertools.combinations(range(values), 3)], []
        random.Random(seed).shuffle(every)
        for x in every:
            if all(len({*x} & {*y}) < 2 for y in out):
                out.append(x)
        if len(out) >= bands:
            return out[:bands]


#: With nine values these are the twelve lines of an affine plane. A band is shared at a likeness of 0.75 with odds 0.975, at 0.8 with 0.99, at 0.9 with 0.9995. Values that serve in
#: several bands cost less than values of their own, at the same odds.
TRIPLES = _triples(VALUES, BANDS)
#: Bytes of a code point, and of a shingle.
WIDE = 4
WIDTH = WIDE * SHINGLE
#: Neighbouring shingles of a row while signatures are made.
TOGETHER = 4


def code_points(line: Column) -> Column:
    """A line in lower case, each character in WIDE bytes, so that any shingle is found by its place."""
    return F.encode(F.lower(line), "UTF-32")


def _starts(points: Column) -> Column:
    """Byte places, from 1, of the shingles: one at each character."""
    return F.sequence(F.lit(1), F.octet_length(points) - (WIDTH - 1), F.lit(WIDE))


def shingles(line: Column) -> Column:
    """Hashes of a line's character shingles: SHINGLE code points from each place, in lower case."""
    def of(points: Column) -> Column:
        hashed = F.transform(_starts(points), lambda at: F.xxhash64(F.substring(points, at, F.lit(WIDTH))))
        return F.when(F.octet_length(points) >= WIDTH, hashed).otherwise(F.array().cast("array<long>"))
    return F.transform(F.array(code_points(line)), of)[0]


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), place, line, lid (64-bit hash of the line; null if it has no word)."""
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "line"))
    # trimmed from the left only: to look for the end of a line from the right, btrim goes through every character
    return d.withColumn("lid", F.when(F.ltrim("line", F.lit(" \t\x0b\f\r")) != "", F.xxhash64("line")))


def signatures(points: DataFrame) -> DataFrame:
    """(lid, n, m0, m1, ...) of rows (lid, points): the number of shingles and each order's least hash, over all rows of a lid.

    A row holds the shingles of TOGETHER neighbouring places, whose least values go on, so that they cost one update of
    the sums; where a line ends within a row, its last one stands there several times.
    """
    last, at = F.octet_length("points") - (WIDTH - 1), F.col("at")
    t = points.select("lid", "points", last.alias("last"), F.explode(F.sequence(F.lit(1), last, F.lit(TOGETHER * WIDE))).alias("at"))
    places = [at, *[F.least(at + i * WIDE, "last") for i in range(1, TOGETHER)]]
    own = F.least(F.lit(TOGETHER), F.shiftright(F.col("last") - at, WIDE.bit_length() - 1) + 1)
    t = t.select("lid", own.alias("k"), *[F.xxhash64(F.substring("points", x, F.lit(WIDTH))).alias(f"h{i}") for i, x in enumerate(places)])
    t = t.select("lid", "k", *[F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(x)) for j in range(TOGETHER)]).alias(f"m{i}") for i, x in enumerate(ORDERS)])
    return t.groupBy("lid").agg(F.sum("k").alias("n"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(VALUES)])


def alike(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(lid, component): near-duplicate lines, tied by verified pairs.

    Signatures are least hashes in several orders, summed up by line before and after one shuffle, so a line that
    occurs everywhere is one row for each task. The lines of a band are ranked by frequency: of near copies the most
    frequent one is most often what the others were made of. By ``linked_in_bands`` every two lines that share a band
    and are alike by their exact Jaccard likeness get connected.
    """
    points = lines(docs).where("lid IS NOT NULL").select("lid", code_points(F.col("line")).alias("points")).where(F.octet_length("points") >= WIDTH)
    s = signatures(points)
    bands = F.array(*[F.xxhash64(F.lit(i), *[F.col(f"m{j}") for j in x]) for i, x in enumerate(TRIPLES)])
    shared = ranked_in_bands(s.select(F.col("lid").alias("node"), "n", F.explode(bands).alias("band")))
    wanted = cut(shared.select(F.col("node").alias("lid")).distinct())
    full = sieved(lines(docs).where("lid IS NOT NULL").select("lid", "line"), F.col("lid"), wanted)
    texts = cut(full.groupBy("lid").agg(F.first("line").alias("line")).join(wanted.hint("merge"), "lid", "left_semi"))

    def marks(nodes: DataFrame) -> DataFrame:
        of = texts.join(nodes.withColumnRenamed("node", "lid").hint("merge"), "lid", "left_semi")
        return parity(of.select(F.col("lid").alias("node"), F.explode(F.array_distinct(shingles(F.col("line")))).alias("h")))

    links = linked_in_bands(shared, marks, lambda pairs: verified(pairs, texts, percent), percent)
    return components(links).select(F.col("node").alias("lid"), "component")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b, ...) of pairs of lines whose shingle sets have 100 * intersection >= percent * union; ``texts`` has (lid, line)."""
    p = pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("la")).hint("merge"), "a").join(texts.select(F.col("lid").alias("b"), F.col("line").alias("lb")).hint("merge"), "b")
    # generators keep the arrays and the overlap from being computed again in the condition
    p = p.select(*pairs.columns, F.inline(F.array(F.struct(shingles(F.col("la")).alias("s"), shingles(F.col("lb")).alias("t")))))
    p = p.select(*pairs.columns, "s", "t", F.explode(F.array(F.size(F.array_intersect("s", "t")))).alias("shared"))
    # repeated shingles only make arrays longer: what is enough for these lengths is enough for the sets
    enough = (100 + percent) * F.col("shared") >= percent * (F.size("s") + F.size("t"))
    return p.where(enough | (100 * F.col("shared") >= percent * F.size(F.array_union("s", "t")))).select(*pairs.columns)


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All rows of ``docs`` with _kept: the text with one line of each component, and _lines, _kept_lines (their numbers).

    Of a component of equal or near-equal lines the first stays, by (doc_id, null last; text hash; place). Lines
    without a word stay where they are. Equal rows (doc_id and text) act as one: they keep the same lines. Null text
    gives null. Rows with a null doc_id take part, last in order. Other columns are kept and have no effect.
    """
    found = cut(alike(docs, percent))
    occurrences = lines(docs).drop("line").join(found.hint("merge"), "lid", "left").withColumn("component", F.coalesce("component", "lid"))
    occurrences = cut(occurrences.select("doc_id", "th", "place", "component"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "place")
    first = occurrences.where("component IS NOT NULL").groupBy("component").agg(F.min(place).alias("first"))
    stays = first.select("first.doc_id", "first.th", "first.place")
    blank = occurrences.where("component IS NULL").select("doc_id", "th", "place")
    kept = stays.union(blank).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("place")).alias("_places")).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "_places")
    th = F.xxhash64("text")
    d = docs.withColumn("_th", th).join(kept, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left")
    d = d.withColumn("_all", F.split("text", "\n")).withColumn("_places", F.coalesce("_places", F.array().cast("array<int>")))
    d = d.withColumn("_kept", F.when(F.col("text").isNotNull(), F.array_join(F.transform("_places", lambda i: F.get("_all", i)), "\n")))
    return d.withColumn("_lines", F.coalesce(F.size("_all"), F.lit(0)).cast("long")).withColumn("_kept_lines", F.when(F.col("text").isNotNull(), F.size("_places")).otherwise(0).cast("long")).drop("_th", "_d", "_t", "_all", "_places")


def cleaned(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents with the lines that stay (n_chars counts anew), with the columns of ``docs``. A document of which no
    line with a word stays goes; one that had none from the start is left as it is."""
    word = "[^ \\t\\n\\x0B\\f\\r]"
    d = deduplicate(docs, percent).where(F.col("text").isNull() | ~F.col("text").rlike(word) | F.col("_kept").rlike(word))
    d = d.withColumn("text", F.when(F.col("text").rlike(word), F.col("_kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = deduplicate(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", F.greatest("_lines", F.lit(0)).alias("n_lines"), F.col("_kept_lines").alias("n_kept"), F.crc32(F.coalesce("_kept", F.lit("")).cast("binary")).alias("kept_crc32"))
