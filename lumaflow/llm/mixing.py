"""Mixing sources to target weights, by hash-random order and distributed prefix sums (operator 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, prefix_sums, word_count

#: Fixed by the contract: weights of the sources in code point order, and the most epochs of a source.
WEIGHTS, MOST_EPOCHS = (5, 2, 1), 3
#: Leading hexadecimal digits of the order key that make a range of it: 4096 ranges in a source.
RANGE_DIGITS = 3
SEED = "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Targets are the fixed point of sharing the total by weight and resharing what exceeds ``most`` times a source's
    size: the sources with the least size by weight are full, the others get one rate by weight. Sorted by that ratio,
    the rate after k full sources is (total - their limits) / (weight of the others); the first k whose next source
    stays below its limit is the solution, and later rates are smaller. One row for each source: the only windows without a key run over these.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("_w", weight.cast("long")).withColumn("_limit", (F.col("source_size") * most).cast("long"))
    by = Window.orderBy(F.col("_limit") / F.col("_w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(by), F.lit(0))
    s = s.withColumn("_rate", left / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by), F.lit(0))))
    rate = F.max(F.when(F.col("_rate") * F.col("_w") <= F.col("_limit"), F.col("_rate"))).over(everything)
    return s.withColumn("target", F.least(F.coalesce(rate * F.col("_w"), F.col("_limit").cast("double")), F.col("_limit").cast("double"))).select("source", "source_size", "target")


def order_key(doc_id: str = "doc_id", text: str = "text", seed: str = SEED):
    return F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))))


def mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken, and the columns of ``keep``.

    Documents of a source stand in the order of a hash of seed, doc_id and text. Each gets the target's whole epochs,
    and the last epoch goes to the first documents in that order up to the source's budget (the target without its
    fraction), so that the words taken are exactly the budget; the document on the edge gives only its first words.
    Null source: a source of its own, the last. Null or empty text: size 0, nothing taken. Repeated rows are documents
    of their own, equal in order. Rows with a null doc_id take part like others. Other columns have no effect.
    """
    light = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), order_key().alias("_key"), *(keep or []))
    light = cut(light.withColumn("_range", F.substring("_key", 1, RANGE_DIGITS)))
    goals = targets(light.groupBy("source").agg(F.sum("size").alias("source_size")))
    summed = prefix_sums(light, ["source"], "_range", ["_key"], "size", "_before")
    goals = goals.withColumnRenamed("source", "_source")
    m = summed.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    budget = F.floor("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - rounds * F.col("source_size")
    return m.withColumn("taken", F.col("size") * rounds + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))).drop("_key", "_range", "_before")


def mixture(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: each once for every whole epoch taken, and the document
    on a source's edge cut to its first words (n_chars counts anew). Texts are shuffled once, to meet what is taken of them."""
    th = F.xxhash64("text")
    taken = mix(docs.withColumn("_th", th), ["_th"]).where("taken > 0")
    taken = taken.groupBy(F.col("doc_id").alias("_d"), F.col("_th").alias("_t")).agg(F.collect_list(F.struct("taken", "size")).alias("_takes"))
    d = docs.withColumn("_th", th).join(taken, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")))
    # repeated rows share a list; each takes its own entry
    d = d.withColumn("_n", F.when(F.size("_takes") > 1, F.row_number().over(Window.partitionBy("doc_id", "_th").orderBy(F.lit(0)))).otherwise(1))
    d = d.withColumn("_take", F.element_at("_takes", F.col("_n"))).where("_take IS NOT NULL")
    whole, rest = F.floor(F.col("_take.taken") / F.col("_take.size")).cast("int"), F.pmod("_take.taken", "_take.size").cast("int")
    words_ = F.split(F.regexp_replace("text", "^[ \\t\\n\\x0B\\f\\r]+", ""), "(?<=[ \\t\\n\\x0B\\f\\r])(?=[^ \\t\\n\\x0B\\f\\r])")
    part = F.array_join(F.slice(words_, F.lit(1), rest), "")
    texts = F.concat(F.array_repeat(F.col("text"), whole), F.when(rest > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    d = d.withColumn("text", F.explode(texts))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(md5(text), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS most FROM s),
r AS (SELECT *, ((SELECT sum(source_size) FROM w) - coalesce(sum(most) OVER b, 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER b, 0)) AS rate
      FROM w WINDOW b AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(coalesce((SELECT max(rate) FROM r WHERE rate * w <= most) * w, most), CAST(most AS DOUBLE)) AS target FROM r),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END)
            + greatest(0, least(size, (CASE WHEN source_size > 0 THEN budget % source_size ELSE 0 END) - before)) AS BIGINT) AS taken
FROM p
"""
