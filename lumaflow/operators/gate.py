"""Block, review or pass by label tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def gate_table(spark: SparkSession, gate: dict[str, dict[str, tuple[str, ...]]]) -> DataFrame:
    """(dimension, label, severity): 2 blocks, 1 is reviewed; block wins if a label is in both."""
    rows = {(d, x): s for d, lists in gate.items() for name, s in (("review", 1), ("block", 2)) for x in lists[name]}
    return spark.createDataFrame([(d, x, s) for (d, x), s in rows.items()], "dimension STRING, label STRING, severity INT")


def verdicts(labels: DataFrame, gate: dict[str, dict[str, tuple[str, ...]]]) -> DataFrame:
    """(item_id, verdict, block_hits, review_hits, unknown) from rows (item_id, dimension, label).

    Null labels say nothing, unknown dimensions are reported and pass. The table is as large as the configuration.
    """
    spark = labels.sparkSession
    found = labels.join(F.broadcast(gate_table(spark, gate)), ["dimension", "label"], "left")
    known = F.col("dimension").isin(*gate) if gate else F.lit(False)
    hit = F.concat_ws("=", "dimension", "label")
    of = lambda c: F.array_sort(F.collect_list(F.when(c, hit)))
    v = found.groupBy("item_id").agg(F.max("severity").alias("severity"), of(F.col("severity") == 2).alias("block_hits"), of(F.col("severity") == 1).alias("review_hits"), F.array_sort(F.collect_set(F.when(F.col("label").isNotNull() & ~known, F.col("dimension")))).alias("unknown"))
    return v.select("item_id", F.when(F.col("severity") == 2, "block").when(F.col("severity") == 1, "review").otherwise("pass").alias("verdict"), "block_hits", "review_hits", "unknown")
