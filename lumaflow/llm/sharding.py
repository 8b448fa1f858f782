"""Sharding by a hierarchical weighted hash tree (operator 4)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents, prefix_sums

#: A tree of regions of racks of shards; a leaf is (number, weight). Racks and regions weigh what their shards weigh.
Tree = list[list[list[tuple[int, float]]]]
#: Shards in a rack and racks in a region of the default tree.
RACK, REGION = 5, 4
#: Leading hexadecimal digits of the order key in a shard: 4096 ranges of each.
RANGE_DIGITS = 3


def tree(shards: int, weights: dict[int, float] | None = None, rack: int = RACK, region: int = REGION) -> Tree:
    """Shards in order fill racks, racks fill regions."""
    leaves = [(k, (weights or {}).get(k, 1.0)) for k in range(shards)]
    racks = [leaves[i : i + rack] for i in range(0, shards, rack)]
    return [racks[i : i + region] for i in range(0, len(racks), region)]


def shard_of(key: Column, t: Tree) -> Column:
    """Descends region, rack and shard, each time to the child with the least draw.

    A leaf's draw is -ln(u) / weight, u a uniform hash of key and shard: an exponential clock of the leaf's weight. A
    rack's draw is the least of its leaves' draws, a region's the least of its racks', which makes each the clock of its
    whole weight. A draw depends on the leaves below it alone, so keys move only out of subtrees that lose weight and
    into leaves that come or gain weight, whatever the number of shards and wherever they stand; all others stay.
    """
    leaves = F.from_json(F.lit(json.dumps([[[{"s": k, "w": w} for k, w in rack] for rack in region] for region in t])), "array<array<array<struct<s:int,w:double>>>>")
    u = lambda x: (F.shiftrightunsigned(F.xxhash64(key, x["s"]), 11) + 0.5) / float(1 << 53)
    drawn = F.transform(leaves, lambda region: F.transform(region, lambda rack: F.transform(rack, lambda x: F.struct((-F.log(u(x)) / x["w"]).alias("draw"), x["s"].alias("shard")))))
    regions = F.transform(drawn, lambda region: F.array_min(F.transform(region, lambda rack: F.array_min(rack))))
    return F.array_min(regions)["shard"]


def assign(docs: DataFrame, t: Tree, grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, with ``grown``, grown_shard, for every document.

    doc_id and the tree decide on the shard; null counts as a doc_id of its own. Slots are gapless from 0 in a shard,
    in hash order, counted by distributed prefix sums, so that no shard is sorted in one task. Null text: crc of
    nothing, size 16. Repeated rows share a shard and take slots of their own. Other columns have no effect.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    d = docs.select("doc_id", (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.md5(F.concat(F.lit("slot/"), key)).alias("_key"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    d = d.withColumn("shard", shard_of(key, t))
    if grown is not None:
        d = d.withColumn("grown_shard", shard_of(key, grown))
    d = cut(d.withColumn("_range", F.substring("_key", 1, RANGE_DIGITS)).withColumn("_one", F.lit(1)))
    return prefix_sums(d, ["shard"], "_range", ["_key", "text_crc32"], "_one", "slot").withColumn("slot", F.col("slot").cast("long")).drop("_key", "_range", "_one")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(documents(spark, sf_dir), tree(40), tree(41))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
