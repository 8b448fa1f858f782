"""Titles from template pools, ranked; file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import books
from ..functions.scalars import sanitize_title, title_score


def pool_keys(style: Column, targets: Column, has_actions: Column) -> Column:
    """Pools of the style, of the targets, of characters, and the generic one; each once, in this order."""
    known = F.when(style.isin(*books.TITLE_POOLS), F.array(style)).otherwise(F.array().cast("array<string>"))
    routes = F.create_map(*[x for k, v in books.TITLE_ROUTES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    routed = F.flatten(F.transform(F.coalesce(targets, F.array().cast("array<string>")), lambda t: F.coalesce(F.try_element_at(routes, t), F.array().cast("array<string>"))))
    people = F.when(has_actions, F.array(F.lit("group_action"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(known, routed, people, F.array(F.lit("generic"))))


def titles(contexts: DataFrame, most: int = 3) -> DataFrame:
    """(item_id, rank, title) from contexts (item_id, style_hint, target_ids, subject, action, duration_seconds)."""
    pools = F.create_map(*[x for k, v in books.TITLE_POOLS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    has = F.col("subject").isNotNull()
    c = contexts.withColumn("template", F.flatten(F.transform(pool_keys(F.col("style_hint"), F.col("target_ids"), has), lambda k: F.element_at(pools, k))))
    seconds = F.greatest(F.lit(1), F.bround("duration_seconds", 0).cast("int")).cast("string")
    def fill(t: Column) -> Column:
        slots = t.contains("{subject}") | t.contains("{action}")
        filled = F.replace(F.replace(F.replace(t, F.lit("{seconds}"), seconds), F.lit("{subject}"), F.coalesce("subject", F.lit(""))), F.lit("{action}"), F.coalesce("action", F.lit("")))
        return F.when(~slots | has, filled)
    c = c.withColumn("title", F.array_distinct(F.array_compact(F.transform("template", fill))))
    c = c.select("item_id", "subject", F.posexplode("title").alias("i", "title"))
    c = c.withColumn("score", title_score(F.col("title"), F.col("i"), F.col("subject")))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "i"))).where(F.col("rank") <= most).select("item_id", "rank", "title", F.round("score", 6).alias("score"))


def file_names(df: DataFrame, title: str, order: str) -> DataFrame:
    """Adds file_name: the sanitized title, from the second of a name on with _2, _3 and so on."""
    base = df.withColumn("_base", sanitize_title(F.col(title)))
    k = F.row_number().over(Window.partitionBy("_base").orderBy(order))
    return base.withColumn("file_name", F.concat("_base", F.when(k > 1, F.concat(F.lit("_"), k.cast("string"))).otherwise(""), F.lit(".mp4"))).drop("_base")
