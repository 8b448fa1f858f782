"""Style rules over signal rows, and what goes to a second review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import RuleBook


def evaluate(signals: DataFrame, book: RuleBook, production: bool = False, digits: int = 4) -> DataFrame:
    """(video_id, position, profile_id, style_score, notes): matches in the book's order."""
    book.check_production(production)
    return signals.select("video_id", F.explode(book.match(digits)).alias("m")).select("video_id", "m.*")


def scores(signals: DataFrame, book: RuleBook, digits: int = 6) -> DataFrame:
    """Every enabled profile's score for every row, matched or not."""
    each = [F.struct(F.lit(p.profile_id).alias("profile_id"), p.score(digits).alias("style_score"), p.conditions.column().alias("matches")) for p in book.profiles if p.enabled]
    return signals.select("video_id", F.explode(F.array(*each)).alias("m")).select("video_id", "m.*")


def referrals(matches: DataFrame, book: RuleBook) -> DataFrame:
    """(video_id, rank_index, profile_id, trigger, max_windows, reason) of the matches that need a review."""
    w = Window.partitionBy("video_id")
    several = F.count("*").over(w) >= 2
    m = matches.withColumn("rank_index", F.row_number().over(w.orderBy("position")) - 1).withColumn("several", several)
    rules = [(p.profile_id, p.fallback) for p in book.profiles if p.fallback]
    pick = lambda of: F.coalesce(*[F.when(F.col("profile_id") == k, F.lit(of(f))) for k, f in rules])
    m = m.withColumn("trigger", pick(lambda f: f.trigger)).withColumn("max_windows", pick(lambda f: f.max_windows)).withColumn("prompt_ref", pick(lambda f: f.prompt_ref))
    m = m.where((F.col("trigger") == "always") | (F.col("trigger") == "ambiguous_multi_hit") & F.col("several"))
    return m.withColumn("reason", F.when(F.col("several"), "multi_hit_ambiguous").otherwise("profile_requires_l2")).drop("several", "position", "notes", "style_score")
