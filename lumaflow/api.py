"""The engine's functions as one would call them, with their request limits checked before a plan is built."""

from __future__ import annotations

import argparse
import json
import os
import tempfile
import threading
import uuid
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conf import EngineConf
from .functions import books, providers
from .functions.rules import RuleBook
from .operators import closed_set, fingerprints, gate, motion, narrative, planner, platforms, storyboard, styles, titles
from .plans.pipeline import review, run_pipeline
from .schemas import VERSIONS
from .streaming.jobs import NEXT

#: Request limits.
LIMITS = {"windows": (1, 32), "frame_width": (64, 1280), "plan_windows": (0, 64), "target_seconds": (0, 60), "references": (1, 8), "frames": (4, 64), "matches": (0, 64), "title_matches": (0, 8), "review_frames": (1, 3)}


class RequestError(ValueError):
    pass


def within(name: str, value: float) -> float:
    low, high = LIMITS[name]
    if not low <= value <= high:
        raise RequestError(f"{name} must be in {low}..{high}")
    return value


def exclusive(**given) -> str:
    """The one argument that is given; none or several are an error."""
    named = [k for k, v in given.items() if v is not None]
    if len(named) != 1:
        raise RequestError(f"exactly one of {sorted(given)} is needed")
    return named[0]


def per_video(df: DataFrame, name: str, key: str = "video_id") -> DataFrame:
    """The rows, which fail where a video has more of them than a request may."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_n", F.when(n > LIMITS[name][1], F.raise_error(F.lit(f"too many {name}")).cast("long")).otherwise(n)).where("_n > 0").drop("_n")


def as_json(df: DataFrame, version: str) -> DataFrame:
    """One JSON text a row, with its format's version."""
    return df.select(F.to_json(F.struct(F.lit(VERSIONS[version]).alias("schema_version"), *df.columns)).alias("json"))


def capabilities(spark: SparkSession) -> dict:
    return {"engine": "lumaflow", "spark": spark.version, "versions": VERSIONS, "decode": False, "render": False, "settings": EngineConf.of(spark).__dict__}


def analyze_motion(frames: DataFrame, windows: DataFrame, conf: EngineConf = EngineConf()) -> DataFrame:
    within("frame_width", conf.motion_frame_width)
    return motion.motion_windows(frames, per_video(windows, "windows"), conf)


def embed_frames(images: DataFrame, conf: EngineConf = EngineConf()) -> DataFrame:
    """(item_id, v) of images (item_id, name and perhaps content) by the provider that the settings name."""
    content = F.col("content") if "content" in images.columns else None
    return providers.with_images(images, F.col("name"), content, conf.embedding_provider).select("item_id", "v")


def embed_catalog(spark: SparkSession, request: dict | None = None, conf: EngineConf = EngineConf()) -> DataFrame:
    """The request's catalog, over the default one, as ``analyze_visual`` takes it."""
    rows = [(q, value, prompt) for q, by in books.catalog(request).items() for value, prompt in by.items()]
    return providers.catalog_vectors(spark.createDataFrame(rows, "question string, value string, prompt string"), conf.embedding_provider)


def analyze_visual(frames: DataFrame, catalog: DataFrame, score: float | None = None, margin: float = closed_set.MARGIN) -> DataFrame:
    return closed_set.answers(frames, catalog, score, margin)


def compute_signals(frames: DataFrame, conf: EngineConf = EngineConf(), info: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Signals and ranked candidates; ``info`` as the report source gives it."""
    return motion.video_signals(frames, conf, info, True), motion.candidates(frames, conf, True)


def evaluate_profiles(signals: DataFrame, book: RuleBook | None = None, production: bool = False) -> tuple[DataFrame, DataFrame]:
    book = book or books.styles()
    matches = styles.evaluate(signals, book, production)
    return matches, styles.referrals(matches, book)


def profiles(spark: SparkSession, book: RuleBook | None = None) -> DataFrame:
    book = book or books.styles()
    rows = [(p.profile_id, p.enabled, list(p.hooks), p.fallback.trigger if p.fallback else None, book.status) for p in book.profiles]
    return spark.createDataFrame(rows, "profile_id string, enabled boolean, hooks array<string>, trigger string, status string")


def check_gate(labels: DataFrame, book: RuleBook | None = None) -> DataFrame:
    return gate.verdicts(labels, (book or books.styles()).gate)


def plan_clips(windows: DataFrame, target: float = 15.0, least: float = 1.0) -> DataFrame:
    within("target_seconds", target)
    return planner.plan_clips(per_video(windows, "plan_windows"), target, least)


def render_plan(segments: DataFrame) -> DataFrame:
    """What a renderer needs; rendering itself is outside the engine."""
    return planner.edit_list(segments)


def review_windows(candidates: DataFrame, referrals: DataFrame, client=None) -> DataFrame:
    """The best windows of referred videos, as many as their profile allows, with the reviewer's answers."""
    c = candidates.join(referrals.groupBy("video_id").agg(F.max("max_windows").alias("most")), "video_id").where("rank <= most")
    return review(c.drop("most"), client) if client else review(c.drop("most"))


def platform_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {"categories": platforms.categories(spark), "specs": platforms.specs(spark), "dedup_rules": platforms.dedup_rules(spark), "tids": platforms.tids(spark)}


def analyze_overlay(frames: DataFrame, width: int = fingerprints.GRID, height: int = fingerprints.GRID) -> DataFrame:
    return fingerprints.static_overlay(per_video(frames, "frames"), width, height)


def compare(videos: DataFrame, references: DataFrame, prints: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """(video_id, similarity, verdict, flags) of videos against up to eight references each: (video_id, reference_id)."""
    pairs = per_video(references, "references").join(videos.select("video_id").distinct(), "video_id").select(F.col("video_id").alias("a"), F.col("reference_id").alias("b"))
    s = fingerprints.similarity(pairs, per_video(prints, "frames")).groupBy(F.col("a").alias("video_id")).agg(F.max("similarity").alias("similarity"))
    measures = ("top_left", "top_right", "bottom_left", "bottom_right", "black_bar_ratio")
    d = s.join(overlay, "video_id", "left") if overlay is not None else s.select("*", *[F.lit(None).cast("double").alias(c) for c in measures])
    return fingerprints.verdict(d, books.DEDUP_THRESHOLDS).select("video_id", "similarity", "verdict", "flags")


def extract_storyboard(frames: DataFrame, conf: EngineConf = EngineConf()) -> DataFrame:
    return storyboard.shot_signals(frames, motion.scene_cuts(frames, conf), conf, True)


def plan_narrative(shots: DataFrame, template: str, style_id: str | None = None, target: float = 15.0, interleave: bool = False) -> DataFrame:
    within("target_seconds", target)
    book = books.narratives()
    if template not in book.templates:
        raise RequestError(f"unknown template: {template}")
    return narrative.plan(narrative.match_targets(shots, book, style_id), book, template, target, interleave)


def narrative_response(shots: DataFrame, template: str, style_id: str | None = None, target: float = 15.0, interleave: bool = False) -> DataFrame:
    """A row for each video with a match: matches (as many as a response may have), segments, their total and notes."""
    within("target_seconds", target)
    book = books.narratives()
    if template not in book.templates:
        raise RequestError(f"unknown template: {template}")
    return narrative.response(narrative.match_targets(shots, book, style_id), book, template, target, interleave, LIMITS["matches"][1])


def title_contexts(shots: DataFrame, style_id: str | None = None, target: float = 15.0, subject: str | None = None, action: str | None = None) -> DataFrame:
    """What titles are made of: the targets of each video's first matches, and who does what."""
    if (subject is None) != (action is None):
        raise RequestError("a subject and an action go together")
    m = narrative.title_targets(narrative.match_targets(shots, books.narratives(), style_id), LIMITS["title_matches"][1])
    return m.select(F.col("video_id").alias("item_id"), "target_ids", F.lit(style_id).cast("string").alias("style_hint"), F.lit(subject).cast("string").alias("subject"), F.lit(action).cast("string").alias("action"), F.lit(float(target)).alias("duration_seconds"))


def review_frames(candidates: DataFrame, frames: DataFrame) -> DataFrame:
    return motion.review_frames(candidates, frames, LIMITS["review_frames"][1])


def preview_titles(contexts: DataFrame, most: int = 3) -> DataFrame:
    return titles.titles(contexts, most)


class JobStore:
    """Job records as JSON files in one folder of the driver, replaced whole; a service's bookkeeping, not data."""

    def __init__(self, folder: str | Path):
        self.folder, self.lock = Path(folder), threading.Lock()
        self.folder.mkdir(parents=True, exist_ok=True)

    def _write(self, job: dict) -> dict:
        job["updated_at"] = datetime.now(UTC).isoformat()
        with self.lock:
            f, name = tempfile.mkstemp(dir=self.folder)
            with os.fdopen(f, "w", encoding="utf-8") as out:
                json.dump(job, out, ensure_ascii=False)
            os.replace(name, self.folder / f"{job['job_id']}.json")
        return job

    def create(self, request: dict) -> dict:
        now = datetime.now(UTC).isoformat()
        return self._write({"job_id": uuid.uuid4().hex, "status": "queued", "created_at": now, "request": request, "gate": "not_evaluated", "error": None})

    def get(self, job_id: str) -> dict:
        return json.loads((self.folder / f"{job_id}.json").read_text(encoding="utf-8"))

    def list(self) -> list[dict]:
        return sorted((json.loads(p.read_text(encoding="utf-8")) for p in self.folder.glob("*.json")), key=lambda j: j["created_at"], reverse=True)

    def move(self, job_id: str, status: str, **more) -> dict:
        job = self.get(job_id)
        if status not in NEXT[job["status"]]:
            raise RequestError(f"a job that is {job['status']} can't become {status}")
        return self._write(job | {"status": status} | more)

    def cancel(self, job_id: str) -> dict:
        return self.move(job_id, "cancelled")

    def retry(self, job_id: str) -> dict:
        return self.move(job_id, "queued", error=None)


def run_job(store: JobStore, job_id: str, frames: DataFrame, out: str, info: DataFrame | None = None) -> dict:
    """Runs the pipeline for a job and writes each stage's table below ``out``; a failure ends in the record."""
    store.move(job_id, "analyzing")
    try:
        for name, table in run_pipeline(frames, info=info).items():
            if store.get(job_id)["status"] == "cancelled":
                return store.get(job_id)
            table.write.mode("overwrite").parquet(f"{out}/{job_id}/{name}")
        return store.move(job_id, "completed", products=f"{out}/{job_id}")
    except Exception as e:
        return store.move(job_id, "failed", error=str(e)[:2000])


def main(argv: list[str] | None = None) -> None:
    """spark-submit lumaflow/api.py run QUERY --data DIR --out PATH | queries"""
    p = argparse.ArgumentParser(prog="lumaflow")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("queries")
    r = sub.add_parser("run")
    r.add_argument("query"), r.add_argument("--data", required=True), r.add_argument("--out", required=True)
    a = p.parse_args(argv)
    from .plans.registry import QUERIES

    if a.command == "queries":
        print("\n".join(sorted(QUERIES)))
        return
    spark = SparkSession.builder.getOrCreate()
    QUERIES[a.query](spark, a.data).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
