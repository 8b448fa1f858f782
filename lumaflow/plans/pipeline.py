"""From frames to clip plans: every stage's table, for a whole batch of videos."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..conf import EngineConf
from ..functions import books
from ..functions.rules import Narrative, RuleBook
from ..operators import motion, narrative, planner, storyboard, styles


def run_pipeline(frames: DataFrame, style: RuleBook | None = None, story: Narrative | None = None, template: str = "hook_first", conf: EngineConf = EngineConf(), info: DataFrame | None = None) -> dict[str, DataFrame]:
    """signals, candidates, matches, referrals, shots, target_matches, clips and timeline, all lazy, by name.

    A caller writes those it wants to keep; stages that share frames share their scan and shuffle. ``info`` (as the
    report source gives it) fills the signals that frames don't have.
    """
    style, story = style or books.styles(), story or books.narratives()
    out = {"signals": motion.video_signals(frames, conf, info, True), "candidates": motion.candidates(frames, conf, True)}
    out["matches"] = styles.evaluate(out["signals"], style)
    out["referrals"] = styles.referrals(out["matches"], style)
    out["clips"] = planner.plan_clips(out["candidates"], conf.target_duration_seconds, conf.min_segment_seconds)
    out["shots"] = storyboard.shot_signals(frames, motion.scene_cuts(frames, conf), conf, True)
    out["target_matches"] = narrative.match_targets(out["shots"], story)
    out["timeline"] = narrative.plan(out["target_matches"], story, template, conf.target_duration_seconds)
    return out


def _no_review(row: dict) -> str:
    return '{"verdict": "not_evaluated"}'


def review(windows: DataFrame, client: Callable[[dict], str] = _no_review) -> DataFrame:
    """Windows with an outside reviewer's answer. The filter to the windows it may see stands before this step, so that
    no plan calls it for others. Without a client every answer says that nothing was evaluated."""

    def run(call: Callable[[dict], str], it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(answer=[call(r) for r in pdf.to_dict("records")])

    return windows.mapInPandas(partial(run, client), windows.withColumn("answer", F.lit("")).schema)
