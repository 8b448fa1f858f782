"""Schemas of the engine's tables and their versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Version names of the wire formats.
VERSIONS = {
    "signals": "signals-1.0", "l2_review": "l2-review-1.0", "rules_eval": "rules-eval-1.0", "gatekeeper": "gatekeeper-1.0",
    "clip_plan": "clip-plan-1.0", "clip_render": "clip-render-1.0", "dedup": "dedup-1.0", "dedup_compare": "dedup-compare-1.0",
    "storyboard": "storyboard-1.0", "narrative_plan": "narrative-plan-1.0", "title_preview": "title-preview-1.0",
    "style_profiles": "style-profiles-1.0", "platform_profiles": "platform-profiles-1.0", "narrative_targets": "narrative-targets-1.0",
}

MEDIA_INFO = "video_id STRING, path STRING, duration_seconds DOUBLE, width INT, height INT, fps DOUBLE, has_audio BOOLEAN"
FRAMES = "video_id STRING, ts DOUBLE, height INT, width INT, gray BINARY"
SCENE_CUTS = "video_id STRING, ts DOUBLE"
SIGNALS = (
    "video_id STRING, shot_cut_rate_per_min DOUBLE, scene_count INT, mean_motion_intensity DOUBLE, peak_motion_intensity DOUBLE, "
    "continuous_motion_window_ratio DOUBLE, audio_mean_volume_db DOUBLE, luminance_spike_ratio DOUBLE, duration_seconds DOUBLE, "
    "width INT, height INT, fps DOUBLE"
)
SHOTS = (
    "video_id STRING, index INT, start_seconds DOUBLE, end_seconds DOUBLE, duration_seconds DOUBLE, sampled_frames INT, "
    "mean_motion_intensity DOUBLE, peak_motion_intensity DOUBLE, luminance_spike_ratio DOUBLE, luminance_delta_max DOUBLE"
)


def strict(df: DataFrame, ddl: str) -> DataFrame:
    """The rows in exactly this schema; columns beyond it are an error."""
    schema = T.StructType.fromDDL(ddl)
    if extra := set(df.columns) - set(schema.names):
        raise ValueError(f"unknown columns: {sorted(extra)}")
    return df.to(schema)
