"""Engine settings; values become literals when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConf:
    # fixed values: thresholds of the signal definitions
    motion_frame_width: int = 320
    active_changed_pixel_ratio: float = 0.05
    abrupt_changed_pixel_ratio: float = 0.65
    abrupt_mean_absolute_difference: float = 0.35
    changed_pixel_threshold: float = 0.1
    scene_cut_threshold: float = 0.3
    signal_motion_window_count: int = 4
    signal_luminance_fps: float = 1.0
    signal_luminance_max_frames: int = 120
    luminance_spike_threshold: float = 0.12
    frames_per_shot: int = 3
    max_frames: int = 240
    target_duration_seconds: float = 15.0
    min_segment_seconds: float = 1.0
    # see functions/providers.py
    embedding_provider: str = "fake"
    # digits to which measures are shipped, rounded exactly; rates and shares of windows have three
    signal_digits: int = 4
    rate_digits: int = 3

    @classmethod
    def of(cls, spark: SparkSession) -> EngineConf:
        """Defaults, with session settings ``lumaflow.<name>`` put in."""
        found = {f.name: spark.conf.get(f"lumaflow.{f.name}", None) for f in fields(cls)}
        return replace(cls(), **{k: type(getattr(cls, k))(v) for k, v in found.items() if v is not None})
