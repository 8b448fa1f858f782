"""Job states from event logs, as a batch table and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: States, and to which each may go.
NEXT = {
    None: {"queued"},
    "queued": {"analyzing", "cancelled", "failed"},
    "analyzing": {"reviewing", "rendering", "completed", "failed", "cancelled"},
    "reviewing": {"rendering", "completed", "failed", "cancelled"},
    "rendering": {"completed", "failed", "cancelled"},
    "failed": {"queued"},
    "cancelled": {"queued"},
    "completed": set(),
}


def step(state: str | None, event: str) -> str | None:
    """The state after an event; events that the state doesn't allow change nothing."""
    return event if event in NEXT[state] else state


def latest(events: DataFrame, key: str, order: list, value: str) -> DataFrame:
    """(key, value, n): each job's last event and the number of events."""
    return events.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count("*").alias("n"))


def settled(events: DataFrame, order: list) -> DataFrame:
    """(job_id, status, n_events) of a table of (job_id, event, ...): each job's events in order, by the rules of NEXT. A job's log is one array; status is null until it was queued."""
    first = "none"
    allowed = F.create_map(*[x for state, to in NEXT.items() for x in (F.lit(state or first), F.array(*[F.lit(t) for t in sorted(to)]).cast("array<string>"))])
    go = lambda state, event: F.when(F.array_contains(F.element_at(allowed, state), event), event).otherwise(state)
    log = events.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(*order, "event"))).alias("log"))
    status = F.aggregate("log", F.lit(first), lambda state, e: go(state, e["event"]))
    return log.select("job_id", F.nullif(status, F.lit(first)).alias("status"), F.size("log").cast("long").alias("n_events"))


def states(events: DataFrame) -> DataFrame:
    """Stream of (job_id, status, n_events) from a stream of (job_id, at, event), by the rules of NEXT."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, n = state.get if state.exists else (None, 0)
        for pdf in batches:
            for event in pdf.sort_values("at")["event"]:
                status, n = step(status, event), n + 1
        state.update((status, n))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "n_events": [n]})

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id string, status string, n_events long", "status string, n long", "update", GroupStateTimeout.NoTimeout)


def live_motion(frames: DataFrame, late: str = "10 seconds", length: str = "3 seconds", active: float = 0.05) -> DataFrame:
    """Windows of a live stream of (video_id, ts, changed_ratio): mean and peak change, and whether all of it was active."""
    w = frames.withWatermark("ts", late).groupBy("video_id", F.window("ts", length))
    return w.agg(F.count("*").alias("samples"), F.avg("changed_ratio").alias("mean_ratio"), F.max("changed_ratio").alias("peak_ratio"), F.bool_and(F.col("changed_ratio") >= active).alias("continuous"))


def without_repeats(uploads: DataFrame, days: int = 90) -> DataFrame:
    """First uploads of a stream of (digest, ts): repeats within the window are dropped."""
    return uploads.withWatermark("ts", f"{days} days").dropDuplicatesWithinWatermark(["digest"])


