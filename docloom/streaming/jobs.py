"""Job tracking under Structured Streaming (W1, W2, W4): the same transitions with state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("completed", "failed", "cancelled")
# Status after an action in a status; anything else changes nothing.
MOVES = {
    ("new", "submit"): "queued", ("queued", "start"): "running", ("queued", "cancel"): "cancelled", ("running", "cancel"): "running!",
    ("running", "finish"): "completed", ("running", "fail"): "failed", ("running!", "finish"): "cancelled", ("running!", "fail"): "cancelled",
    ("running!", "start"): "cancelled",
}


def track(events: DataFrame, watermark: str = "1 hour", retention_ms: int = 3_600_000) -> DataFrame:
    """A stream of (job_id, ts, event_id, action) -> updates (job_id, status, n_events). State goes after the retention."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        status, n = state.get if state.exists else ("new", 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for action in rows["action"]:
            status, n = MOVES.get((status, action), status), n + 1
        state.update((status, n))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["ts"].max().timestamp() * 1000)) + retention_ms)
        yield pd.DataFrame({"job_id": [key[0]], "status": [status.rstrip("!")], "n_events": [n]})

    return (
        events.withWatermark("ts", watermark)
        .groupBy("job_id")
        .applyInPandasWithState(update, "job_id long, status string, n_events long", "status string, n long", "update", GroupStateTimeout.EventTimeTimeout)
    )


def job_events(events: DataFrame) -> DataFrame:
    """The event table as job actions: users are jobs, the event number picks the action."""
    actions = F.array(*[F.lit(a) for a in ("submit", "start", "finish", "cancel", "fail")])
    action = F.element_at(actions, (F.col("event_id") % 5 + 1).cast("int"))
    return events.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", action.alias("action"))
