"""Alerts for runs that fall silent, while the stream is running.

Each run keeps its open stretches of activity: start, last event and number of events. A timer in event time stands at the end of the
first of them plus the limit; an event in time moves it, and when the watermark passes it, the alert goes out. A late event inside
the watermark's delay joins the stretches on both sides of it, as it does in the batch form. A run that resumes after an alert
opens a new stretch. State is bounded by the stretches that fit into the delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .jobs import STALE_SECONDS, active_sessions

DELAY_SECONDS = 600
_ALERT = "run_id bigint, started_us bigint, last_us bigint, event_count bigint"


def joined(stretches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(start, last, events) with those put together that lie at most the gap apart."""
    out: list[tuple[int, int, int]] = []
    for start, last, n in sorted(stretches):
        if out and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((start, last, n))
    return out


def _timer(gap: int):
    due = lambda last: (last + gap) // 1000 + 1  # the millisecond the watermark has to pass

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stretches = list(zip(*state.get)) if state.exists else []
        if not state.hasTimedOut:
            for rows in batches:
                stretches += [(int(t), int(t), 1) for t in rows["us"]]
        stretches = joined(stretches, gap)
        mark = state.getCurrentWatermarkMs()
        silent = [s for s in stretches if due(s[1]) < mark]
        active = [s for s in stretches if due(s[1]) >= mark]
        if active:
            state.update(tuple([int(x) for x in column] for column in zip(*active)))
            state.setTimeoutTimestamp(max(min(due(s[1]) for s in active), mark + 1))
        elif state.exists:
            state.remove()
        if silent:
            yield pd.DataFrame([(key[0], *s) for s in silent], columns=["run_id", "started_us", "last_us", "event_count"])

    return watch


def silence_alerts(events: DataFrame, gap_seconds: int = STALE_SECONDS, delay_seconds: int = DELAY_SECONDS) -> DataFrame:
    """(run_id, started_at, last_ts, alert_at, event_count): one row per stretch of a run (run_id, ts) that a silence of the limit has ended.

    On a table: the stretches that the stream would have reported when it had seen all rows, so those that ended before the last
    event less the delay.
    """
    if not events.isStreaming:
        end = events.agg((F.floor(F.unix_micros(F.max("ts")) / 1000) - delay_seconds * 1000).alias("mark_"))
        rows = active_sessions(events, gap_seconds, None).join(F.broadcast(end))  # one-row side
        rows = rows.where(F.floor((F.unix_micros("last_ts") + gap_seconds * 1_000_000) / 1000) + 1 < F.col("mark_"))
        return rows.select("run_id", "started_at", "last_ts", F.col("stale_at").alias("alert_at"), "event_count")
    rows = events.withWatermark("ts", f"{delay_seconds} seconds").select("run_id", "ts", F.unix_micros("ts").alias("us"))
    state = "starts array<bigint>, lasts array<bigint>, counts array<bigint>"
    out = rows.groupBy("run_id").applyInPandasWithState(_timer(gap_seconds * 1_000_000), _ALERT, state, "append", GroupStateTimeout.EventTimeTimeout)
    at = lambda c: F.timestamp_micros(c)
    return out.select("run_id", at(F.col("started_us")).alias("started_at"), at(F.col("last_us")).alias("last_ts"), at(F.col("last_us") + gap_seconds * 1_000_000).alias("alert_at"), "event_count")
