"""A monitor of conversation streams: windowed scores, and a running mean per conversation that raises alerts.

State per conversation is three numbers; it times out after a gap, so it is bounded by
the conversations of that span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sondar.probes.linear import LinearModel


def scored(stream: DataFrame, model: LinearModel) -> DataFrame:
    """The stream (ts, key, vec, ...) with (logit, score), a native expression."""
    return model.transform(stream)


def windowed_scores(stream: DataFrame, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """(window, key, n, mean, high) of (ts, key, score); rows later than `late` are dropped."""
    windows = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        stream.withWatermark("ts", late)
        .groupBy(windows.alias("window"), "key")
        .agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.max("score").alias("high"))
    )


def sessions(stream: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """(session, key, n, high) of sessions that end after a gap."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "key").agg(F.count("*").alias("n"), F.max("score").alias("high"))


def alerts(stream: DataFrame, alpha: float = 0.5, threshold: float = 0.8, late: str = "10 minutes", gap_ms: int = 1_800_000) -> DataFrame:
    """(key, ts, level): each time a conversation's exponential mean of scores rises above the threshold."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        level, above, latest = state.get if state.exists else (0.0, False, 0)
        out = []
        rows = pd.concat(list(frames)).sort_values("ts")
        for ts, score in zip(rows.ts, rows.score):
            level = (1 - alpha) * level + alpha * score
            if level > threshold and not above:
                out.append((key[0], ts, level))
            above = level > threshold
            latest = max(latest, int(ts.timestamp() * 1000))
        state.update((level, above, latest))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + gap_ms)
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "level"])

    key_type = stream.schema["key"].dataType.simpleString()
    return (
        stream.withWatermark("ts", late)
        .groupBy("key")
        .applyInPandasWithState(step, f"key {key_type}, ts timestamp, level double", "level double, above boolean, latest long", "append", GroupStateTimeout.EventTimeTimeout)
    )
