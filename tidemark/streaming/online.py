"""Online forms: bars from an event stream, causal z-scores with state, and frozen alarms.

The z-score keeps per series the last ``smooth`` values, the row count, and count, mean and squared
deviations of the smoothed past: what a row is judged by is known before it arrives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "recent array<double>, rows long, n long, mean double, m2 double, firing boolean"
SCORED = "series_id string, ts timestamp, value double, z double, firing boolean, alarm boolean"


def hourly_bars(events: DataFrame, late: str = "1 day", size: str = "1 hour") -> DataFrame:
    """Mean value of each event type in each window; events later than ``late`` are dropped by the watermark."""
    bars = events.withWatermark("ts", late).groupBy(F.window("ts", size), F.col("event_type").alias("series_id"))
    return bars.agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n")).select("series_id", F.col("window.start").alias("ts"), "value", "n")


def advance(rows: pd.DataFrame, state: tuple, smooth: int, warm_up: int, tau: float) -> tuple[list[tuple], tuple]:
    """Scores rows in order of time and moves the state on."""
    recent, seen, n, mean, m2, was = state
    out = []
    for ts, value in zip(rows["ts"], rows["value"], strict=True):
        recent = [*recent, float("nan") if value is None else float(value)][-smooth:]
        known = [v for v in recent if v == v]
        s = sum(known) / len(known) if known else None
        z = None
        if s is not None and seen >= warm_up and n and (sd := (m2 / n) ** 0.5) > 0:
            z = (s - mean) / sd
        firing = z is not None and z > tau
        out.append((ts, value, z, firing, firing and not was))
        was, seen = firing, seen + 1
        if s is not None:
            n += 1
            delta = s - mean
            mean += delta / n
            m2 += delta * (s - mean)
    return out, (recent, seen, n, mean, m2, was)


def online_scores(bars: DataFrame, tau: float, smooth: int = 20, warm_up: int = 60) -> DataFrame:
    """bars(series_id, ts, value) with the causal z-score and the alarms of a frozen threshold; rows of a series come in order."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else ([], 0, 0, 0.0, 0.0, False)
        held = (list(held[0]), *held[1:])
        rows, held = advance(pd.concat(list(frames)).sort_values("ts"), held, smooth, warm_up, tau)
        state.update(held)
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["series_id", "ts", "value", "z", "firing", "alarm"])

    return bars.groupBy("series_id").applyInPandasWithState(step, SCORED, STATE, "append", GroupStateTimeout.NoTimeout)
