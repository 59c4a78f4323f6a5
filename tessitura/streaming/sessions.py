"""Streaming forms of the interval operators: sessions and run confirmation over event time."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def pause_sessions(events: DataFrame, key: str, at: str, pause: str, late: str) -> DataFrame:
    """Sessions of each key that end after ``pause`` without events; events over ``late`` behind are dropped."""
    s = F.session_window(at, pause).alias("session")
    return events.withWatermark(at, late).groupBy(key, s).agg(F.count("*").alias("n")).select(key, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "n")


def running_runs(events: DataFrame, key: str, order: str, flag: str) -> DataFrame:
    """For each micro-batch the length of the run of equal flags that each key is in; the state is one row for each key."""

    def step(k, frames, state):
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for value in rows[flag].astype(str):
            last, n = value, (n + 1 if value == last else 1)
        state.update((last, n))
        yield pd.DataFrame({key: [k[0]], "flag": [last], "run_length": [n]})

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, flag string, run_length long", "last string, n long", "update", GroupStateTimeout.NoTimeout)
