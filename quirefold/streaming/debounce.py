"""Debounced writes on a stream: the last value of each burst once the quiet period has passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str, ts: str, value: str, quiet: str = "400 milliseconds", late: str = "1 minute") -> DataFrame:
    """(key, burst_end, value) of a streaming DataFrame, in append mode.

    Session windows close after the quiet period; of values at one time the greater counts; the watermark bounds the state, events later than it are dropped.
    """
    windows = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, quiet).alias("burst"))
    last = windows.agg(F.max(ts).alias("burst_end"), F.max_by(value, F.struct(ts, value)).alias("value"))
    return last.select(key, "burst_end", "value")
