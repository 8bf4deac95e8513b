"""Track features over a stream of object events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_activity(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and range of values per key and tumbling window; rows later than `late` are dropped by the watermark.

    Works on a stream and, without the watermark's effect, on a table.
    """
    told = events.withWatermark(time, late) if events.isStreaming else events
    return told.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high")).select(F.col("w.start").alias("start"), key, "n", "mean", "low", "high")


def running_path(events: DataFrame, key: str, time: str, place: str) -> DataFrame:
    """Running path length of each key's one-dimensional place over a stream, as state kept per key."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, path, seen = state.get if state.exists else (None, 0.0, 0)
        rows = pd.concat(list(frames)).sort_values(time)
        for value in rows[place].to_numpy(dtype=float):
            path += 0.0 if last is None else abs(value - last)
            last, seen = value, seen + 1
        state.update((last, path, seen))
        yield pd.DataFrame({key: [k[0]], "points": [seen], "path": [path]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, points long, path double", "last double, path double, seen long", "update", GroupStateTimeout.NoTimeout)
