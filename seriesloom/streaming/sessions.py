"""Streams: sessions by gap, windows, and a tracker with state that expires."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_runs(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Runs of events of a key that follow each other within the gap: key, start, end, n."""
    rows = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def chunk_counts(stream: DataFrame, key: str, time: str, size: str, slide: str | None, late: str, value: str) -> DataFrame:
    """Fixed or sliding chunks of time: key, start, n and the value's mean."""
    rows = stream.withWatermark(time, late).groupBy(F.window(time, size, slide).alias("w"), key)
    return rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(key, F.col("w.start").alias("start"), "n", "mean")


def nearest_track(stream: DataFrame, key: str, frame: str, x: str, reach: float = 50.0, forget: int = 5) -> DataFrame:
    """Follows the value nearest to the last one of its key, within `reach` times the frames since; after `forget` frames
    without one the track begins anew. State is one position for each key."""
    kind = dict(stream.dtypes)

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last: Any = state.get if state.exists else None
        out = []
        for f, rows in pd.concat(list(parts)).sort_values([frame, x]).groupby(frame):
            if last is not None and f - last[0] > forget:
                last = None
            values = rows[x].to_numpy()
            if last is None:
                chosen = values[-1]
            else:
                d = abs(values - last[1])
                if d.min() > reach * max(1, f - last[0]):
                    continue
                chosen = values[d.argmin()]
            last = (int(f), float(chosen))
            out.append((k[0], int(f), float(chosen)))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(out, columns=[key, frame, x])

    schema = f"{key} {kind[key]}, {frame} long, {x} double"
    return stream.select(key, F.col(frame).cast("long").alias(frame), F.col(x).cast("double").alias(x)).groupBy(key).applyInPandasWithState(
        step, schema, "f long, x double", "append", GroupStateTimeout.NoTimeout
    )
