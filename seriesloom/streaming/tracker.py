"""Streams with state that timers end: two players followed through candidates, and rates with exponential weights.

Both need Spark's RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import kernels

_HALF = "x double, y double, frame long, half int"


class Follower(StatefulProcessor):
    """Candidates wait until the watermark has passed them; then a timer takes their frames in order. Another timer forgets a silent key.

    State: the rows that wait, and the last place of each half. Both are deleted `idle` seconds of event time after a
    key's last row.
    """

    def __init__(self, idle: int, key: str, knobs: dict[str, float]) -> None:
        self.idle, self.key, self.knobs = idle * 1000, key, knobs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, frame long, x double, y double, court double, size double")
        self.last = handle.getListState("last", _HALF)
        self.end = handle.getValueState("end", "ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        end = self.end.get()[0] if self.end.exists() else -1
        for p in rows:
            ms = (p["time"].astype("datetime64[ms]").astype("int64")).tolist()
            for t, r in zip(ms, p[["frame", "x", "y", "court", "size"]].itertuples(index=False), strict=True):
                self.waiting.appendValue((t, int(r.frame), float(r.x), float(r.y), float(r.court), float(r.size)))
            for t in set(ms):
                self.handle.registerTimer(t + 1)
            end = max(end, *ms)
        self.end.update((end,))
        self.handle.registerTimer(end + self.idle)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in rows if r[0] < now]
        if ready:
            prior = {h: (x, y, f) for x, y, f, h in self.last.get()} if self.last.exists() else {}
            by: dict[int, list[tuple]] = {}
            for r in ready:
                by.setdefault(r[1], []).append(tuple(r[2:]))
            frames = [(f, sorted(by[f])) for f in sorted(by)]
            chosen = kernels.track_two(frames, prior=prior, **self.knobs)
            out = [(key[0], f, side, *found[i][:2]) for (f, found), (_, *own) in zip(frames, chosen, strict=True) for side, i in zip(("top", "bottom"), own, strict=True) if i is not None]
            self.last.put([(float(x), float(y), int(f), h) for h, (x, y, f) in prior.items()])
            if len(ready) < len(rows):
                self.waiting.put([r for r in rows if r[0] >= now])
            else:
                self.waiting.clear()
            if out:
                yield pd.DataFrame(out, columns=[self.key, "frame", "player", "x", "y"])
        if self.end.exists() and now >= self.end.get()[0] + self.idle:
            self.waiting.clear()
            self.last.clear()
            self.end.clear()


def follow_players(stream: DataFrame, key: str, late: str, idle: int = 60, **knobs: float) -> DataFrame:
    """operators.folds.two_player_tracks on a stream of candidates (key, time, frame, x, y, court, size): key, frame, player, x, y.

    time is an event time that grows with the frame; a frame's candidates may come in any order and in several batches, `late`
    at most. The state of a key that has been silent for `idle` seconds is deleted.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, "time", *(F.col(c).cast(t).alias(c) for c, t in (("frame", "long"), ("x", "double"), ("y", "double"), ("court", "double"), ("size", "double"))))
    return rows.withWatermark("time", late).groupBy(key).transformWithStateInPandas(Follower(idle, key, knobs), f"{key} {kind}, frame long, player string, x double, y double", "append", "EventTime")


class Smoother(StatefulProcessor):
    """Carries the highest value, when it was reached and the smoothed rate of a key; a timer deletes them after a silence."""

    def __init__(self, share: float, idle: int, key: str) -> None:
        self.share, self.idle, self.key = share, idle * 1000, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "high double, at double, smoothed double, ms long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        high, at, smoothed, end = self.now.get() if self.now.exists() else (None, None, None, -1)
        out = []
        for r in pd.concat(list(rows)).sort_values("time").itertuples(index=False):
            t = r.time.replace(tzinfo=UTC).timestamp()
            end = max(end, int(t * 1000))
            if high is None:
                high, at = r.value, t
            elif r.value > high and t > at:
                rate = (r.value - high) / (t - at)
                smoothed = rate if smoothed is None else self.share * rate + (1 - self.share) * smoothed
                high, at = r.value, t
                out.append((key[0], r.time, rate, smoothed))
        self.now.update((float(high), float(at), smoothed, end))
        self.handle.registerTimer(end + self.idle)
        if out:
            yield pd.DataFrame(out, columns=[self.key, "time", "rate", "smoothed"])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.now.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.now.get()[3] + self.idle:
            self.now.clear()
        yield from ()


def smoothed_rates(stream: DataFrame, key: str, late: str, share: float, idle: int = 3600) -> DataFrame:
    """operators.scans.rates and weighted on a stream (key, time, value) that comes in the order of time: key, time, rate, smoothed.

    The state of a key is four numbers, deleted after `idle` seconds of event time without a row.
    """
    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, "time", F.col("value").cast("double").alias("value")).withWatermark("time", late)
    return rows.groupBy(key).transformWithStateInPandas(Smoother(share, idle, key), f"{key} {kind}, time timestamp, rate double, smoothed double", "append", "EventTime")
