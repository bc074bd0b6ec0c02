"""Table functions for SQL: runs of a label, and windows between hits. register() names them in a session.

    select * from label_runs(table(frames) partition by (seg) order by (frame), 'seg', 'frame', 'label', 'y', 1)
    select * from hit_windows(table(frames) partition by (seg) order by (frame), 'seg', 'frame', 'hit', 5, 15, 2)

Spark deals and sorts the partitions; a function sees one key's rows in order. Its result takes the key's and the
label's types from the table it is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _kind(table: AnalyzeArgument, name: AnalyzeArgument) -> T.DataType:
    if not table.isTable:
        raise ValueError("the first argument must be a table")
    if name.value not in table.dataType.names:
        raise ValueError(f"the table has no column {name.value!r}")
    return table.dataType[name.value].dataType


class LabelRuns:
    """label_runs(table, key, order, label, weight, gap): see operators.runs.label_runs."""

    def __init__(self) -> None:
        self.run: list | None = None
        self.key: Any = None

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, label: AnalyzeArgument, weight: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        out = T.StructType().add("key", _kind(table, key)).add("label", _kind(table, label)).add("f0", _kind(table, order)).add("f1", _kind(table, order))
        _kind(table, weight)
        return AnalyzeResult(out.add("n", T.LongType()).add("mean_conf", T.DoubleType()).add("peak", T.DoubleType()).add("center", T.DoubleType()))

    def eval(self, row: Row, key: str, order: str, label: str, weight: str, gap: int) -> Iterator[tuple]:
        name, at, w = row[label], row[order], row[weight]
        if name is None:
            return
        if self.run is not None and (self.run[0] != name or at - self.run[2] > gap):
            yield self._told()
            self.run = None
        self.key = row[key]
        if self.run is None:
            self.run = [name, at, at, 0, 0.0, None, 0.0, 0]  # label, f0, f1, rows, weight, peak, weighted places, weights
        self.run[2], self.run[3] = at, self.run[3] + 1
        if w is not None:
            w = float(w)
            self.run[4:] = [self.run[4] + w, w if self.run[5] is None else max(self.run[5], w), self.run[6] + at * w, self.run[7] + 1]

    def _told(self) -> tuple:
        label, f0, f1, n, total, peak, places, weights = self.run
        return self.key, label, f0, f1, n, total / weights if weights else None, peak, places / total if total else None

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            yield self._told()


class HitWindows:
    """hit_windows(table, key, order, hit, step, most, after): for each row where hit holds, from the hit before it to `after` behind the next.

    Without a neighbour `step`, and never more than `most` away; within 1 and the key's last row.
    """

    def __init__(self) -> None:
        self.hits: list = []
        self.key = self.last = None

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, order: AnalyzeArgument, hit: AnalyzeArgument, step: AnalyzeArgument, most: AnalyzeArgument, after: AnalyzeArgument) -> AnalyzeResult:
        at = _kind(table, order)
        if not isinstance(_kind(table, hit), T.BooleanType):
            raise ValueError("hit must be a boolean column")
        return AnalyzeResult(T.StructType().add("key", _kind(table, key)).add("frame", at).add("win_start", at).add("win_end", at))

    def eval(self, row: Row, key: str, order: str, hit: str, step: int, most: int, after: int) -> Iterator[tuple]:
        self.key, self.last, self.knobs = row[key], row[order], (step, most, after)
        if row[hit]:
            self.hits.append(row[order])
        yield from ()

    def terminate(self) -> Iterator[tuple]:
        if not self.hits:
            return
        step, most, after = self.knobs
        for before, f, behind in zip([None, *self.hits], self.hits, [*self.hits[1:], None], strict=False):
            start = f - step if before is None else before
            end = f + step if behind is None else behind + after
            of = type(f)
            yield self.key, f, of(max(1, start, f - most)), of(min(self.last + 1, end, f + most))


def register(spark: SparkSession) -> None:
    """Names the functions in a session's SQL."""
    # with Arrow each call's rows would be a table of their own
    spark.udtf.register("label_runs", udtf(LabelRuns, useArrow=False))
    spark.udtf.register("hit_windows", udtf(HitWindows, useArrow=False))
