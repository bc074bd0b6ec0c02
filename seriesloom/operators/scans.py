"""Linear recurrences as scans: within chunks of a key's order, then over the chunks' totals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from . import folds


def rates(df: DataFrame, key: str, time: str, value: str, chunk: float) -> DataFrame:
    """key, time and rate: each new highest value, by how much it is above the one before, over the time since that one was reached.

    A key's first row is where it starts. Rows of one time count as the highest of them. The highest value so far
    is a maximum within chunks of time and one over the chunks before, so no key is ordered as a whole.
    """
    rows = df.where(F.col(time).isNotNull() & F.col(value).isNotNull()).select(key, F.col(time).cast("double").alias("_t"), F.col(value).cast("double").alias("_v"))
    rows = rows.groupBy(key, "_t").agg(F.max("_v").alias("_v")).withColumn("_c", F.floor(F.col("_t") / chunk))
    inside = Window.partitionBy(key, "_c").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    tops = rows.groupBy(key, "_c").agg(F.max("_v").alias("_top")).withColumn("_before", F.max("_top").over(before))
    told = rows.join(tops.select(key, "_c", "_before"), [key, "_c"])
    # greatest() leaves nulls out, so only a key's first row has none before it
    told = told.withColumn("_high", F.greatest(F.max("_v").over(inside), "_before")).where(F.col("_high").isNull() | (F.col("_v") > F.col("_high")))
    told = written(told.select(key, "_c", "_t", "_v", "_high"))
    ends = told.groupBy(key, "_c").agg(F.max("_t").alias("_end")).withColumn("_before", F.max("_end").over(before))
    told = told.join(ends.select(key, "_c", "_before"), [key, "_c"])
    last = F.coalesce(F.lag("_t").over(Window.partitionBy(key, "_c").orderBy("_t")), F.col("_before"))
    told = told.withColumn("_last", last).where("_high is not null")
    return told.select(key, F.col("_t").alias(time), ((F.col("_v") - F.col("_high")) / (F.col("_t") - F.col("_last"))).alias("rate"))


def weighted(df: DataFrame, key: str, time: str, value: str, share: float, chunk: float, half: float | None = None) -> DataFrame:
    """key, time, value and smoothed: smoothed = w * value + (1 - w) * the one before; the first is the value itself.

    w is `share`; with a half life, 1 - 2 ** (-step / half), so that it follows irregular steps. A row takes what comes in, e, to
    a * e + b; such pairs are put together within chunks of time, then a pair for each chunk over the key's chunks.
    """
    rows = df.select(key, F.col(time).cast("double").alias("_t"), F.col(value).cast("double").alias("_v")).withColumn("_c", F.floor(F.col("_t") / chunk))
    w = F.lit(share)
    if half is not None:
        # the step into a chunk is from the last row of the chunks before
        ends = rows.groupBy(key, "_c").agg(F.max("_t").alias("_end"))
        ends = ends.withColumn("_before", F.max("_end").over(Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)))
        rows = rows.join(ends.select(key, "_c", "_before"), [key, "_c"])
        last = F.coalesce(F.lag("_t").over(Window.partitionBy(key, "_c").orderBy("_t")), F.col("_before"))
        w = F.coalesce(1 - F.pow(F.lit(2.0), (last - F.col("_t")) / half), F.lit(1.0))
    rows = rows.select(key, "_c", "_t", "_v", w.alias("_w"))
    kinds = dict(rows.dtypes)

    def together(part: pd.DataFrame) -> pd.DataFrame:
        a, b = np.empty(len(part)), np.empty(len(part))
        x, y = 1.0, 0.0
        for i, (v, s) in enumerate(zip(part["_v"].to_numpy(), part["_w"].to_numpy(), strict=True)):
            x, y = x * (1 - s), y * (1 - s) + s * v
            a[i], b[i] = x, y
        return part[[key, "_c", "_t", "_v"]].assign(_a=a, _b=b)

    pairs = written(folds.by_key(rows, [key, "_c"], ["_t"], together, f"{key} {kinds[key]}, _c {kinds['_c']}, _t double, _v double, _a double, _b double"))
    last = lambda c: F.max_by(c, "_t").alias(c)
    totals = pairs.groupBy(key, "_c").agg(last("_a"), last("_b"), F.min_by("_v", "_t").alias("_first"))

    def coming_in(part: pd.DataFrame) -> pd.DataFrame:
        # before a key's first value there is that value
        out, e = [], part["_first"].iloc[0]
        for a, b in zip(part["_a"], part["_b"], strict=True):
            out.append(e)
            e = a * e + b
        return part[[key, "_c"]].assign(_e=out)

    entering = folds.by_key(totals, [key], ["_c"], coming_in, f"{key} {kinds[key]}, _c {kinds['_c']}, _e double")
    both = pairs.join(entering, [key, "_c"])
    return both.select(key, F.col("_t").alias(time), F.col("_v").alias(value), (F.col("_a") * F.col("_e") + F.col("_b")).alias("smoothed"))
