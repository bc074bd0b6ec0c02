"""Runs of rows (gaps and islands) and interval algebra.

Windows over a whole key put all of its rows in one task. Where the result is local, keys are cut into chunks of
their order, each chunk is reduced to few rows, and only these meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of a chunk, in units of the order column.
CHUNK = 100_000


def mask_runs(df: DataFrame, key: str, order: str, mask: Column, least: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Maximal runs of consecutive whole-numbered positions where mask holds: key, start_frame, end_frame, n_frames.

    Runs are found within chunks of the order and joined where one ends and the next begins side by side, so a hot key is
    spread over its chunks. A missing position ends a run; a null mask is false.
    """
    rows = df.where(F.coalesce(mask, F.lit(False))).select(key, F.col(order).cast("long").alias("frame"))
    rows = rows.withColumn("part", F.floor(F.col("frame") / chunk))
    w = Window.partitionBy(key, "part").orderBy("frame")
    local = rows.withColumn("island", F.col("frame") - F.row_number().over(w))
    local = local.groupBy(key, "part", "island").agg(F.min("frame").alias("a"), F.max("frame").alias("z"))
    # a chunk leaves at most as many rows as it has runs
    w = Window.partitionBy(key).orderBy("a")
    new = F.coalesce(F.col("a") != F.lag("z").over(w) + 1, F.lit(True))
    joined = local.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    out = joined.groupBy(key, "run").agg(F.min("a").alias("start_frame"), F.max("z").alias("end_frame"))
    out = out.withColumn("n_frames", F.col("end_frame") - F.col("start_frame") + 1)
    return out.where(F.col("n_frames") >= least).drop("run")


def label_runs(df: DataFrame, key: str, order: str, label: str, gap: int | None = 1, weight: str | None = None) -> DataFrame:
    """Runs of rows with the same non-null label: a row of another label, or a step over `gap` in the order, ends one.

    Returns key, label, f0, f1, n, and of the weight its mean, peak and the weighted centre.
    """
    rows = df.where(F.col(label).isNotNull())
    w = Window.partitionBy(key).orderBy(order)
    new = F.col(label) != F.lag(label).over(w)
    if gap is not None:
        new = new | (F.col(order) - F.lag(order).over(w) > gap)
    rows = rows.withColumn("_run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w))
    c = F.col(weight) if weight else F.lit(1.0)
    return rows.groupBy(key, "_run").agg(
        F.first(label).alias(label), F.min(order).alias("f0"), F.max(order).alias("f1"), F.count("*").alias("n"),
        F.avg(c).alias("mean_conf"), F.max(c).alias("peak"),
        F.try_divide(F.sum(F.col(order) * c), F.sum(c)).alias("center"),
    ).drop("_run")


def merge_intervals(df: DataFrame, key: str, start: str, end: str, gap: float = 0) -> DataFrame:
    """Unions intervals that touch or whose gap is at most `gap`: key, start, end and how many were merged."""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(w)
    rows = df.select(key, start, end).withColumn("_reach", reach)
    new = F.coalesce(F.col(start) > F.col("_reach") + gap, F.lit(True)).cast("int")
    rows = rows.withColumn("_new", new)
    rows = rows.withColumn("_island", F.sum("_new").over(Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def complement(merged: DataFrame, key: str, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """What disjoint intervals leave of [low, high], by key; low and high are columns or literals."""
    w = Window.partitionBy(key).orderBy(start)
    rows = merged.select(
        key, F.col(end).alias("a"), F.coalesce(F.lead(start).over(w), high).alias("z"), F.col(start).alias("s"),
        F.row_number().over(w).alias("i"), low.alias("lo"), high.alias("hi"),
    )
    parts = F.filter(
        F.array(F.when(F.col("i") == 1, F.struct(F.col("lo").alias("a"), F.col("s").alias("z"))), F.struct("a", "z")),
        lambda p: p.isNotNull() & (p["z"] > p["a"]),
    )
    return rows.select(key, F.explode(parts).alias("p")).select(key, F.col("p.a").alias(start), F.col("p.z").alias(end))


def collapse_equal(df: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """The first row of each run of equal values, in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = df.withColumn("_v", value).withColumn("_before", F.lag("_v").over(w)).withColumn("_n", F.row_number().over(w))
    return rows.where((F.col("_n") == 1) | ~F.col("_v").eqNullSafe(F.col("_before"))).drop("_v", "_before", "_n")


def dead_rows(df: DataFrame, key: str, order: str, score: Column, serve: Column, is_break: Column, least: int = 2) -> DataFrame:
    """Rows of a run of equal scores, of `least` rows and a break's score, that come before the run's last serve."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("_s", score).withColumn("_serve", serve).withColumn("_break", is_break)
    rows = rows.withColumn("_new", F.coalesce(~F.col("_s").eqNullSafe(F.lag("_s").over(w)), F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(w))
    run = Window.partitionBy(key, "_run")
    rows = rows.withColumn("_n", F.count("*").over(run)).withColumn("_last", F.max(F.when(F.col("_serve"), F.col(order))).over(run))
    keep = (F.col("_n") >= least) & F.col("_break") & (F.col(order) < F.col("_last"))
    return rows.where(keep).drop("_s", "_serve", "_break", "_new", "_run", "_n", "_last")


def changes(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, order and d, how far the value is from that of the row before; null for a key's first."""
    w = Window.partitionBy(key).orderBy(order)
    return df.select(key, order, F.abs(F.col(value) - F.lag(value).over(w)).alias("d"))
