"""Windows and joins over a band of the order: ± N positions, nearest, as-of, containment.

A band needs no more than its neighbourhood, so a key is cut into chunks of the order and every row is also
given to the chunks that its band reaches; no task holds a whole key there. `locate`, `as_of_both`,
`previous_known`, `beside`, `fill_linear`, `null_gaps` and `nearest_in_ring` have windows over a key, whose rows one task orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_halo(df: DataFrame, order: str, before: int, after: int, chunk: int) -> DataFrame:
    """df with `_part`, and `_own`: whether the row lies in that part or only near it."""
    o = F.col(order)
    parts = F.sequence(F.floor((o - before) / chunk), F.floor((o + after) / chunk))
    return df.withColumn("_part", F.explode(parts)).withColumn("_own", F.col("_part") == F.floor(o / chunk))


def band_aggregate(df: DataFrame, key: str, order: str, low: int, high: int, chunk: int | None = None, **aggregates: Column) -> DataFrame:
    """df with aggregates over the rows of its key whose order lies within [order + low, order + high]."""
    chunk = chunk or max(1000, 20 * (high - low + 1))
    w = Window.partitionBy(key, "_part").orderBy(order).rangeBetween(low, high)
    rows = with_halo(df, order, max(0, high), max(0, -low), chunk)
    rows = rows.withColumns({name: agg.over(w) for name, agg in aggregates.items()})
    return rows.where("_own").drop("_part", "_own")


def band_join(left: DataFrame, right: DataFrame, key: str, order: str, width: int, how: str = "inner", prefix: str = "r_") -> DataFrame:
    """Pairs of a key with |left.order - right.order| <= width; right's columns get a prefix. how: inner, left, left_semi or left_anti.

    Both sides are cut into bins as wide as the band; the right side's rows go to three, so the join is by equality
    of (key, bin) and the band is a filter on it.
    """
    step = max(1, width)
    r = right.select(*(F.col(c).alias(prefix + c) for c in right.columns))
    at = F.floor(F.col(prefix + order) / step)
    r = r.withColumn("_bin", F.explode(F.array(at - 1, at, at + 1)))
    near = (left[key] == r[prefix + key]) & (F.floor(left[order] / step) == r["_bin"]) & (F.abs(left[order] - r[prefix + order]) <= width)
    out = left.join(r, near, how)
    return out if how in ("left_semi", "left_anti") else out.drop("_bin")


def locate(points: DataFrame, intervals: DataFrame, key: str, order: str, start: str, end: str, index: str) -> DataFrame:
    """points with the index of the inclusive, disjoint interval each lies in, and the position within; null outside.

    As-of: the last interval that begins at or before the point, kept if it has not ended.
    """
    p = points.withColumn("_at", F.col(order)).withColumn("_kind", F.lit(1))
    i = intervals.select(F.col(key), F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.struct(F.col(index).alias("i"), F.col(start).alias("s"), F.col(end).alias("e")).alias("_iv"))
    both = p.unionByName(i, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_iv", F.last("_iv", ignorenulls=True).over(w)).where("_kind = 1")
    inside = F.col(order) <= F.col("_iv.e")
    return both.select(*points.columns, F.when(inside, F.col("_iv.i")).alias(index), F.when(inside, F.col(order) - F.col("_iv.s")).alias("local_frame"))


def as_of_both(df: DataFrame, key: str, order: str, value: Column, usable: Column) -> DataFrame:
    """df with the last usable value strictly before each row and the first at or after it: before, after."""
    w = Window.partitionBy(key).orderBy(order)
    v = F.when(usable, value)
    return df.withColumn("before", F.last(v, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "after", F.first(v, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    )


def previous_known(df: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the last non-null value of the rows before."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, True).over(w))


def nearest(left: DataFrame, right: DataFrame, key: str, order: str, name: str, width: int, default: Column | None = None) -> DataFrame:
    """left with the order of the nearest right row of the key within `width`; the lower one of two as near."""
    pairs = band_join(left, right, key, order, width, "left")
    gap = F.abs(F.col(order) - F.col(f"r_{order}"))
    best = F.min(F.when(F.col(f"r_{order}").isNotNull(), F.struct(gap.alias("d"), F.col(f"r_{order}").alias("f"))))
    out = pairs.groupBy(*left.columns).agg(best.alias("_b"))
    d = F.col("_b.d") if default is None else F.coalesce(F.col("_b.d"), default)
    return out.select(*left.columns, F.col("_b.f").alias(name), d.alias(f"{name}_distance"))


def nearest_in_ring(df: DataFrame, key: str, order: str, value: Column, snap: int, name: str) -> DataFrame:
    """df, dense in order, with the value found first at 0, -1, +1, -2, +2, ... up to snap positions away."""
    w = Window.partitionBy(key).orderBy(order)
    ring = [value] + [f(value, d).over(w) for d in range(1, snap + 1) for f in (F.lag, F.lead)]
    return df.withColumn(name, F.coalesce(*ring))


def beside(left: DataFrame, right: DataFrame, key: str, at: str, order: str) -> DataFrame:
    """left with the greatest order of the key's right rows at or below `at`, and the least at or above it: below, above."""
    points = right.select(key, F.col(order).cast("double").alias("_at"), F.col(order).alias("_v"))
    both = left.withColumn("_at", F.col(at).cast("double")).withColumn("_left", F.lit(True)).unionByName(points, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at")
    both = both.withColumn("below", F.max("_v").over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("above", F.min("_v").over(w.rangeBetween(0, Window.unboundedFollowing)))
    return both.where("_left").drop("_at", "_v", "_left")


def contained(points: DataFrame, hits: DataFrame, key: str, order: str) -> DataFrame:
    """Points between consecutive hits of a key, ends included: lo, hi (the hits) and the point's columns.

    A point is located in the gap that begins at or before it; one on a hit also ends the gap before, which it meets by equality.
    """
    w = Window.partitionBy(key).orderBy(order)
    gaps = hits.select(key, F.col(order).alias("lo"), F.lead(order).over(w).alias("hi"), F.lead(order, 2).over(w).alias("_more")).where("hi is not null")
    inside = locate(points, gaps.withColumn("_gap", F.struct("lo", "hi")), key, order, "lo", "hi", "_gap").where("_gap is not null")
    names = points.columns
    inside = inside.select(*names, "_gap.lo", "_gap.hi")
    ends = gaps.where("_more is not null").select(F.col(key).alias("_k"), "lo", "hi")
    return inside.unionByName(points.join(ends, (F.col(key) == F.col("_k")) & (F.col(order) == F.col("hi"))).select(*names, "lo", "hi"))


def fill_linear(df: DataFrame, key: str, order: str, value: str, name: str = "filled") -> DataFrame:
    """df with nulls of value between two known ones filled on the straight line between them."""
    w = Window.partitionBy(key).orderBy(order)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("f"), F.col(value).alias("v")))
    a = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = df.withColumn("_a", a).withColumn("_b", b)
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(order) - F.col("_a.f")) / F.nullif(F.col("_b.f") - F.col("_a.f"), F.lit(0))
    return rows.withColumn(name, F.coalesce(F.col(value), line)).drop("_a", "_b")


def null_gaps(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each run of null values: key, start, end, n, and the known values and positions on both sides (null at an edge)."""
    w = Window.partitionBy(key).orderBy(order)
    missing = F.col(value).isNull()
    rows = df.withColumn("_g", F.sum((~missing).cast("int")).over(w))
    rows = rows.withColumn("_l", F.lag(F.struct(F.col(order).alias("f"), F.col(value).alias("v"))).over(w))
    rows = rows.withColumn("_r", F.lead(F.struct(F.col(order).alias("f"), F.col(value).alias("v"))).over(w))
    out = rows.where(missing).groupBy(key, "_g").agg(
        F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"), F.min_by("_l", order).alias("l"), F.max_by("_r", order).alias("r")
    )
    return out.select(key, "start", "end", "n", F.col("l.v").alias("left_value"), F.col("r.v").alias("right_value"))
