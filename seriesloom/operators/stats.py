"""Thresholds, robust rejection and per-cell composites."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def otsu3(df: DataFrame, value: Column, bins: int = 256) -> DataFrame:
    """One row, threshold: the upper border of the first of three classes of log10(max(value, 1)) with the most variance between them.

    With fewer than three occupied bins it is the largest value plus one; with no rows, null. The histogram has
    `bins` rows whatever the input, and its pairs are what is searched.
    """
    x = F.log10(F.greatest(value, F.lit(1.0)))
    rows = df.where(value.isNotNull()).select(value.alias("v"), x.alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("v").alias("top"))
    step = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / step), F.lit(bins - 1))).otherwise(0)
    counts = rows.join(F.broadcast(ends)).groupBy(at.cast("int").alias("i")).count()  # ends has one row
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("i"))
    h = spine.join(F.broadcast(counts), "i", "left").join(F.broadcast(ends)).withColumn("c", F.coalesce("count", F.lit(0)))
    w = Window.orderBy("i")  # `bins` rows
    total = F.sum("c").over(Window.partitionBy())
    h = h.withColumn("p", F.try_divide(F.col("c"), total)).withColumn("ctr", F.col("lo") + (F.col("i") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    h = h.withColumn("wt", F.sum("p").over(w)).withColumn("m", F.sum(F.col("p") * F.col("ctr")).over(w))
    h = h.withColumn("mt", F.sum(F.col("p") * F.col("ctr")).over(Window.partitionBy())).withColumn("used", F.sum((F.col("c") > 0).cast("int")).over(Window.partitionBy()))
    a = h.select("i", "ctr", "wt", "m", "mt", "used", "top")
    b = h.select(F.col("i").alias("j"), F.col("wt").alias("wz"), F.col("m").alias("mz"))
    w2, w3 = F.col("wz") - F.col("wt"), 1 - F.col("wz")
    between = (
        F.col("wt") * F.pow(F.try_divide("m", "wt") - F.col("mt"), F.lit(2))
        + w2 * F.pow(F.try_divide(F.col("mz") - F.col("m"), w2) - F.col("mt"), F.lit(2))
        + w3 * F.pow(F.try_divide(F.col("mt") - F.col("mz"), w3) - F.col("mt"), F.lit(2))
    )
    pairs = a.join(F.broadcast(b), (F.col("j") > F.col("i")) & (F.col("j") <= bins - 2) & (F.col("wt") > 0) & (w2 > 0) & (w3 > 0))
    best = pairs.agg(F.max_by("ctr", F.struct(between.alias("v"), (-F.col("i")).alias("a"), (-F.col("j")).alias("b"))).alias("ctr"), F.max("used").alias("used"))
    return ends.join(best).select(F.when((F.col("used") >= 3) & F.col("ctr").isNotNull(), F.pow(F.lit(10.0), "ctr")).otherwise(F.col("top") + 1).alias("threshold"))


def quantiles(df: DataFrame, value: str, shares: list[float], bins: int = 1024, most: int = 10_000) -> list[float]:
    """The values at shares of the order, on a line between two neighbours; empty if there are no values. Nulls are left out.

    No sort: counts in bins tell in which bin a rank lies, whose range is cut into bins again until it holds at most `most`
    values or only one that is repeated. The counts of `bins` bins, and at the end those few values, come to the driver.
    """
    v = F.col(value).cast("double")
    rows = df.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    n, lo, hi = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return []
    places = [q * (n - 1) for q in shares]
    found: dict[int, float] = {}

    def look(ranks: list[int], lo: float, hi: float, before: int) -> None:
        """ranks, of values from lo to hi, with `before` values under lo."""
        width = (hi - lo) / bins
        if lo == hi or lo + width == lo:
            found.update(dict.fromkeys(ranks, lo))
            return
        own = rows.where((F.col("v") >= lo) & (F.col("v") <= hi))
        bin_ = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1))
        counted = sorted(map(tuple, own.groupBy(bin_.alias("b")).agg(F.count("*"), F.min("v"), F.max("v")).collect()))
        small, at = {}, before
        for b, m, a, z in counted:
            inside = [r for r in ranks if at <= r < at + m]
            if inside and a == z:
                found.update(dict.fromkeys(inside, a))
            elif inside and m <= most:
                small[b] = (inside, at)
            elif inside:
                look(inside, a, z, at)
            at += m
        if small:
            held: dict[int, list[float]] = {}
            for b, x in own.select(bin_.alias("b"), "v").where(F.col("b").isin(list(small))).collect():
                held.setdefault(b, []).append(x)
            for b, (inside, first) in small.items():
                values = sorted(held[b])
                found.update({r: values[r - first] for r in inside})

    look(sorted({f(p) for p in places for f in (math.floor, math.ceil)}), lo, hi, 0)
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]


def reject_outliers(df: DataFrame, value: str, k: float = 3.0, least: int = 8, most: float = 0.3) -> DataFrame:
    """Drops rows above k times the median; all stay if there are under `least`, the median is not positive or over `most` of them would go."""
    middle = quantiles(df, value, [0.5])
    if not middle or middle[0] <= 0:
        return df
    bar = k * middle[0]
    n, share = df.agg(F.count("*"), F.avg((F.col(value) > bar).cast("double"))).first()
    return df if n < least or share > most else df.where(F.col(value) <= bar)


def single_scene(df: DataFrame, value: str) -> DataFrame:
    """One row, single_scene: the 99th percentile is under 3 and the maximum under 6 times the median, which counts as 1 at least; false if empty."""
    found = quantiles(df, value, [0.5, 0.99, 1.0])
    base = max(found[0], 1.0) if found else 0.0
    rule = bool(found) and found[1] < 3 * base and found[2] < 6 * base
    return df.sparkSession.range(1).select(F.lit(rule).alias("single_scene"))


def absolute_differences(df: DataFrame, key: str, values: str, buckets: int = 256) -> DataFrame:
    """For each row the sum over all other rows of the L1 distance of their vectors, without making pairs: key, total.

    In each dimension the sum of |x - y| over all y follows from how many are below and their sum. Values are cut into
    buckets whose totals are summed up first, so a window holds one bucket of one dimension.
    """
    cells = df.select(key, F.posexplode(values).alias("d", "x")).withColumn("x", F.col("x").cast("double"))
    ends = cells.groupBy("d").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # a row for each dimension
    span = F.col("hi") - F.col("lo")
    at = F.when(span > 0, F.least(F.floor((F.col("x") - F.col("lo")) / span * buckets), F.lit(buckets - 1))).otherwise(0)
    cells = cells.join(F.broadcast(ends), "d").withColumn("b", at).drop("lo", "hi")
    totals = cells.groupBy("d", "b").agg(F.count("*").alias("n"), F.sum("x").alias("s"))
    w = Window.partitionBy("d").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("d")
    zero = F.lit(0)
    totals = totals.select("d", "b", F.coalesce(F.sum("n").over(w), zero).alias("n0"), F.coalesce(F.sum("s").over(w), zero).alias("s0"), F.sum("n").over(every).alias("nt"), F.sum("s").over(every).alias("st"))
    rows = cells.join(totals, ["d", "b"])
    w = Window.partitionBy("d", "b").orderBy("x", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n, s = F.col("n0") + F.count("*").over(w), F.col("s0") + F.sum("x").over(w)
    rows = rows.withColumn("v", F.col("x") * n - s + (F.col("st") - s) - F.col("x") * (F.col("nt") - n))
    return rows.groupBy(key).agg(F.sum("v").alias("total"))


def composites(df: DataFrame, cell: str, value: str, order: list[str], cut: float = 0.1) -> DataFrame:
    """For each cell its mean, median, max, min, population deviation and the mean without `cut` (one at least) of its values at either end."""
    w = Window.partitionBy(cell).orderBy(value, *order)
    rows = df.withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(cell)))
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * cut))
    inner = F.when((F.col("_i") > k) & (F.col("_i") <= F.col("_n") - k), F.col(value))
    return rows.groupBy(cell).agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("max"), F.min(value).alias("min"),
        F.stddev_pop(value).alias("std"), F.coalesce(F.avg(inner), F.avg(value)).alias("trimmed"),
    )


def sigma_clip(df: DataFrame, cell: str, value: str, rounds: int = 3, k: float = 2.0, floor: float = 1.0) -> DataFrame:
    """For each cell the mean of the values that stay when, round after round, those k deviations off are dropped.

    A round is an aggregate by cell and a join back, so a cell with very many values is not gathered.
    """
    kept = df.select(cell, F.col(value).alias("v"))
    for _ in range(rounds):
        s = kept.groupBy(cell).agg(F.avg("v").alias("_m"), F.greatest(F.stddev_pop("v"), F.lit(floor)).alias("_s"))
        kept = kept.join(s, cell).where(F.abs(F.col("v") - F.col("_m")) < k * F.col("_s")).select(cell, "v")
    return kept.groupBy(cell).agg(F.avg("v").alias("clipped"), F.count("*").alias("n"))


def dominant_bin(df: DataFrame, cell: str, value: str, width: float = 20) -> DataFrame:
    """For each cell the mean of the values in its fullest bin, the lowest of several."""
    bins = df.groupBy(cell, F.floor(F.col(value) / width).alias("_b")).agg(F.count("*").alias("n"), F.avg(value).alias("m"))
    best = F.max_by(F.struct("m", "n"), F.struct(F.col("n"), -F.col("_b")))
    return bins.groupBy(cell).agg(best.alias("x")).select(cell, F.col("x.m").alias("dominant"), F.col("x.n").alias("n"))


def static_cells(df: DataFrame, x: str, y: str, frame: str, size: float, share: float, spread: float) -> DataFrame:
    """Cells of a grid that are occupied in `share` of all frames and whose points hardly move: cell, frames and mean point."""
    total = df.agg(F.count_distinct(frame).alias("_total"))
    cells = df.groupBy(F.floor(F.col(x) / size).alias("cx"), F.floor(F.col(y) / size).alias("cy")).agg(
        F.count_distinct(frame).alias("frames"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"), F.avg(x).alias("mx"), F.avg(y).alias("my")
    )
    keep = (F.col("frames") / F.col("_total") >= share) & (F.col("sx") <= spread) & (F.col("sy") <= spread)
    return cells.join(F.broadcast(total)).where(keep).select("cx", "cy", "frames", "mx", "my")


def away_from(df: DataFrame, x: str, y: str, anchors: DataFrame, radius: float) -> DataFrame:
    """The rows that are not nearer than `radius` to an anchor (mx, my). Anchors go to all bins about theirs, so that points meet them by equality."""
    near = F.expr("sequence(-1, 1)")
    bins = lambda c, name: F.explode(F.transform(near, lambda i: F.floor(F.col(c) / radius) + i)).alias(name)
    spread = anchors.select("mx", "my", bins("mx", "_bx")).select("mx", "my", "_bx", bins("my", "_by"))
    same = (F.floor(df[x] / radius) == F.col("_bx")) & (F.floor(df[y] / radius) == F.col("_by"))
    return df.join(spread, same & (F.hypot(df[x] - F.col("mx"), df[y] - F.col("my")) < radius), "left_anti")


def top_k(df: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= k).drop("_i")
