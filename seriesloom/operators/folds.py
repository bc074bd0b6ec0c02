"""Order-dependent operators: folds over a key's sorted rows, and kernels by key.

All of them need a key's rows in order in one task, so keys are to be segments of a recording, which are bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels, stats
from .smoothing import Motion, filtered_many


#: Rows that a task takes at a time where work is done on many keys side by side.
ROWS = 1 << 16


def by_keys(rows: DataFrame, keys: list[str], order: list[str | Column], run: Callable[[pd.DataFrame, list[int]], pd.DataFrame], schema: str | object, least: int = ROWS) -> DataFrame:
    """run() on the rows of many whole keys, sorted by `order`, with the places where keys begin, and the end.

    Partitions are sorted and read in batches, which are put together until they hold `least` rows and the end of a key, so many small keys cost no
    more than their rows. The number of partitions is given, as by their bytes few would be made of rows that take Python long."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        n, enough = 0, least
        for p in parts:
            if not len(p):
                continue
            held.append(p)
            n += len(p)
            if n < enough:
                continue
            p = pd.concat(held, ignore_index=True) if len(held) > 1 else p
            cuts = _begins(p, keys)
            if cuts[-1]:
                yield run(p.iloc[: cuts[-1]], cuts)
                p = p.iloc[cuts[-1] :].reset_index(drop=True)
            # a key of many batches is not put together anew with each of them
            held, n, enough = [p], len(p), max(least, 2 * len(p))
        if held:
            p = pd.concat(held, ignore_index=True)
            yield run(p, [*_begins(p, keys), len(p)])

    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, *order).mapInPandas(work, schema)


def _begins(rows: pd.DataFrame, keys: list[str]) -> list[int]:
    own = rows[keys]
    before = own.shift()
    new = ((own != before) & ~(own.isna() & before.isna())).any(axis=1).to_numpy()
    return [0, *(i for i in new.nonzero()[0].tolist() if i)]


def by_key(rows: DataFrame, keys: list[str], order: list[str | Column], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str | object) -> DataFrame:
    """run() on each key's rows, sorted by `order`: see by_keys."""

    def each(part: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        return pd.concat([run(part.iloc[a:z].reset_index(drop=True)) for a, z in zip(cuts[:-1], cuts[1:], strict=True)], ignore_index=True)

    return by_keys(rows, keys, order, each, schema, 0)


def pieces(part: pd.DataFrame, columns: list[str], cuts: list[int]) -> list[tuple[np.ndarray, ...]]:
    """The columns of each key, as arrays."""
    values = [part[c].to_numpy() for c in columns]
    return [tuple(v[a:z] for v in values) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def greedy_dedup(df: DataFrame, key: str, order: str, side: str, strength: str, apart: int = 18) -> DataFrame:
    """Keeps hits in order: one nearer than `apart` to the last kept, on the same side, replaces it if it is stronger, else goes.

    A null strength counts as the greatest. A null side is no one's.
    """
    rows = df.select(key, order, side, F.coalesce(F.col(strength).cast("double"), F.lit(float("inf"))).alias("_strong"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        at, strong = part[order].to_numpy(), part["_strong"].to_numpy()
        sides = [None if pd.isna(s) else s for s in part[side]]
        for i in range(len(part)):
            if kept and sides[i] is not None and sides[i] == sides[kept[-1]] and at[i] - at[kept[-1]] < apart:
                if strong[i] > strong[kept[-1]]:
                    kept[-1] = i
            else:
                kept.append(i)
        return part.iloc[kept][[key, order, side]]

    return by_key(rows, [key], [order, side, "_strong"], run, rows.drop("_strong").schema)


def snap_boundaries(df: DataFrame, key: str, start: str, end: str, cut: str, within: int) -> DataFrame:
    """Moves each interval's start to its cut if that is within reach and after the end, as refined, of the one before."""
    rows = df.select(key, start, end, cut)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        starts, ends, floor = [], [], -1
        for a, z, c in zip(part[start], part[end], part[cut], strict=True):
            near = not pd.isna(c) and abs(c - a) <= within
            starts.append(max(int(c) if near else a, floor + 1))
            ends.append(max(z, starts[-1]))
            floor = ends[-1]
        return part[[key]].assign(**{start: starts, end: ends})

    return by_key(rows, [key], [start, end], run, rows.drop(cut).schema)


def refine_boundaries(df: DataFrame, key: str, start: str, end: str, first: str, after: str) -> DataFrame:
    """Intervals moved to begin at `first` and end before `after`, each a cut or null, as far as their neighbours let them.

    None begins before the refined end of the one before, or ends after the start of the next one; one that would end before it begins stays.
    """
    rows = df.select(key, start, end, first, after)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        starts, ends, floor = [], [], -1
        ahead = [*part[start].tolist()[1:], None]
        for a, z, c, d, n in zip(part[start], part[end], part[first], part[after], ahead, strict=True):
            low = max(a if pd.isna(c) else int(c), floor + 1)
            high = z if pd.isna(d) else int(d) - 1
            high = high if n is None else min(high, n - 1)
            low, high = (low, high) if high >= low else (a, z)
            starts.append(low)
            ends.append(high)
            floor = high
        return part[[key]].assign(**{start: starts, end: ends})

    return by_key(rows, [key], [start, end], run, rows.drop(first, after).schema)


def prune_tail(df: DataFrame, key: str, order: str, keep: Column, near: int) -> DataFrame:
    """Drops, from the back on, each row that is not to be kept and has no row left within `near` after it; a null keep counts as true.

    A row stays if, over steps of at most `near`, a row to be kept follows it: so each stretch of such steps ends with its
    last one to be kept, and no fold is needed.
    """
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce(F.col(order) - F.lag(order).over(w) > near, F.lit(True)).cast("int")
    rows = df.withColumn("_keep", F.coalesce(keep, F.lit(True))).withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    last = F.max(F.when(F.col("_keep"), F.col(order))).over(Window.partitionBy(key, "_run"))
    return rows.withColumn("_last", last).where(F.col(order) <= F.col("_last")).drop("_keep", "_new", "_run", "_last")


def first_come(df: DataFrame, key: str, low: str, pick: str) -> DataFrame:
    """Intervals by rising low, each with its pick: those stay that hold no pick of one that stayed before."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keep, last = [], float("-inf")
        for i, (a, p) in enumerate(zip(rows[low], rows[pick], strict=True)):
            if a > last:
                keep.append(i)
                last = max(last, p)
        return rows.iloc[keep]

    return by_key(df, [key], [low, pick], run, df.schema)


def peaks(df: DataFrame, key: str, order: str, value: str, distance: int = 1, prominence: float | None = None) -> DataFrame:
    """Local maxima of each key's series: key, order, value."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[kernels.find_peaks(rows[value].to_numpy(), distance, prominence)]

    rows = df.select(key, order, F.col(value).cast("double").alias(value))
    return by_key(rows, [key], [order], run, rows.schema)


def weak_points(df: DataFrame, key: str, frame: str, x: str, y: str, least_y: float, least_x: float) -> DataFrame:
    """Each key's peaks of y and turns of x, either way: key, frame, strength (the greatest prominence there) and is_peak (of y). Rows without a point are left out."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, frame, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        px, py, f = part[x].to_numpy(), part[y].to_numpy(), part[frame].to_numpy()
        series = ((py, least_y), (px, least_x), (-px, least_x))
        at = [kernels.find_peaks(v, prominence=least) for v, least in series]
        strength = [kernels.prominences(v, i) for (v, _), i in zip(series, at, strict=True)]
        n = sum(map(len, at))
        return pd.DataFrame({key: part[key].iloc[:1].repeat(n).to_numpy(), frame: f[np.concatenate(at)], "strength": np.concatenate(strength), "is_peak": np.arange(n) < len(at[0])})

    kinds = dict(rows.dtypes)
    found = by_key(rows, [key], [frame], run, f"{key} {kinds[key]}, {frame} {kinds[frame]}, strength double, is_peak boolean")
    return found.groupBy(key, frame).agg(F.max("strength").alias("strength"), F.bool_or("is_peak").alias("is_peak"))


def viterbi_path(df: DataFrame, key: str, frame: str = "frame", x: str = "x", y: str = "y", conf: str = "conf", **knobs: float) -> DataFrame:
    """The candidates on each key's best path."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[kernels.viterbi(*(rows[c].to_numpy() for c in (frame, x, y, conf)), **knobs)]

    rows = df.select(key, frame, x, y, conf)
    return by_key(rows, [key], [frame, F.desc(conf), x, y], run, rows.schema)


def kalman_accepted(df: DataFrame, key: str, frame: str = "frame", x: str = "x", y: str = "y", conf: str = "conf", motion: Motion = Motion()) -> DataFrame:
    """Each key's observations with whether the filter believes them. Rows without a place are left out; a null confidence is the least."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(key, frame, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y), F.coalesce(F.col(conf), F.lit(0.0)).alias(conf))

    def run(part: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        found = filtered_many(pieces(part, [frame, x, y, conf], cuts), motion)
        return part[[key, frame, x, y]].assign(accepted=np.concatenate([f[0] for f in found]))

    return by_keys(rows, [key], [frame], run, ", ".join(f"{n} {t}" for n, t in [*rows.drop(conf).dtypes, ("accepted", "boolean")]))


def two_player_tracks(df: DataFrame, key: str, frame: str = "frame", x: str = "x", y: str = "y", court: str = "court", size: str = "size", anchors: DataFrame | None = None, radius: float = 20.0, **knobs: float) -> DataFrame:
    """For each key and frame the chosen candidates of the far (top) and near (bottom) half, told apart by their place down the court.

    Candidates within `radius` pixels of an anchor (mx, my, of all keys; see stats.static_cells) stand still all along and are no players: they go first.
    """
    rows = df.where(F.col(frame).isNotNull()).select(key, frame, x, y, court, size)
    if anchors is not None:
        rows = stats.away_from(rows, x, y, anchors, radius)

    def run(part: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        at = part[frame].to_numpy()
        points = list(zip(*(part[c].tolist() for c in (x, y, court, size)), strict=True))
        # rows are in order, so a frame's candidates lie side by side
        begins = np.union1d(cuts, np.nonzero(at[1:] != at[:-1])[0] + 1).tolist()
        rows, sides, n = [], [], 0
        for z in cuts[1:]:
            groups = []
            while begins[n] < z:
                groups.append((int(at[begins[n]]), begins[n], begins[n + 1]))
                n += 1
            chosen = kernels.track_two([(f, points[a:b]) for f, a, b in groups], **knobs)
            for (_, a, _), (_, *own) in zip(groups, chosen, strict=True):
                for side, i in zip(("top", "bottom"), own, strict=True):
                    if i is not None:
                        rows.append(a + i)
                        sides.append(side)
        return part.iloc[rows][[key, frame, x, y]].assign(player=sides)[[key, frame, "player", x, y]]

    kinds = dict(rows.dtypes)
    return by_keys(rows, [key], [frame, x, y], run, f"{key} {kinds[key]}, {frame} {kinds[frame]}, player string, {x} {kinds[x]}, {y} {kinds[y]}")


def blobs(pixels: DataFrame, key: list[str], x: str = "x", y: str = "y", v: str = "v", least: int = 1) -> DataFrame:
    """4-connected components of each key's pixels: weighted centroid, peak, area in pixels and bounding box."""
    rows = pixels.select(*key, x, y, v)
    kinds = dict(rows.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part["c"] = kernels.label_cells(part[x].to_numpy(), part[y].to_numpy())
        part["wx"], part["wy"] = part[x] * part[v], part[y] * part[v]
        g = part.groupby("c").agg(wx=("wx", "sum"), wy=("wy", "sum"), w=(v, "sum"), peak=(v, "max"), area=(v, "size"), left=(x, "min"), right=(x, "max"), top=(y, "min"), bottom=(y, "max"))
        g = g[g["area"] >= least]
        out = pd.DataFrame({k: [part[k].iloc[0]] * len(g) for k in key})
        box = {c: g[c].astype(float).to_numpy() for c in ("peak", "left", "right", "top", "bottom")}
        return out.assign(cx=(g["wx"] / g["w"]).to_numpy(), cy=(g["wy"] / g["w"]).to_numpy(), area=g["area"].to_numpy(), **box)

    return by_key(rows, key, [x, y], run, ", ".join([*(f"{k} {kinds[k]}" for k in key), "cx double, cy double, area long, peak double, left double, right double, top double, bottom double"]))


def largest_blobs(found: DataFrame, key: list[str]) -> DataFrame:
    """Each key's blob of the largest bounding box; of equal ones that furthest to the left, then up. blobs() gives what it takes."""
    box = (F.col("right") - F.col("left") + 1) * (F.col("bottom") - F.col("top") + 1)
    rest = [c for c in found.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(box, -F.col("left"), -F.col("top")))
    return found.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def baseline_track(pixels: DataFrame, key: list[str], scale_x: float, scale_y: float, threshold: float, white: float = 255.0) -> DataFrame:
    """Each key's point by its largest blob of pixels brighter than the threshold: the box's centre, scaled, and the peak as a share of white."""
    best = largest_blobs(blobs(pixels.where(F.col("v") > threshold), key), key)
    x, y = (F.col("left") + F.col("right") + 1) / 2 * scale_x, (F.col("top") + F.col("bottom") + 1) / 2 * scale_y
    return best.select(*key, x.alias("x"), y.alias("y"), (F.col("peak") / white).alias("conf"))


def contact_candidates(df: DataFrame, key: str, frame: str = "frame", x: str = "x", y: str = "y", **knobs: float) -> DataFrame:
    """Each key's frames with a signal of contact, and the names of the signals about them; rows whose x is null are frames without a point."""
    rows = df.select(key, frame, x, y)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        first, last = int(part[frame].iloc[0]), int(part[frame].iloc[-1])
        seen = part[part[x].notna() & part[y].notna()]
        found = kernels.contact_candidates(*(seen[c].to_numpy() for c in (frame, x, y)), first, last - first + 1, **knobs)
        return pd.DataFrame([(part[key].iloc[0], f, "+".join(names)) for f, names in found], columns=[key, frame, "reasons"])

    kinds = dict(rows.dtypes)
    return by_key(rows, [key], [frame], run, f"{key} {kinds[key]}, {frame} {kinds[frame]}, reasons string")


def fill_path(df: DataFrame, key: str, frame: str = "frame", x: str = "x", y: str = "y", conf: str = "conf", **knobs: object) -> DataFrame:
    """Each key's points on every frame from its first to its last: key, frame, x, y. See kernels.fill_path."""
    rows = df.where(F.col(x).isNotNull()).select(key, frame, x, y, conf)

    def run(part: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        found = kernels.fill_paths(pieces(part, [frame, x, y, conf], cuts), **knobs)
        span, px, py = (np.concatenate([f[i] for f in found]) for i in range(3))
        return pd.DataFrame({key: part[key].iloc[cuts[:-1]].repeat([len(f[0]) for f in found]).to_numpy(), frame: span, x: px, y: py})

    kinds = dict(rows.dtypes)
    return by_keys(rows, [key], [frame], run, f"{key} {kinds[key]}, {frame} {kinds[frame]}, {x} double, {y} double")


def first_rises(df: DataFrame, key: str, order: str, value: str, **knobs: float) -> DataFrame:
    """Each key's first sustained rise (of a value that grows downwards); keys without one have no row."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        f = kernels.first_rise(rows[order].to_numpy(), rows[value].to_numpy(), **knobs)
        return pd.DataFrame([] if f is None else [(rows[key].iloc[0], f)], columns=[key, "rise"])

    rows = df.where(F.col(value).isNotNull()).select(key, order, value)
    return by_key(rows, [key], [order], run, f"{key} {dict(rows.dtypes)[key]}, rise long")
