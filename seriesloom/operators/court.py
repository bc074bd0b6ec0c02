"""Court geometry from rows: vanishing points, quads over masks, views fitted to points, and views proposed from lines.

Lines are rows key, x1, y1, x2, y2; points rows key, x, y; a view is a homography from court metres to the image, an array
of nine numbers. All sums over points and votes are Spark's, so a key may have any number of points and of lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..schemas import COURT_LENGTH, COURT_WIDTH
from ..sources.shared import few, written

# Metres of the court's lines, across and down; the angles of steep and shallow lines, in degrees.
ACROSS, DOWN = (0.0, 0.46, 3.05, 5.64, 6.10), (0.0, 0.76, 4.72, 6.705, 8.685, 12.65, 13.41)
STEEP, SHALLOW = (40, 140), 40
#: Units that keep sums of squares near 1: metres and pixels.
METRES, PIXELS = 10.0, 1000.0
#: What votes need of a line.
_PARTS = ("a", "b", "c", "mx", "my", "length")


def lines(df: DataFrame) -> DataFrame:
    """df with a, b, c of each line (a² + b² = 1), its length and middle; lines without length are dropped."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    long = F.sqrt(dx * dx + dy * dy)
    told = df.withColumn("length", long).where("length > 0")
    told = told.withColumn("a", dy / F.col("length")).withColumn("b", -dx / F.col("length"))
    return told.withColumns({"c": -(F.col("a") * F.col("x1") + F.col("b") * F.col("y1")), "mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})


def family(df: DataFrame) -> DataFrame:
    """df with family: steep, shallow or null, by the line's angle."""
    angle = F.abs(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))))
    return df.withColumn("family", F.when(angle < SHALLOW, "shallow").when((angle > STEEP[0]) & (angle < STEEP[1]), "steep"))


def _meet(p: tuple[str, str, str], q: tuple[str, str, str]) -> tuple[Column, Column]:
    """Where two lines meet, given the names of their a, b, c; null if they are parallel."""
    a, b, c, d, e, f = (F.col(n) for n in (*p, *q))
    det = a * e - d * b
    det = F.when(F.abs(det) >= 1e-9, det)
    return (b * f - e * c) / det, (c * d - f * a) / det


def _off(x: str, y: str) -> Column:
    """The angle, nearly, by which a line misses a point: its distance as a share of that from the line's middle."""
    gone = F.sqrt((F.col(x) - F.col("mx")) * (F.col(x) - F.col("mx")) + (F.col(y) - F.col("my")) * (F.col(y) - F.col("my")))
    return F.abs(F.col("a") * F.col(x) + F.col("b") * F.col(y) + F.col("c")) / (gone + 1e-9)


def vanishing_points(df: DataFrame, keys: list[str], name: str, rounds: int = 300, tolerance: float = 0.02, piece: int = 1 << 16) -> DataFrame:
    """keys, vx, vy, weight, inliers and n: the point that the most length of a key's lines points to.

    A hash of keys and round draws two of a key's lines (the longest first, of equal ones by name) for each round; where they meet
    is a hypothesis, on which all lines of the key vote with their lengths. The heaviest hypothesis wins, of equal ones the
    first. Keys with fewer than two lines, or with parallel ones only, have no row.

    A key of at most `piece` lines is looked at in one go. The lines of a larger one are put in order by Spark, so that those
    drawn are found by their places; pieces of the order vote, and Spark adds the votes up.
    """
    told = written(lines(df.select(*keys, name, "x1", "y1", "x2", "y2")).select(*keys, name, *_PARTS).dropna(subset=keys))
    sizes = told.groupBy(*keys).agg(F.count("*").alias("n"))
    large = written(sizes.where(F.col("n") > piece))
    none = large.isEmpty()
    small = told if none else told.join(large, keys, "left_anti")
    order = [(-F.col("length")).alias("_order"), F.col(name).alias("_by")]
    packed = small.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, *_PARTS))).alias("_lines")).where(F.size("_lines") > 1)
    packed = packed.withColumn("_name", _named(keys))
    kinds = dict(packed.dtypes)
    names = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_best_point(name, rounds, tolerance, *parts) for name, parts in zip(batch.column("_name").to_pylist(), _parts(batch), strict=True)]
            at = [i for i, f in enumerate(found) if f is not None]
            told = [pa.array([found[i][j] for i in at], pa.float64() if j < 3 else pa.int64()) for j in range(5)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(at, pa.int64())) for k in keys), *told], [*keys, "vx", "vy", "weight", "inliers", "n"])

    found = packed.mapInArrow(vote, f"{names}, vx double, vy double, weight double, inliers long, n long")
    if none:
        return found
    # the number that a row gets in a sorted table tells its task, and its place among the rows of its key there
    whole = written(told.join(few(large.select(*keys)), keys, "left_semi").orderBy(*keys, *order).withColumn("_id", F.monotonically_increasing_id()))
    task = F.shiftright("_id", 33).alias("_task")
    starts = whole.groupBy(*keys, task).agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(starts.select(*keys, "_first", before.alias("_from"), "_rows"))
    hashed = F.md5(F.concat_ws("/", _named(keys), F.col("round").cast("string")))
    p, q = (F.conv(F.substring(hashed, at, 8), 16, 10).cast("long") for at in (1, 9))
    drawn = large.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_p", p % F.col("n"))
    drawn = drawn.withColumn("_q", (F.col("_p") + 1 + q % (F.col("n") - 1)) % F.col("n"))
    places = written(drawn.select(*keys, "round", F.explode(F.array(*(F.struct(F.lit(c).alias("_side"), F.col(f"_{c}").alias("_place")) for c in "pq"))).alias("_d")).select(*keys, "round", "_d.*"))
    ids = few(places).join(starts, keys).where((F.col("_place") >= F.col("_from")) & (F.col("_place") < F.col("_from") + F.col("_rows")))
    ids = written(ids.select("round", "_side", (F.col("_first") + F.col("_place") - F.col("_from")).alias("_id")))
    ends = written(few(ids).join(whole.select(*keys, "_id", "a", "b", "c"), "_id"))
    side = lambda c: ends.where(F.col("_side") == c).select(*keys, "round", *(F.col(v).alias(f"{c}{v}") for v in "abc"))
    vx, vy = _meet(*(tuple(f"{c}{v}" for v in "abc") for c in "pq"))
    points = side("p").join(side("q"), [*keys, "round"]).select(*keys, F.struct("round", vx.alias("vx"), vy.alias("vy")).alias("_h")).where("_h.vx is not null")
    points = written(points.groupBy(*keys).agg(F.collect_list("_h").alias("_points")))
    pieces = whole.groupBy(*keys, F.floor(F.col("_id") / piece).alias("_piece")).agg(F.collect_list(F.struct(*_PARTS)).alias("_lines"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (parts, (at, vx, vy)) in enumerate(zip(_parts(batch), _parts(batch, "_points", ("round", "vx", "vy")), strict=True)):
                weight, count = _votes(vx, vy, tolerance, *parts)
                own = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(own) for k in keys), *map(pa.array, (at, vx, vy, weight, count))], [*keys, "round", "vx", "vy", "weight", "inliers"])

    votes = pieces.join(points, keys).select(*keys, "_lines", "_points").mapInArrow(add_up, f"{names}, round int, vx double, vy double, weight double, inliers long")
    weight = F.floor(F.sum("weight") * 1000 + 0.5) / 1000
    votes = votes.groupBy(*keys, "round", "vx", "vy").agg(weight.alias("weight"), F.sum("inliers").alias("inliers")).where("inliers > 0")
    best = votes.groupBy(*keys).agg(F.max_by(F.struct("vx", "vy", "weight", "inliers"), F.struct("weight", -F.col("round"))).alias("_b"))
    return found.unionByName(best.join(large, keys).select(*keys, "_b.*", "n"))


def _named(keys: list[str]) -> Column:
    return F.concat_ws("/", *(F.col(k).cast("string") for k in keys))


def _parts(batch: pa.RecordBatch, column: str = "_lines", names: tuple[str, ...] = _PARTS) -> Iterator[list[np.ndarray]]:
    """A batch's lists of structs, row by row: an array for each of the fields."""
    lists = batch.column(column)
    cuts, flat = lists.offsets.to_numpy(), [lists.values.field(c).to_numpy(zero_copy_only=False) for c in names]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        yield [v[lo:hi] for v in flat]


def _votes(vx: np.ndarray, vy: np.ndarray, tolerance: float, a: np.ndarray, b: np.ndarray, c: np.ndarray, mx: np.ndarray, my: np.ndarray, length: np.ndarray, held: int = 1 << 12) -> tuple[np.ndarray, np.ndarray]:
    """The length and the number of lines that point to each hypothesis; `held` lines at a time."""
    weight, count = np.zeros(len(vx)), np.zeros(len(vx), dtype=np.int64)
    x, y = vx[:, None], vy[:, None]
    for at in (slice(i, i + held) for i in range(0, len(a), held)):
        gone = np.sqrt((x - mx[at]) * (x - mx[at]) + (y - my[at]) * (y - my[at]))
        votes = np.abs(a[at] * x + b[at] * y + c[at]) / (gone + 1e-9) < tolerance
        weight += (votes * length[at]).sum(axis=1)
        count += votes.sum(axis=1)
    return weight, count


def _best_point(name: str, rounds: int, tolerance: float, a: np.ndarray, b: np.ndarray, c: np.ndarray, mx: np.ndarray, my: np.ndarray, length: np.ndarray) -> tuple | None:
    """vx, vy, weight, inliers and n of a key's heaviest hypothesis; see vanishing_points()."""
    n = len(a)
    drawn = np.frombuffer(b"".join(hashlib.md5(f"{name}/{i}".encode()).digest()[:8] for i in range(rounds)), dtype=">u4").reshape(-1, 2).astype(np.int64)
    p = drawn[:, 0] % n
    q = (p + 1 + drawn[:, 1] % (n - 1)) % n
    det = a[p] * b[q] - a[q] * b[p]
    p, q, det = (v[np.abs(det) >= 1e-9] for v in (p, q, det))
    vx, vy = (b[p] * c[q] - b[q] * c[p]) / det, (c[p] * a[q] - c[q] * a[p]) / det
    told, votes = _votes(vx, vy, tolerance, a, b, c, mx, my, length)
    weight = np.where(votes > 0, np.floor(told * 1000 + 0.5) / 1000, -1.0)
    if not (weight >= 0).any():
        return None
    best = int(weight.argmax())  # the first of equal ones
    return float(vx[best]), float(vy[best]), float(weight[best]), int(votes[best]), n


def on_points(df: DataFrame, points: DataFrame, keys: list[str], tolerance: float = 0.02, least: int = 3) -> DataFrame:
    """The lines that point to their key's vanishing point; all lines of a key where fewer than `least` do."""
    rows = lines(df).join(points.select(*keys, "vx", "vy", "inliers"), keys, "left")
    ok = F.col("inliers").isNull() | (F.col("inliers") < least) | (_off("vx", "vy") < tolerance)
    return rows.where(ok).drop("vx", "vy", "inliers")


def quad_overlap(quads: DataFrame, mask: DataFrame, keys: list[str], key: str, width: int, height: int, least: int = 100) -> DataFrame:
    """keys and overlap: the share of each convex quad's pixels that lie in its key's mask (key, row, first, last; runs apart).

    quads have a column corners, [[x, y]] in order round the quad, cut to whole pixels. A quad's scanlines are made as rows:
    on each row of pixels it reaches from its leftmost to its rightmost edge there, rounded, within the picture. Of fewer
    than `least` pixels the share is 0.
    """
    at = lambda i, k: F.get(F.get("corners", F.lit(i % 4)), F.lit(k)).cast("long").cast("double")
    top, bottom = F.least(*(at(i, 1) for i in range(4))), F.greatest(*(at(i, 1) for i in range(4)))
    edges = F.array(*(F.struct(*(at(i + j, k).alias(f"{n}{j + 1}") for j in range(2) for k, n in enumerate("xy"))) for i in range(4)))
    rows = quads.select(*keys, edges.alias("_edges"), F.greatest(F.lit(0), top).cast("long").alias("_top"), F.least(F.lit(height - 1), bottom).cast("long").alias("_bottom"))
    rows = written(rows)
    y = F.col("row").cast("double")

    def cross(e: Column) -> Column:
        within = (y >= F.least(e.y1, e.y2)) & (y <= F.greatest(e.y1, e.y2))
        # of a level edge the next one has its other end
        return F.when(within, F.when(e.y1 == e.y2, e.x1).otherwise(e.x1 + (e.x2 - e.x1) * (y - e.y1) / F.nullif(e.y2 - e.y1, F.lit(0.0))))

    met = F.transform("_edges", cross)
    ends = [F.greatest(F.lit(0), F.floor(F.array_min(met) + 0.5)).alias("_a"), F.least(F.lit(width - 1), F.floor(F.array_max(met) + 0.5)).alias("_z")]
    # scanlines are added up where they are made; only the quads themselves meet the mask, by key
    spans = rows.withColumn("row", F.explode_outer(F.when(F.col("_top") <= F.col("_bottom"), F.sequence("_top", "_bottom")))).select(*keys, *ends)
    told = spans.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col("_z") - F.col("_a") + 1)).alias("_area"))
    held = rows.join(mask.select(F.col(key).alias("_k"), "row", "first", "last"), (F.col(key) == F.col("_k")) & F.col("row").between(F.col("_top"), F.col("_bottom")))
    held = held.select(*keys, "first", "last", *ends)
    both = held.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.least("_z", "last") - F.greatest("_a", "first") + 1)).alias("_both"))
    told = told.join(both, keys, "left")
    share = F.when(F.col("_area") >= least, F.coalesce("_both", F.lit(0)) / F.col("_area")).otherwise(0.0)
    return told.select(*keys, F.coalesce(share, F.lit(0.0)).alias("overlap"))


def view_of(corners: Column) -> Column:
    """The view that takes the court's corners to four points, top left, top right, bottom left, bottom right; null if they have no area."""
    at = lambda i, k: F.get(F.get(corners, F.lit(i)), F.lit(k)).cast("double")
    (x0, y0), (x1, y1), (x3, y3), (x2, y2) = ((at(i, 0), at(i, 1)) for i in range(4))
    dx1, dy1, dx2, dy2, sx, sy = x1 - x2, y1 - y2, x3 - x2, y3 - y2, x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    den = dx1 * dy2 - dx2 * dy1
    den = F.when(F.abs(den) > 1e-9, den)
    g, h = (sx * dy2 - dx2 * sy) / den, (dx1 * sy - sx * dy1) / den
    w, l = COURT_WIDTH, COURT_LENGTH
    told = F.array((x1 - x0 + g * x1) / w, (x3 - x0 + h * x3) / l, x0, (y1 - y0 + g * y1) / w, (y3 - y0 + h * y3) / l, y0, g / w, h / l, F.lit(1.0))
    return F.when(den.isNotNull(), told)


def _rows(view: Column) -> geo.Matrix:
    return [[F.get(view, F.lit(3 * i + j)) for j in range(3)] for i in range(3)]


def seen(view: Column, x: Column | float, y: Column | float) -> tuple[Column, Column]:
    """A point of the court in the image."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return geo.project(_rows(view), lit(x), lit(y))


def corners_of(view: Column) -> Column:
    """The court's corners in the image: top left, top right, bottom left, bottom right."""
    return F.array(*(F.array(*seen(view, x, y)) for y in (0.0, COURT_LENGTH) for x in (0.0, COURT_WIDTH)))


def valid_views(df: DataFrame, width: int, height: int) -> DataFrame:
    """The rows whose view's corners are finite and not far out of the picture, with no tiny side and the near side not much shorter than the far one.

    Batches of views go through numpy: as a formula over columns, each corner would be written out for every condition.
    """

    @F.pandas_udf("boolean")
    def valid(views: pd.Series) -> pd.Series:
        m = np.array([[np.nan] * 9 if v is None else v for v in views], dtype=float).reshape(-1, 3, 3)
        ends = np.array([[x, y, 1.0] for y in (0.0, COURT_LENGTH) for x in (0.0, COURT_WIDTH)])
        with np.errstate(all="ignore"):
            u, v, w = np.einsum("nij,ej->ien", m, ends)
            x, y = u / w, v / w
            side = lambda i, j: np.hypot(x[i] - x[j], y[i] - y[j])
            sides = np.stack([side(0, 1), side(2, 3), side(0, 2), side(1, 3)])
            inside = ((x >= -0.5 * width) & (x <= 1.5 * width) & (y >= -0.5 * width) & (y <= 1.5 * height)).all(axis=0)
            return pd.Series(inside & (sides.min(axis=0) >= 0.05 * width) & (sides[1] >= 0.6 * sides[0]))

    return df.where(valid("view"))


#: The sums of the normal equations: for each of the court's lines, moments of the image points next to it.
_SUMS = [f"{m}_{i}" for i in range(len(ACROSS) + len(DOWN)) for m in ("uu", "uv", "vv", "u", "v", "one")]
#: A line as a share of the three rows of the image's way back to the court.
_LINES = np.array([(1, 0, -v / METRES) for v in ACROSS] + [(0, 1, -v / METRES) for v in DOWN])


def _back(view: np.ndarray) -> np.ndarray:
    """The way back of a view, in units of METRES and PIXELS, of length 1."""
    back = np.linalg.inv(view / [[PIXELS], [PIXELS], [1.0]] * [[METRES, METRES, 1.0]])
    return back / np.linalg.norm(back)


def _sums(view: np.ndarray, x: np.ndarray, y: np.ndarray, reach: float) -> tuple[int, np.ndarray]:
    """How many points are in reach of the view's lines in the image, and their sums (see _SUMS): each point counts to the line it is nearest to."""
    lines_ = _LINES @ _back(view)
    lines_ = lines_ / np.hypot(lines_[:, 0], lines_[:, 1])[:, None]
    p = np.stack([x / PIXELS, y / PIXELS, np.ones(len(x))])
    d = np.abs(lines_ @ p) * PIXELS
    best, d = d.argmin(axis=0), d.min(axis=0)
    near = d < reach
    (u, v, one), best = p[:, near], best[near]
    weight = 1 / (1 + (d[near] / reach) ** 2)
    own = np.where(best == np.arange(len(_LINES))[:, None], weight, 0.0)
    return len(u), (own @ np.stack([u * u, u * v, v * v, u, v, one]).T).ravel()


def _solve(view: np.ndarray, near: int, sums: np.ndarray, least: int) -> np.ndarray | None:
    """The view moved by the step of least squares of distances from lines; null of too few points or of a singular system.

    A line in the image is a sum of the rows of the way back, so distances are linear in it, but for the line's length, which
    is taken as it was.
    """
    if near < least:
        return None
    back = _back(view)
    lines_ = _LINES @ back
    moments = sums.reshape(-1, 6)[:, [0, 1, 3, 1, 2, 4, 3, 4, 5]].reshape(-1, 3, 3) / (lines_[:, :1, None] ** 2 + lines_[:, 1:2, None] ** 2)
    q = np.einsum("li,lj,lab->iajb", _LINES, _LINES, moments).reshape(9, 9)
    g = back.ravel()
    # the way back keeps its length
    full = q + np.trace(q) * np.outer(g, g)
    if not np.isfinite(full).all() or np.linalg.cond(full) > 1e13:
        return None
    found = np.zeros((10, 10))
    found[:9, :9], found[9, :9], found[:9, 9] = q, g, g
    h = np.linalg.inv((g + np.linalg.solve(found, np.append(-q @ g, 0.0))[:9]).reshape(3, 3))
    return h / h[2, 2] * [[PIXELS], [PIXELS], [1.0]] / [[METRES, METRES, 1.0]]


def _reach(i: int) -> float:
    return max(5.0, 26.0 - 2.2 * i)


def _fitted(view: np.ndarray, u: np.ndarray, v: np.ndarray, rounds: int, least: int) -> tuple[int, np.ndarray]:
    """All rounds over the points of one view: points within the last round's reach, and the view."""
    near = 0
    for i in range(rounds):
        near, sums = _sums(view, u, v, _reach(i))
        found = _solve(view, near, sums, least)
        if found is None:
            return 0, view
        view = found
    return near, view


def _lists(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """A batch's lists of doubles, row by row; empty where they are null."""
    held = [(c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)) for c in map(batch.column, names)]
    for i in range(len(batch)):
        yield tuple(values[cuts[i] : cuts[i + 1]] for cuts, values in held)


def fit_views(points: DataFrame, views: DataFrame, keys: list[str], key: str, rounds: int = 10, least: int = 12, most: int = 1 << 16) -> DataFrame:
    """keys, view and near (points within the last round's reach): views moved onto the points of their key.

    Each round takes a point to the nearest of the court's lines in the image, leaves out those beyond a reach that shrinks
    from round to round, and moves the view by least squares of the others' distances from their lines, in which a point counts less the
    further it is off (by half at the reach). A view with fewer than `least` points in reach stays as it is from then on, with near 0.

    Points go in pieces of at most `most`. A key of no more is fitted in one go; of a larger one each piece gives the sums of its
    normal equations, six a line, in each round, and Spark adds them up.
    """
    seen_at = points.select(F.col(key).alias("_k"), F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).dropna()
    piece = F.floor(F.monotonically_increasing_id() / most)
    packed = written(seen_at.groupBy("_k", piece.alias("_piece")).agg(F.collect_list("_x").alias("_x"), F.collect_list("_y").alias("_y")))
    sizes = packed.groupBy("_k").agg(F.sum(F.size("_x")).alias("_n"))
    small, large = sizes.where(F.col("_n") <= most).drop("_n"), written(sizes.where(F.col("_n") > most).drop("_n"))
    whole = packed.join(small, "_k").groupBy("_k").agg(F.flatten(F.collect_list("_x")).alias("_x"), F.flatten(F.collect_list("_y")).alias("_y"))
    kinds = dict(views.dtypes)
    names = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    floats = pa.list_(pa.float64())

    def rows_of(batch: pa.RecordBatch, **told: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(batch.column, keys), *told.values()], [*keys, *told])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_fitted(h.reshape(3, 3), x, y, rounds, least) for h, x, y in _lists(batch, "view", "_x", "_y")]
            yield rows_of(batch, view=pa.array([h.ravel() for _, h in found], floats), near=pa.array([n for n, _ in found], pa.int64()))

    at = F.col(key) == F.col("_k")
    empty = F.array().cast("array<double>")
    rows = views.join(large.withColumnRenamed("_k", "_large"), F.col(key) == F.col("_large"), "left_anti").join(whole, at, "left")
    done = rows.select(*keys, F.col("view").cast("array<double>").alias("view"), F.coalesce("_x", empty).alias("_x"), F.coalesce("_y", empty).alias("_y")).mapInArrow(fit, f"{names}, view array<double>, near long")
    if large.isEmpty():
        return written(done)
    now = views.join(large, at, "left_semi").select(*keys, "view", F.lit(0).cast("long").alias("near"), F.lit(False).alias("done"))
    pieces = packed.join(large, "_k", "left_semi").drop("_piece")
    for i in range(rounds):
        told = written(now)

        def add_up(batches: Iterator[pa.RecordBatch], reach: float = _reach(i)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_sums(h.reshape(3, 3), x, y, reach) for h, x, y in _lists(batch, "view", "_x", "_y")]
                each = np.array([s for _, s in found]).reshape(len(found), -1).T
                yield rows_of(batch, near=pa.array([n for n, _ in found], pa.int64()), **{c: pa.array(v) for c, v in zip(_SUMS, each, strict=True)})

        parts = few(told.where(~F.col("done"))).join(pieces, at).select(*keys, "view", "_x", "_y").mapInArrow(add_up, f"{names}, near long, " + ", ".join(f"{n} double" for n in _SUMS))
        summed = parts.groupBy(*keys).agg(F.sum("near").alias("near"), F.array(*(F.sum(n) for n in _SUMS)).alias("_sums"))
        both = told.drop("near").join(summed, keys, "left").select(*keys, "view", F.coalesce("near", F.lit(0).cast("long")).alias("near"), F.coalesce("_sums", empty).alias("_sums"))

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = zip(batch.column("near").to_pylist(), _lists(batch, "view", "_sums"), strict=True)
                found = [(n, h, _solve(h.reshape(3, 3), n, sums, least) if len(sums) else None) for n, (h, sums) in lists]
                yield rows_of(batch, view=pa.array([h if new is None else new.ravel() for _, h, new in found], floats), near=pa.array([0 if new is None else n for n, _, new in found], pa.int64()), done=pa.array([new is None for *_, new in found]))

        now = both.mapInArrow(solve, f"{names}, view array<double>, near long, done boolean")
    return written(done.unionByName(now.drop("done")))


def supported(points: DataFrame, key: str, width: int, height: int, reach: float = 4.0) -> DataFrame:
    """key and px, py of the pixels that points lie in, once each, in the picture or within `reach` of it; no more than a picture has."""
    n = int(np.ceil(reach)) - 1
    pixels = points.select(key, F.rint("x").cast("int").alias("px"), F.rint("y").cast("int").alias("py"))
    return pixels.where(F.col("px").between(-n, width - 1 + n) & F.col("py").between(-n, height - 1 + n)).distinct()


def coverage(views: DataFrame, near: DataFrame, keys: list[str], key: str, width: int, height: int, samples: int = 80, reach: float = 4.0, piece: int = 1 << 13) -> DataFrame:
    """keys and coverage: the mean share of each court line that lies on pixels nearer than `reach` to a supported one, times the share of lines of which over 0.3 does.

    A line of which under 0.4 of the samples are in the picture counts as 0. near: see supported(). The views of a key meet its picture,
    one byte a pixel, in one task; those of a key with more than `piece` views are dealt to several tasks, each with its picture.
    """
    n = int(np.ceil(reach)) - 1
    steps = [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if i * i + j * j < reach * reach]
    t = np.arange(samples) / (samples - 1)
    ends = [(np.full(samples, v), t * DOWN[-1]) for v in ACROSS] + [(t * ACROSS[-1], np.full(samples, v)) for v in DOWN]
    court_ = np.stack([np.concatenate([e[0] for e in ends]), np.concatenate([e[1] for e in ends]), np.ones(len(ends) * samples)])

    def cover(left: pa.Table, right: pa.Table) -> pa.Table:
        px, py = (right.column(c).to_numpy() for c in ("px", "py"))
        picture = np.zeros((height + 2 * n, width + 2 * n), dtype=bool)
        mark = np.zeros_like(picture)
        mark[py + n, px + n] = True
        for i, j in steps:  # each pixel's neighbourhood, by shifts of the whole picture
            picture[max(0, j) : picture.shape[0] + min(0, j), max(0, i) : picture.shape[1] + min(0, i)] |= mark[max(0, -j) : mark.shape[0] - max(0, j), max(0, -i) : mark.shape[1] - max(0, i)]
        flat = np.append(picture[n : height + n, n : width + n].ravel(), False)
        lists = left.column("view").combine_chunks()
        every, out = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3, 3), []
        for at in range(0, len(every), 64):
            u, v, w = (every[at : at + 64] @ court_).transpose(1, 0, 2)
            w = np.where(np.abs(w) < 1e-9, 1e-9, w)
            u, v = np.rint(u / w), np.rint(v / w)
            inside = (u >= 0) & (u < width) & (v >= 0) & (v < height)
            place = np.where(inside, v * width + u, width * height).astype(np.int32)
            seen_, hit = (c.reshape(len(u), -1, samples).sum(axis=2) for c in (inside, flat[place]))
            share = np.where(seen_ >= 0.4 * samples, hit / np.maximum(seen_, 1), 0.0)
            out.append(share.sum(axis=1) * (share > 0.3).sum(axis=1) / len(ends) ** 2)
        told = np.concatenate(out) if out else np.zeros(0)
        return left.select(keys).append_column("coverage", pa.array(told, pa.float64()))

    kinds = dict(views.dtypes)
    rows = views.select(*keys, "view").where(F.col(key).isNotNull() & F.col("view").isNotNull())
    near, groups = near.where(F.col(key).isNotNull()), [key]
    many = written(rows.groupBy(key).agg(F.ceil(F.count("*") / piece).alias("_pieces")).where("_pieces > 1"))
    if not many.isEmpty():
        rows, near, groups = rows.join(few(many), key, "left"), near.join(few(many), key, "left"), [key, "_piece"]
        rows = rows.withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(*keys), F.col("_pieces")), F.lit(0))).drop("_pieces")
        near = near.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_pieces")
    return rows.groupBy(*groups).cogroup(near.groupBy(*groups)).applyInArrow(cover, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "coverage double"]))


def inliers(views: DataFrame, points: DataFrame, keys: list[str], key: str, reach: float = 5.0) -> DataFrame:
    """keys, inliers (the share of the key's points nearer than reach to a court line) and distance (the mean to the nearest)."""
    ends = [((v, DOWN[0]), (v, DOWN[-1])) for v in ACROSS] + [((ACROSS[0], v), (ACROSS[-1], v)) for v in DOWN]
    told = []
    for p, q in ends:
        told.append(F.array(*geo.line(*seen(F.col("view"), *p), *seen(F.col("view"), *q))))
    rows = few(written(views.select(*keys, F.array(*told).alias("_lines")))).join(points.select(F.col(key).alias("_k"), "x", "y"), F.col(key) == F.col("_k"))
    off = F.array_min(F.transform("_lines", lambda l: F.abs(F.get(l, F.lit(0)) * F.col("x") + F.get(l, F.lit(1)) * F.col("y") + F.get(l, F.lit(2)))))
    return rows.select(*keys, off.alias("_d")).groupBy(*keys).agg(F.avg((F.col("_d") < reach).cast("int")).alias("inliers"), F.avg("_d").alias("distance"))


def physical_lines(df: DataFrame, key: str, merge: float = 14.0) -> DataFrame:
    """key, family, i, a, b, c: lines of a family nearer than `merge` to the next are one, fitted to their ends by least squares.

    A steep line is placed by x at the mean height of the shallow ones, a shallow line by y at the mean x of the steep ones.
    """
    middle = df.groupBy(key).agg(F.avg(F.when(F.col("family") == "shallow", F.col("my"))).alias("ry"), F.avg(F.when(F.col("family") == "steep", F.col("mx"))).alias("rx"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    at = F.when(F.col("family") == "steep", F.when(F.abs(a) >= 1e-6, -(b * F.col("ry") + c) / a)).otherwise(F.when(F.abs(b) >= 1e-6, -(a * F.col("rx") + c) / b))
    rows = df.join(middle, key).withColumn("at", at).where("at is not null and not isnan(at)")
    rows = written(rows.select(key, "family", "at", F.floor(F.col("at") / (merge / 2)).alias("_bin"), "x1", "y1", "x2", "y2"))
    # all lines of a bin are one, so that bins are put in order, which are as many as a picture has room for
    w = Window.partitionBy(key, "family").orderBy("_bin")
    bins = rows.groupBy(key, "family", "_bin").agg(F.min("at").alias("_from"), F.max("at").alias("_to"))
    bins = bins.withColumn("_new", F.coalesce(F.col("_from") - F.lag("_to").over(w) >= merge, F.lit(True)).cast("int")).withColumn("i", F.sum("_new").over(w))
    rows = rows.join(bins.select(key, "family", "_bin", "i"), [key, "family", "_bin"])
    ends = rows.select(key, "family", "i", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    sums = ends.groupBy(key, "family", "i").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"), F.var_pop("p.x").alias("xx"), F.var_pop("p.y").alias("yy"), F.covar_pop("p.x", "p.y").alias("xy"))
    turn = F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy")) / 2
    fit = {"a": F.sin(turn), "b": -F.cos(turn)}
    return sums.withColumns(fit).select(key, "family", "i", "a", "b", (-(F.col("a") * F.col("x") + F.col("b") * F.col("y"))).alias("c"))


def proposals(found: DataFrame, key: str) -> DataFrame:
    """key, name and corners: a quad for each pair of steep with each pair of shallow lines; that of the outermost ones is named lines.

    Lines of a family lie apart (see physical_lines()), so a picture's size bounds the number of a key's quads, not its number of segments.
    """
    # by the bytes of the lines one task would make all quads, so the number of partitions is given
    held = found.repartition(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    held = held.withColumn("last", F.max("i").over(Window.partitionBy(key, "family")) == F.col("i"))

    def side(kind: str, name: str) -> DataFrame:
        return held.where(F.col("family") == kind).select(key, *(F.col(c).alias(f"{name}{c}") for c in ("i", "a", "b", "c", "last")))

    steep, shallow = ("l", "r"), ("t", "b")
    across = side("steep", "l").join(side("steep", "r"), key).where("li < ri")
    down = side("shallow", "t").join(side("shallow", "b"), key).where("ti < bi")
    outer = (F.col("li") == 1) & F.col("rlast") & (F.col("ti") == 1) & F.col("blast")
    both = across.join(down, key)
    names = lambda n: tuple(f"{n}{c}" for c in "abc")
    corners = F.array(*(F.array(*_meet(names(h), names(v))) for h in shallow for v in steep))
    name = F.format_string("%s-%02d-%02d-%02d-%02d", F.when(outer, "lines").otherwise("grid"), "li", "ri", "ti", "bi")
    return both.select(key, name.alias("name"), corners.alias("corners"))


def detect_court(segments: DataFrame, points: DataFrame, key: str, name: str, width: int, height: int, mask: DataFrame | None = None, rounds: int = 3) -> DataFrame:
    """key, name, score, coverage, inliers, refined and view: the best of the views that a key's lines propose.

    Lines (key, name, x1, y1, x2, y2) are parted into steep and shallow ones, held to their vanishing points,
    and joined to physical lines, of which quads are made. The best covered quad and the outermost one are moved onto the
    points; the moved view is kept only if it is valid and its coverage is not less. The score is coverage, a fifth of it
    weighed by the share of the quad in the mask, if there is one (key, row, first, last). Keys without a valid view have
    no row.
    """
    rows = written(family(lines(segments)).where("family is not null").select(key, "family", name, "x1", "y1", "x2", "y2"))
    keys = [key, "family"]
    held = on_points(rows, vanishing_points(rows, keys, name), keys)
    # written between steps, as Spark would write each step's formulas out within the next one's
    views = written(proposals(written(physical_lines(written(held), key)), key))
    views = written(views.select(key, "name", view_of(F.col("corners")).alias("view")))
    views = written(valid_views(views, width, height))
    near, both = written(supported(points, key, width, height)), [key, "name"]
    views = views.join(coverage(views, near, both, key, width, height), both)
    grid = F.row_number().over(Window.partitionBy(key, F.left("name", F.lit(4))).orderBy(F.desc(F.round("coverage", 9)), "name"))
    pool = written(views.withColumn("_i", grid).where("_i = 1").drop("_i"))
    moved = written(valid_views(fit_views(points, pool, both, key, rounds).select(*both, "view"), width, height))
    again = moved.join(coverage(moved, near, both, key, width, height), both).select(*both, F.col("view").alias("_view"), F.col("coverage").alias("_coverage"))
    better = F.coalesce(F.col("_coverage") >= F.col("coverage"), F.lit(False))
    pool = pool.join(again, both, "left").select(*both, F.when(better, F.col("_view")).otherwise(F.col("view")).alias("view"), F.when(better, F.col("_coverage")).otherwise(F.col("coverage")).alias("coverage"), better.alias("refined"))
    pool = written(pool)
    score = F.col("coverage")
    if mask is not None:
        quads = pool.select(*both, geo.clockwise(corners_of(F.col("view"))).alias("corners"))
        pool = pool.join(quad_overlap(quads, mask, both, key, width, height), both)
        score = F.col("coverage") * (0.8 + 0.2 * F.col("overlap"))
    told = pool.withColumn("score", score).join(inliers(pool, points, both, key).select(*both, "inliers"), both, "left")
    best = F.max_by(F.struct("name", "score", "coverage", "inliers", "refined", "view"), F.struct(F.round("score", 9), "name"))
    return told.groupBy(key).agg(best.alias("b")).select(key, "b.*")
