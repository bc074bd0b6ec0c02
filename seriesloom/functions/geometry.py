"""Scalar geometry as columns: angles, boxes, homographies, skeleton features."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import COURT_LENGTH, COURT_WIDTH

Matrix = list[list[Column]]


def segment_seconds(start: Column, end: Column, fps: float) -> dict[str, Column]:
    """Seconds of a pair of frames, three places; the duration is that of the unrounded seconds."""
    a, z = start / fps, end / fps
    return {"start_sec": F.round(a, 3), "end_sec": F.round(z, 3), "duration_sec": F.round(z - a, 3)}


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(lit(low), F.least(x, lit(high)))


def round_to_int(x: Column) -> Column:
    """Nearest whole number, halves to the even one."""
    return F.rint(x).cast("long")


def middle_frames(start: Column, end: Column) -> tuple[Column, Column]:
    """The middle frames of a segment's two halves."""
    n = end + 1
    half = F.floor(start + (n - start) / 2)
    return F.floor((start + half) / 2), F.floor((half + n) / 2)


def widening(lowest: Column, low: float = 10.0, high: float = 40.0, most: float = 0.10) -> Column:
    """A share that falls from `most` at `low` to 0 at `high`, straight between."""
    return F.when(lowest <= low, most).when(lowest >= high, 0.0).otherwise(most * (high - lowest) / (high - low))


def _whole_degrees(dy: pd.Series, dx: pd.Series) -> pd.Series:
    """The whole degrees of directions, cut towards 0; null where a part is."""
    turn = (math.degrees(math.atan2(a, b)) for a, b in zip(dy.tolist(), dx.tolist(), strict=True))
    return pd.Series([None if math.isnan(t) else int(t) for t in turn], dtype="Int32")


def angle_between(dx1: Column, dy1: Column, dx2: Column, dy2: Column) -> Column:
    """Degrees between two directions; each angle is cut to a whole number first. Same signs: their difference, else their sum, at most 180."""
    # the C library's atan2: Java's differs from it in the last bit, which tells where an angle is all but a whole number
    whole = F.pandas_udf(_whole_degrees, T.IntegerType())
    a, b = whole(dy1, dx1), whole(dy2, dx2)
    out = F.when(a * b >= 0, F.abs(a - b)).otherwise(F.abs(a) + F.abs(b))
    return F.when(out > 180, 360 - out).otherwise(out)


def ground_point(ankles: list[tuple[Column, Column, Column]], box: list[Column], least: float) -> tuple[Column, Column]:
    """The mean of the ankles (x, y, score) of at least that score, or else the middle of the box's lower edge."""
    good = [s >= least for _, _, s in ankles]
    n = sum((F.coalesce(g, F.lit(False)).cast("int") for g in good), F.lit(0))
    mean = lambda j: sum((F.when(g, a[j]).otherwise(0.0) for a, g in zip(ankles, good, strict=True)), F.lit(0.0)) / F.nullif(n, F.lit(0))
    return F.coalesce(mean(0), (box[0] + box[2]) / 2), F.coalesce(mean(1), box[3])


def ground_point_for_model(ankles: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """The mean of the ankles whose coordinates are both not 0; null if there is none. Not the same as ground_point."""
    good = [(x != 0) & (y != 0) for x, y in ankles]
    n = F.nullif(sum((F.coalesce(g, F.lit(False)).cast("int") for g in good), F.lit(0)), F.lit(0))
    return tuple(sum((F.when(g, a[j]).otherwise(0.0) for a, g in zip(ankles, good, strict=True)), F.lit(0.0)) / n for j in (0, 1))


def matrix(col: Column, n: int = 3) -> Matrix:
    return [[F.get(F.get(col, F.lit(i)), F.lit(j)) for j in range(n)] for i in range(n)]


def inverse(m: Matrix) -> Matrix:
    """Inverse of a 3×3 matrix by its adjugate; nulls where it is singular."""
    def minor(i: int, j: int) -> Column:
        r, c = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
        return m[r[0]][c[0]] * m[r[1]][c[1]] - m[r[0]][c[1]] * m[r[1]][c[0]]

    det = sum((m[0][j] * minor(0, j) * (-1) ** j for j in range(3)), F.lit(0.0))
    det = F.when(F.abs(det) > 1e-12, det)
    return [[minor(j, i) * (-1) ** (i + j) / det for j in range(3)] for i in range(3)]


def project(m: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    """(x, y) through a homography; a vanishing w counts as 1e-9."""
    u, v, w = (r[0] * x + r[1] * y + r[2] for r in m)
    w = F.when(F.abs(w) < 1e-9, 1e-9).otherwise(w)
    return u / w, v / w


def to_court(image_to_court: Matrix, x: Column, y: Column) -> tuple[Column, Column]:
    """Image pixels to the court's unit square."""
    u, v = project(image_to_court, x, y)
    return u / COURT_WIDTH, v / COURT_LENGTH


def ground_scale(court_to_image: Matrix, image_to_court: Matrix, x: Column, y: Column) -> Column:
    """Pixels that a metre down the court takes at an image point."""
    u, v = project(image_to_court, x, y)
    x2, y2 = project(court_to_image, u, v + 1)
    return F.hypot(x2 - x, y2 - y)


def court_size(box_height: Column, scale: Column) -> Column:
    return box_height / F.greatest(scale, F.lit(1e-6))


def normalize_joints(joints: Column, box: Column) -> Column:
    """Joints [[x, y]] from the box's corner in units of its diagonal, 0 for missing ones, and then all about the box's centre."""
    g = lambda i: F.get(box, F.lit(i))
    w, h = g(2) - g(0), g(3) - g(1)
    d = F.nullif(F.hypot(w, h), F.lit(0.0))
    one = lambda v, corner, side: F.when(v == 0, 0.0).otherwise((v - corner) / d) - side / 2 / d
    return F.transform(joints, lambda j: F.array(one(F.get(j, F.lit(0)), g(0), w), one(F.get(j, F.lit(1)), g(1), h)))


def bones(joints: Column, pairs: list[tuple[int, int]]) -> Column:
    """Vectors between pairs of joints; a coordinate is 0 where it is 0 at either joint."""
    def part(a: Column, b: Column) -> Column:
        return F.when((a == 0) | (b == 0), 0.0).otherwise(b - a)

    at = lambda i, k: F.get(F.get(joints, F.lit(i)), F.lit(k))
    return F.array(*(F.array(*(part(at(a, k), at(b, k)) for k in (0, 1))) for a, b in pairs))


def segment_length(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column], least: float = 0.2) -> Column:
    """Distance of two joints (x, y, score); null unless both scores are above `least`."""
    return F.when((a[2] > least) & (b[2] > least), F.hypot(a[0] - b[0], a[1] - b[1]))


Joint = tuple[Column, Column, Column]


def arm_length(shoulder: Joint, elbow: Joint, wrist: Joint) -> Column:
    """Upper and lower arm, as far as they are known, or else shoulder to wrist; null if neither is."""
    parts = [F.coalesce(segment_length(a, b), F.lit(0.0)) for a, b in ((shoulder, elbow), (elbow, wrist))]
    total = parts[0] + parts[1]
    return F.when(total > 0, total).otherwise(segment_length(shoulder, wrist))


def player_scale(left: tuple[Joint, Joint, Joint], right: tuple[Joint, Joint, Joint]) -> Column:
    """The longer arm, or else one and a half shoulder widths; null if nothing can be measured."""
    arms = [F.nullif(arm_length(*side), F.lit(0.0)) for side in (left, right)]
    return F.coalesce(F.greatest(*arms), F.nullif(1.5 * segment_length(left[0], right[0]), F.lit(0.0)))


def nearest_distance(points: list[tuple[Column, Column]], x: Column, y: Column) -> Column:
    """Distance to the nearest of the points that are known."""
    return F.least(*(F.hypot(px - x, py - y) for px, py in points))


def line(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    """a, b, c of the line through two points, with a² + b² = 1."""
    a, b = y1 - y2, x2 - x1
    n = F.nullif(F.hypot(a, b), F.lit(0.0))
    return a / n, b / n, (x1 * y2 - x2 * y1) / n


def intersection(p: tuple[Column, Column, Column], q: tuple[Column, Column, Column]) -> tuple[Column, Column]:
    """Where two lines meet; null if they are parallel."""
    d = p[0] * q[1] - q[0] * p[1]
    d = F.when(F.abs(d) >= 1e-9, d)
    return (p[1] * q[2] - q[1] * p[2]) / d, (q[0] * p[2] - p[0] * q[2]) / d


def clockwise(corners: Column) -> Column:
    """Corners top left, top right, bottom left, bottom right in clockwise order."""
    return F.array(*(F.get(corners, F.lit(i)) for i in (0, 1, 3, 2)))


def valid_corners(corners: Column) -> Column:
    """Four finite corners with an area."""
    at = lambda i, k: F.get(F.get(corners, F.lit(i)), F.lit(k))
    order = [0, 1, 3, 2]
    area = sum((at(a, 0) * at(b, 1) - at(b, 0) * at(a, 1) for a, b in zip(order, order[1:] + order[:1], strict=True)), F.lit(0.0))
    return F.coalesce((F.size(corners) == 4) & (F.abs(area) > 1e-6), F.lit(False))
