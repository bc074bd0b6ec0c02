"""Records and sizes of views: builders, filters and the columns of debug tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of the two debug tables, in the order that readers of them expect.
HIT_COLUMNS = ["Frame", "Visibility", "X", "Y", "Hit", "Reason", "Candidate", "Prominence", "Accel_Angle", "Accel_Ratio", "Ramp_Ratio", "Ramp_DVX", "YAmp", "XAmp", "Side", "Opp_Count", "Kept", "Remove_Stage"]
STROKE_COLUMNS = ["Event", "Frame", "Segment", "LocalFrame", "WinStart", "WinEnd", "WinLen", "Player", "Stroke", "Confidence", "RawClass", "p_unknown", "p_top", "p_bottom"]


def scale_factors(width: Column, height: Column, of_width: float, of_height: float) -> tuple[Column, Column]:
    """What a heatmap's places are multiplied by to be places of its source."""
    return width / of_width, height / of_height


def rescaled(n: Column, times: Column) -> Column:
    """A count of pixels or frames at another size or rate: at least 1, halves to even."""
    return F.greatest(F.lit(1), F.rint(n * times).cast("long"))


def fit_scale(width: Column, height: Column, most_width: float, most_height: float) -> Column:
    """The factor, 1 at most, by which a view fits into a display."""
    return F.least(F.lit(most_width) / width, F.lit(most_height) / height, F.lit(1.0))


def default_corners(width: Column, height: Column, margin: float = 0.25) -> Column:
    """Corners TL, TR, BL, BR at a share of the view from its edges."""
    near, far = F.lit(margin), F.lit(1 - margin)
    at = lambda u, v: F.array(u * width, v * height)
    return F.array(at(near, near), at(far, near), at(near, far), at(far, far))


def proportional_height(width: Column, height: Column, to_width: int) -> Column:
    return F.greatest(F.lit(1), F.rint(height * to_width / width).cast("long"))


def iso_utc(at: Column) -> Column:
    """A time as ISO-8601 in UTC, to the second."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def large_enough(left: Column, top: Column, right: Column, bottom: Column, least: float) -> Column:
    return (right - left) * (bottom - top) >= least


def both_known(a: Column, b: Column) -> Column:
    """Whether no further reading is needed."""
    return a.isNotNull() & b.isNotNull()


def reading_rank(a: Column, b: Column) -> Column:
    """Readings with both scores come first."""
    return F.when(both_known(a, b), 0).otherwise(1)


def of_method(points: DataFrame, method: str, column: str = "method") -> DataFrame:
    """The points of a method; raises ValueError if it has none."""
    found = points.where(F.col(column) == method)
    if found.isEmpty():
        raise ValueError(f"no points of method {method!r}")
    return found


def shuttle_record(start_frame: Column, local: Column, x: Column, y: Column, conf: Column) -> list[Column]:
    """frame, x, y, visible and confidence of a point: local frames become those of the recording; an unseen one has no place."""
    seen = x.isNotNull() & ~F.isnan(x)
    return [(start_frame + local).alias("frame"), F.when(seen, F.round(x, 2)).alias("x"), F.when(seen, F.round(y, 2)).alias("y"), seen.alias("visible"), F.round(conf, 4).alias("confidence")]


def pose_record(joints: Column, box: Column) -> list[Column]:
    """keypoints [[x, y, score]] to 2, 2 and 4 decimals and bbox to 2; null for a player who was not found."""
    one = lambda j: F.array(F.round(F.get(j, F.lit(0)), 2), F.round(F.get(j, F.lit(1)), 2), F.round(F.get(j, F.lit(2)), 4))
    return [F.transform(joints, one).alias("keypoints"), F.transform(box, lambda v: F.round(v, 2)).alias("bbox")]


def nested_skeletons(joints: DataFrame, segment: str, frame: str, player: str, joint: str, value: list[str]) -> DataFrame:
    """One row for each segment and frame, which stay rows as a segment may be long: a map player -> joint -> struct of values."""
    one = joints.groupBy(segment, frame, player).agg(F.map_from_entries(F.collect_list(F.struct(F.col(joint).alias("k"), F.struct(*value).alias("v")))).alias("j"))
    return one.groupBy(segment, frame).agg(F.map_from_entries(F.collect_list(F.struct(F.col(player).alias("k"), F.col("j").alias("v")))).alias("skeletons"))


def hit_table(frames: DataFrame, details: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """The hit debug table: a row for every frame of a segment, in the columns of HIT_COLUMNS.

    frames: key, frame, x, y (null where unseen); details: key, frame and those of the columns from Reason on that are known
    of candidates; hits: key, frame. Unseen points lie at 0, 0; cells of frames without details are null, empty in CSV.
    """
    known = [c for c in HIT_COLUMNS[5:] if c in details.columns]
    rows = frames.select(key, F.col("frame").alias("Frame"), "x", "y")
    rows = rows.join(details.select(key, F.col("frame").alias("Frame"), *known), [key, "Frame"], "left")
    rows = rows.join(hits.select(key, F.col("frame").alias("Frame"), F.lit(1).alias("Hit")).distinct(), [key, "Frame"], "left")
    seen = F.col("x").isNotNull()
    at = lambda c: F.when(seen, F.rint(c).cast("long")).otherwise(0)
    made = {"Visibility": seen.cast("int"), "X": at("x"), "Y": at("y"), "Hit": F.coalesce("Hit", F.lit(0))}
    return rows.select(key, *((made.get(c) if c in made else F.col(c) if c in ["Frame", *known] else F.lit(None).cast("string")).alias(c) for c in HIT_COLUMNS))


def stroke_table(hits: DataFrame, classes: list[str], unknown: int, top: list[int], bottom: list[int], best: int = 3) -> DataFrame:
    """The stroke debug table, in the columns of STROKE_COLUMNS and Top1 to Top`best`.

    hits: event, frame, segment, local_frame, win_start, win_end, player, stroke, confidence and p, the classes' probabilities.
    """
    names = F.array(*map(F.lit, classes))
    total = lambda own: sum((F.get("p", F.lit(i)) for i in own), F.lit(0.0))
    four = lambda c: F.format_string("%.4f", c)
    order = F.array_sort(F.transform("p", lambda v, i: F.struct((-v).alias("v"), (-i).alias("i"))))  # of equal ones the last first
    ranked = F.transform(order, lambda o: F.concat(F.get(names, -o["i"]), F.lit("("), F.format_string("%.0f%%", F.rint(-o["v"] * 100)), F.lit(")")))
    first = F.get(names, F.array_position("p", F.array_max("p")).cast("int") - 1)
    made = [F.col("event"), F.col("frame"), F.col("segment"), F.col("local_frame"), F.col("win_start"), F.col("win_end"), F.col("win_end") - F.col("win_start"), F.coalesce("player", F.lit("")), F.col("stroke"), four(F.col("confidence")), first, four(F.get("p", F.lit(unknown))), four(total(top)), four(total(bottom))]
    return hits.select(*(c.alias(n) for n, c in zip(STROKE_COLUMNS, made, strict=True)), *(F.get(ranked, F.lit(i)).alias(f"Top{i + 1}") for i in range(best)))


def write_csv_with_mark(df: DataFrame, path: str) -> None:
    """CSV files whose first column's name begins with a byte-order mark, as spreadsheet programs want UTF-8."""
    df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]).write.option("header", True).csv(path)
