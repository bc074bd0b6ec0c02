"""Composed stages: scores to segments, hits to their labels, and tracks. `hits` has those from series to hits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions import scalars
from ..operators import bands, folds, runs, stats
from ..sources.shared import written


@dataclass(frozen=True)
class SegmentRules:
    fps: float = 25.0
    merge_gap: int = 4
    min_seconds: float = 0.2
    outlier: float = 3.0
    widest: float = 0.10
    final_gap: int = 1
    bridge: int = 12
    spike: float = 25.0
    over_median: float = 3.0
    around: int = 6


def low_segments(scores: DataFrame, key: str, frame: str, score: str, rules: SegmentRules, excluded: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Runs of scores under a threshold from their histogram, merged over short gaps, without the short ones; and the scores, written.

    Frames that are excluded (key, frame) don't count for the threshold and lie in no run, though a short gap may be merged over
    them. Where the scores are those of a single scene, all the others are low. The threshold is a one-row table.
    """
    out = F.lit(False)
    scores = scores.select(key, frame, score)
    if excluded is not None:
        scores = scores.join(excluded.select(key, frame).distinct().withColumn("_out", F.lit(True)), [key, frame], "left")
        out = F.col("_out").isNotNull()
    scores = written(scores.withColumn("_out", out))
    counted = scores.where(~F.col("_out"))
    alone = counted.agg((F.max(score) + 1).alias("_top")).join(stats.single_scene(counted, score))  # a row each
    bar = written(stats.otsu3(counted, F.col(score)).join(alone).select(F.when(F.col("single_scene"), F.col("_top")).otherwise(F.col("threshold")).alias("threshold")))
    rows = scores.join(F.broadcast(bar)).withColumn("_low", (F.col(score) < F.col("threshold")) & ~F.col("_out"))
    found = runs.mask_runs(rows, key, frame, F.col("_low"))
    found = runs.merge_intervals(found, key, "start_frame", "end_frame", rules.merge_gap).select(key, "start_frame", "end_frame")
    n = F.col("end_frame") - F.col("start_frame") + 1
    return written(found.where(n >= F.ceil(F.lit(rules.min_seconds * rules.fps)))), scores


def cross_averages(found: DataFrame, vectors: DataFrame, key: str, frame: str, values: str) -> DataFrame:
    """found with level: how far a segment's two middle frames are, on average, from those of all other segments (whole numbers).

    Distances are mean absolute differences of vectors (key, frame, values); no pairs are made. A single segment has 0; a segment
    without vectors of both frames has null.
    """
    halves = geo.middle_frames(F.col("start_frame"), F.col("end_frame"))
    two = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), f.alias("f")) for i, f in enumerate(halves))))
    wanted = found.select(key, "start_frame", two.alias("m")).select(key, "start_frame", "m.i", F.col("m.f").alias(frame))
    held = wanted.join(vectors.select(key, frame, F.col(values).alias("_v")), [key, frame])
    held = written(held.withColumn("_id", F.concat_ws("/", F.col(key).cast("string"), "start_frame", "i")))
    totals = stats.absolute_differences(held, "_id", "_v")
    each = held.join(totals, "_id").groupBy(key, "start_frame").agg(F.sum("total").alias("all"), F.max(F.when(F.col("i") == 0, F.col("_v"))).alias("a"), F.max(F.when(F.col("i") == 1, F.col("_v"))).alias("b"))
    own = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, d: s + d)
    n = found.agg((F.count("*") - 1).alias("others"))
    level = F.when(F.col("others") == 0, 0).otherwise(F.rint((F.col("all") - 2 * own) / F.size("a") / (F.col("others") * 4)))
    return found.join(each.join(F.broadcast(n)).select(key, "start_frame", level.cast("long").alias("level")), [key, "start_frame"], "left")


def alike(found: DataFrame, vectors: DataFrame, key: str, frame: str, values: str, rules: SegmentRules) -> DataFrame:
    """The segments near the one that is nearest to all others, within a share that is wider for fewer segments, without the outliers of these."""
    told = written(cross_averages(found, vectors, key, frame, values))
    bar = told.agg(F.min("level").alias("_least"), F.count("*").cast("double").alias("_n"))
    near = told.join(F.broadcast(bar)).where(F.col("level") <= F.rint(F.col("_least") * (1 + geo.widening(F.col("_n"), most=rules.widest))))
    near = written(near.select(key, "start_frame", "end_frame"))
    again = written(cross_averages(near, vectors, key, frame, values))
    return stats.reject_outliers(again, "level", rules.outlier).select(key, "start_frame", "end_frame")


def cut_between(found: DataFrame, jumps: DataFrame, key: str, frame: str, jump: str, rules: SegmentRules) -> DataFrame:
    """Segments joined over gaps of at most `bridge` frames without a cut, and their ends moved to cuts near by: key, start_frame, end_frame.

    jumps: key, frame, and how much a frame differs from the one before. A cut is a jump of `spike` at least; at an end it must
    also be the greatest within `around` frames and `over_median` times their median.
    """
    w = Window.partitionBy(key).orderBy("start_frame")
    rows = found.withColumn("_before", F.lag("end_frame").over(w))
    gaps = rows.where((F.col("_before") < F.col("start_frame")) & (F.col("start_frame") - F.col("_before") - 1 <= rules.bridge))
    gaps = written(gaps.select(key, (F.col("_before") + 1).alias("_a"), F.col("start_frame").alias("_z"), F.col("start_frame").alias("_i")))
    inside = bands.locate(jumps.select(key, frame, jump), gaps, key, frame, "_a", "_z", "_i").where("_i is not null")
    top = inside.groupBy(key, F.col("_i").alias("start_frame")).agg(F.max(jump).alias("_top"))
    small = gaps.select(key, F.col("_i").alias("start_frame"), F.lit(True).alias("_small"))
    rows = rows.join(small, [key, "start_frame"], "left").join(top, [key, "start_frame"], "left")
    joined = F.coalesce(F.col("_small") & (F.col("_top").isNull() | (F.col("_top") < rules.spike)), F.lit(False))
    rows = rows.withColumn("_run", F.sum((~joined).cast("int")).over(w)).groupBy(key, "_run").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"))
    rows = written(rows.drop("_run"))
    for end, name in (("start_frame", "_first"), ("end_frame", "_after")):
        about = bands.band_join(rows.select(key, F.col(end).alias(frame)), jumps.where(F.col(jump).isNotNull()).select(key, frame, jump), key, frame, rules.around)
        told = about.groupBy(key, F.col(frame).alias(end)).agg(F.median(f"r_{jump}").alias("_med"), F.max(f"r_{jump}").alias("_top"), F.max_by(f"r_{frame}", F.struct(F.col(f"r_{jump}"), -F.col(f"r_{frame}"))).alias(name))
        told = told.where((F.col("_top") >= rules.spike) & (F.col("_top") >= rules.over_median * F.greatest("_med", F.lit(1.0))))
        rows = rows.join(told.select(key, end, name), [key, end], "left")
    return folds.refine_boundaries(rows, key, "start_frame", "end_frame", "_first", "_after")


def segment_scores(
    scores: DataFrame, key: str, frame: str, score: str, rules: SegmentRules = SegmentRules(), excluded: DataFrame | None = None,
    vectors: DataFrame | None = None, values: str = "v", jumps: DataFrame | None = None, jump: str = "jump",
) -> DataFrame:
    """Motion scores to segments in seconds: low runs, merged and without the short ones; those that look like the others; joined again and cut.

    See low_segments, alike (with vectors of frames; without them the segments whose mean score is odd are dropped) and cut_between (with jumps).
    """
    found, scores = low_segments(scores, key, frame, score, rules, excluded)
    if vectors is None:
        inside = bands.locate(scores.select(key, frame, score), found.withColumn("i", F.col("start_frame")), key, frame, "start_frame", "end_frame", "i")
        level = inside.where("i is not null").groupBy(key, F.col("i").alias("start_frame")).agg(F.avg(score).alias("level"))
        found = stats.reject_outliers(written(found.join(level, [key, "start_frame"])), "level", rules.outlier).select(key, "start_frame", "end_frame")
    else:
        found = alike(found, vectors, key, frame, values, rules)
    if jumps is not None:
        found = runs.merge_intervals(found, key, "start_frame", "end_frame", rules.final_gap).select(key, "start_frame", "end_frame")
        found = cut_between(written(found), jumps, key, frame, jump, rules)
    return found.select(key, "start_frame", "end_frame").withColumns(geo.segment_seconds(F.col("start_frame"), F.col("end_frame"), rules.fps))


CLASSES = [f"{side}_{kind}" for side in ("top", "bottom") for kind in ("clear", "drop", "smash", "net")]


def stub_model() -> Callable[[np.ndarray], np.ndarray]:
    """Loads a model's stand-in: softmax of fixed projections, so results can be repeated. A row's result doesn't depend on the rows beside it."""
    weights: dict[int, np.ndarray] = {}

    def predict(windows: np.ndarray) -> np.ndarray:
        n = windows.shape[1]
        w = weights.setdefault(n, np.cos(np.arange(n)[:, None] * np.arange(1, 2 + len(CLASSES))))
        z = np.einsum("ij,jk->ik", windows, w) / max(1, n)  # not a matrix product, whose sums depend on the number of rows
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    return predict


def classify_hits(hits: DataFrame, series: DataFrame, key: str, frame: str, value: str, half: int = 5, load: Callable[[], Callable[[np.ndarray], np.ndarray]] = stub_model, batch: int = 1000) -> DataFrame:
    """Labels each hit by a model over its window of 2 * half + 1 values, 0 where one is missing.

    A worker loads the model once (load) and asks it for batches of at most `batch` windows, as an array (rows, 2 * half + 1) of doubles.
    """
    near = bands.band_join(hits.select(key, frame), series.select(key, frame, value), key, frame, half)
    at = (F.col(f"r_{frame}") - F.col(frame) + half).cast("int")
    rows = near.groupBy(key, frame).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), F.col(f"r_{value}").cast("double").alias("v")))).alias("m"))
    window = F.transform(F.sequence(F.lit(0), F.lit(2 * half)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    ask = predict_batch_udf(load, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[2 * half + 1]])
    scored = rows.select(key, frame, ask(window).alias("p"))
    label, conf = scalars.probability_label(F.col("p"), ["unknown", *CLASSES], 0)
    return scored.select(key, frame, label.alias("label"), conf.alias("confidence"))


def track(candidates: DataFrame, key: str, frame: str, x: str, y: str, conf: str, frames: DataFrame, confident: float = 0.8, window: int = 8, longest: int = 10) -> DataFrame:
    """Candidates to a track: the best path, only near confident points, over every frame, short gaps filled on a line.

    Filled points have confidence 0; longer gaps, and those at an edge, stay null.
    """
    path = folds.viterbi_path(candidates, key, frame, x, y, conf)
    path = bands.band_aggregate(path, key, frame, -window, window, best=F.max(conf)).where(F.col("best") >= confident).drop("best")
    dense = frames.select(key, frame).join(path, [key, frame], "left")
    gaps = bands.null_gaps(dense, key, frame, x).where((F.col("n") <= longest) & F.col("left_value").isNotNull() & F.col("right_value").isNotNull())
    gaps = gaps.select(key, "start", "end").withColumn("i", F.col("start"))
    filled = bands.fill_linear(bands.fill_linear(dense, key, frame, x, "fx"), key, frame, y, "fy")
    inside = bands.locate(filled, gaps, key, frame, "start", "end", "i")
    seen = F.col(x).isNotNull()
    keep = seen | F.col("i").isNotNull()
    return inside.select(key, frame, F.when(keep, F.col("fx")).alias(x), F.when(keep, F.col("fy")).alias(y), F.when(seen, F.col(conf)).when(keep, 0.0).alias(conf), keep.alias("visible"))


def repair(dense: DataFrame, key: str, frame: str, value: str, margin: float) -> DataFrame:
    """Fills the gaps of a value that was in view (above margin) on both sides: key, frame, value, repaired.

    A gap at the start is judged by, and takes, the value after it; one at the end stays. This is the stand-in for a model.
    """
    gaps = bands.null_gaps(dense, key, frame, value).where((F.col("right_value") > margin) & (F.col("left_value").isNull() | (F.col("left_value") > margin)))
    filled = bands.fill_linear(dense.select(key, frame, value), key, frame, value, "_line")
    inside = bands.locate(filled, gaps.withColumn("_end", F.col("end")), key, frame, "start", "_end", "right_value")
    ok = F.col(value).isNull() & F.col("right_value").isNotNull()
    return inside.select(key, frame, F.when(ok, F.coalesce("_line", "right_value")).otherwise(F.col(value)).alias(value), ok.alias("repaired"))


def decide_sides(hits: DataFrame, dense: DataFrame, key: str, frame: str, side: str, far: str, near: str, snap: int = 4, clear: float = 1.5) -> DataFrame:
    """A side for each hit: that of the nearest known frame within snap, or else of the player whose wrist is clearly nearer (far: distance of top, near: of bottom)."""
    known = bands.nearest_in_ring(dense, key, frame, F.col(side), snap, "_known").select(key, frame, "_known", far, near)
    by_wrist = F.when(F.col(far) * clear <= F.col(near), "top").when(F.col(near) * clear <= F.col(far), "bottom")
    return hits.select(key, frame).join(known, [key, frame]).select(key, frame, F.coalesce("_known", by_wrist).alias(side))
