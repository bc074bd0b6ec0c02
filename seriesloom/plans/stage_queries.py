"""Queries of composed stages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds
from ..sources.shared import written
from . import hits, hits_by_key, stages
from .registry import frames, query, r4

#: Rules at the scale of users' events, of which a key has some dozens.
SELECT = hits.HitRules(around=6, y_swing=60, x_swing=70, apart=4, company=1, context=12, weak_y=3, weak_x=20)
COMPLETE = hits.CompletionRules(
    fuse=1, min_sep=2, alt_gap=5, alt_margin=2, alt_run=1, alt_conf=0.3, lock_run=2, lock_conf=0.5, lock_guard=1, onset_run=1, onset_conf=0.4,
    rescue_onset=1, rescue_conf=0.4, rescue_near=2, rescue_tail=20, serve_near=3, serve_conf=0.2, serve_side="bottom", serve_snap=2,
)
PRUNE = hits.PruneRules(
    span_run=1, span_conf=0.5, span_lead=2, span_tail=10, tail_run=2, tail_conf=0.5, tail_margin=2, tail_y=95, tail_x=95,
    gate_tail=4, gate_onset=2, gate_y=98, gate_x=98, onset_run=2, onset_conf=0.3, serve_run=1, serve_conf=0.2,
)
SERVE = "label = 'signup'"


@query("J15_segment_scores")
def j15(spark, sf):
    rows = frames(spark, sf)
    before = F.lag("y").over(Window.partitionBy("seg").orderBy("frame"))
    jumps = rows.select("seg", "frame", F.abs(F.col("y") - before).alias("jump"))
    vectors = rows.select("seg", "frame", F.array(F.col("x").cast("double"), F.col("y") / 2).alias("v"))
    rules = stages.SegmentRules(widest=0.4, bridge=3, spike=70.0, around=3)
    return stages.segment_scores(rows, "seg", "frame", "y", rules, rows.where("frame % 40 = 11").select("seg", "frame"), vectors, "v", jumps)


def tracks(spark, sf):
    """A track of each user's events, one that runs against it, and labels with confidence. Events are numbered once, and the three read that table."""
    rows = written(frames(spark, sf).select("seg", "frame", "x", "y", "side", F.when(F.col("label") != "error", F.col("label")).alias("label")))
    seen = rows.withColumn("x", F.when(F.col("frame") % 9 != 0, F.col("x")))
    return seen, seen.withColumn("y", 100 - F.col("y")), rows.withColumn("conf", F.col("x") / 100)


@query("J14_detect_hits")
def j14(spark, sf):
    return detected(spark, sf, hits_by_key.detect_hits)


def detected(spark, sf, way):
    seen, aux, dense = tracks(spark, sf)
    scores = seen.groupBy("seg").agg(F.count("*").alias("n")).select(F.lit(0).alias("match"), "seg", F.when(F.col("seg") % 5 < 2, 0).otherwise(F.col("seg") % 11).alias("a"), F.when(F.col("seg") % 5 < 2, 0).otherwise(3).alias("b"))
    dead = hits.dead_keys(scores, dense, "match", "seg", "frame", "a", "b", SERVE, PRUNE)
    return way(seen, aux, dense, "seg", "frame", "x", "y", "side", SERVE, dead, SELECT, COMPLETE, PRUNE, **SIGNALS)


#: Signals of a contact at that scale.
SIGNALS = {"apart": 3, "spacing": 3, "clear": 0}


def chosen(spark, sf):
    """Each track's candidates, and the hits among them."""
    found = []
    for track in tracks(spark, sf)[:2]:
        swing = hits.swings(track, "seg", "frame", "x", "y", "side", SELECT.around)
        candidates = folds.contact_candidates(track, "seg", "frame", "x", "y", **SIGNALS).select("seg", "frame")
        found.append((candidates, hits.select_hits(candidates, swing, "seg", "frame", "side", SELECT)))
    return found


def evidence(spark, sf):
    """The hits of the track, those of the one that runs against it, and weak points, rises and rejected candidates."""
    seen, _, dense = tracks(spark, sf)
    found = [(c, k.select("seg", "frame")) for c, k in chosen(spark, sf)]
    base, aux = (k.join(seen.select("seg", "frame", "side"), ["seg", "frame"]) for _, k in found)
    weak = folds.weak_points(seen, "seg", "frame", "x", "y", 40, 60).join(seen.select("seg", "frame", "side", "y"), ["seg", "frame"])
    weak = weak.select("seg", "frame", "side", "strength", "is_peak", (F.col("y") > 80).alias("swings"))
    rises = folds.first_rises(seen, "seg", "frame", "y", steps=2, total=20.0)
    rejected = [c.join(k, ["seg", "frame"], "left_anti") for c, k in found]
    return base, aux, weak, dense, rises, rejected[0].union(rejected[1]).distinct()


@query("J11_complete_hits")
def j11(spark, sf):
    weak = replace(SELECT, weak_y=40, weak_x=60)
    return hits_by_key.complete_hits(*tracks(spark, sf), "seg", "frame", "x", "y", "side", weak, COMPLETE, 80.0, {"steps": 2, "total": 20.0}, **SIGNALS)


@query("J12_prune_hits")
def j12(spark, sf):
    seen, _, dense = tracks(spark, sf)
    swing = hits.swings(seen, "seg", "frame", "x", "y", "side", SELECT.around)
    return hits.prune_hits(chosen(spark, sf)[1][0].join(seen.select("seg", "frame", "side"), ["seg", "frame"]), swing, dense, "seg", "frame", SERVE, PRUNE)


@query("K07_classify_hits")
def k07(spark, sf):
    rows = frames(spark, sf)
    found = rows.where("label = 'click'").select("seg", "frame")
    return stages.classify_hits(found, rows, "seg", "frame", "y").withColumn("confidence", r4(F.col("confidence")))
