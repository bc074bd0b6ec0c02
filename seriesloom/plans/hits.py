"""Series to hits: signals and gates, the gaps that structure shows, pruning, and the scoreboard.

Besides the series itself (key, frame, x, y and side on every frame, x and y null where nothing is seen) the later
phases read `dense`, a classifier's best label on every frame: key, frame, label (null: unknown), side and conf.
Keys are segments of a recording, which are bounded. What several rules use is written once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import bands, folds, runs
from ..sources.shared import written


# The rules' bounds, in frames, pixels and confidence.
@dataclass(frozen=True)
class HitRules:
    around: int = 18
    y_swing: float = 100
    x_swing: float = 40
    apart: int = 18
    company: int = 2
    context: int = 140
    weak_y: float = 3
    weak_x: float = 20


@dataclass(frozen=True)
class CompletionRules:
    fuse: int = 4
    min_sep: int = 5
    alt_gap: int = 10
    alt_margin: int = 8
    alt_run: int = 3
    alt_conf: float = 0.55
    lock_run: int = 7
    lock_conf: float = 0.65
    lock_guard: int = 12
    onset_run: int = 3
    onset_conf: float = 0.55
    rescue_onset: int = 8
    rescue_conf: float = 0.6
    rescue_near: int = 8
    rescue_tail: int = 40
    serve_near: int = 12
    serve_conf: float = 0.4
    serve_side: str = "bottom"
    serve_snap: int = 4


@dataclass(frozen=True)
class PruneRules:
    span_run: int = 3
    span_conf: float = 0.75
    span_lead: int = 6
    span_tail: int = 220
    tail_run: int = 4
    tail_conf: float = 0.5
    tail_margin: int = 4
    tail_y: float = 450
    tail_x: float = 300
    gate_tail: int = 40
    gate_onset: int = 8
    gate_y: float = 400
    gate_x: float = 280
    onset_run: int = 3
    onset_conf: float = 0.5
    serve_run: int = 3
    serve_conf: float = 0.4


def swings(series: DataFrame, key: str, frame: str, x: str, y: str, side: str, around: int) -> DataFrame:
    """key, frame, side, yamp and xamp: how far y and x range within `around` frames; null where fewer than five points are seen."""
    seen = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    rows = series.select(key, frame, side, seen["x"].alias("_x"), seen["y"].alias("_y"))
    rows = bands.band_aggregate(rows, key, frame, -around, around, n=F.count("_x"), x0=F.min("_x"), x1=F.max("_x"), y0=F.min("_y"), y1=F.max("_y"))
    enough = F.col("n") >= 5
    return rows.select(key, frame, side, F.when(enough, F.col("y1") - F.col("y0")).alias("yamp"), F.when(enough, F.col("x1") - F.col("x0")).alias("xamp"))


def select_hits(candidates: DataFrame, swing: DataFrame, key: str, frame: str, side: str, rules: HitRules = HitRules()) -> DataFrame:
    """The candidates that swing enough, thinned in order by side, with company on the other side: key, frame, side.

    Where too little is seen to measure a swing, a candidate passes, and counts as the strongest. One of unknown side needs no company.
    """
    rows = candidates.select(key, frame).join(swing, [key, frame])
    rows = rows.where(F.col("yamp").isNull() | (F.col("yamp") >= rules.y_swing) | (F.col("xamp") >= rules.x_swing))
    kept = folds.greedy_dedup(rows.withColumn("_strength", F.col("yamp") + F.col("xamp")), key, frame, side, "_strength", rules.apart)
    counts = {f"_{s}": F.count_if(F.col(side) == s) for s in ("top", "bottom")}
    kept = bands.band_aggregate(kept, key, frame, -rules.context, rules.context, **counts)
    others = F.when(F.col(side) == "top", F.col("_bottom")).otherwise(F.col("_top"))
    return kept.where(F.col(side).isNull() | (others >= rules.company)).select(key, frame, side)


def lock_regions(dense: DataFrame, key: str, frame: str, least: int, conf: float) -> DataFrame:
    """Runs of one label on consecutive frames, long enough and with a confident peak: key, label, f0, f1."""
    found = runs.label_runs(dense, key, frame, "label", 1, "conf")
    return found.where((F.col("n") >= least) & (F.col("peak") >= conf)).select(key, "label", "f0", "f1")


def known_runs(dense: DataFrame, key: str, frame: str, least: int, conf: float, by: Column | None = None) -> DataFrame:
    """Runs of frames whose label is known and confident on each, by a side if given: key, by, f0, f1, n, mean_conf, center."""
    rows = dense.where(F.col("label").isNotNull() & (F.col("conf") >= conf)).withColumn("by", F.lit("any") if by is None else by)
    return runs.label_runs(rows, key, frame, "by", 1, "conf").where(F.col("n") >= least)


def _nearest(at: str, low: Column | None = None, high: Column | None = None) -> Column:
    """Of below and above the one nearer to `at`, the lower of two; where bounds are given, of those within them."""
    ok = [c if low is None else F.when(c.between(low, high), c) for c in (F.col("below"), F.col("above"))]
    a, z = F.col(at) - ok[0], ok[1] - F.col(at)
    return F.when(z.isNull() | (a <= z), ok[0]).otherwise(ok[1])


def _distance(at: str) -> Column:
    return F.least(F.col(at) - F.col("below"), F.col("above") - F.col(at))


def alternation(hits: DataFrame, pool: DataFrame, weak: DataFrame, dense: DataFrame, key: str, frame: str, side: str, rules: CompletionRules) -> DataFrame:
    """R1: a hit of the other side between two in a row of one side: key, frame, source.

    The strongest weak point of the other side; else the pool's point nearest to the middle that is not of the same side; else the
    centre of the longest run of confident labels of the other side. Margins keep additions apart from hits and each other.
    """
    if rules.alt_margin < rules.min_sep:
        raise ValueError("alt_margin must be at least min_sep")
    w = Window.partitionBy(key).orderBy(frame)
    gaps = hits.select(key, F.col(frame).alias("lo"), F.lead(frame).over(w).alias("hi"), F.col(side).alias("s"), F.lead(side).over(w).alias("t"))
    a, z = F.col("lo") + rules.alt_margin, F.col("hi") - rules.alt_margin
    gaps = gaps.where((F.col("hi") - F.col("lo") >= rules.alt_gap) & (F.col("s") == F.col("t")) & (a <= z))
    gaps = written(gaps.select(key, a.alias("a"), z.alias("z"), F.struct("lo", "hi", "s").alias("gap")))
    lo, hi, same = F.col("gap.lo"), F.col("gap.hi"), F.col(side) == F.col("gap.s")

    def inside(points: DataFrame, order: str) -> DataFrame:
        return bands.locate(points, gaps, key, order, "a", "z", "gap").where("gap is not null")

    def best(rows: DataFrame, rank: int, source: str, pick: Column) -> DataFrame:
        return rows.groupBy(key, lo.alias("lo")).agg(pick.cast("long").alias(frame)).withColumns({"rank": F.lit(rank), "source": F.lit(source)})

    first = best(inside(weak.select(key, frame, side, "strength"), frame).where(~same), 0, "sens", F.max_by(frame, F.struct(F.col("strength"), -F.col(frame))))
    second = inside(pool.select(key, frame, side), frame).where(F.coalesce(~same, F.lit(True)))
    second = best(second, 1, "refine", F.min_by(frame, F.struct(F.abs(2 * F.col(frame) - lo - hi), F.col(frame))))
    held = known_runs(dense.where("side is not null"), key, frame, rules.alt_run, rules.alt_conf, F.col("side"))
    held = inside(held.select(key, F.col("by").alias(side), "f0", "f1", "n", "mean_conf", "center"), "f0")
    held = held.where(~same & (F.col("f0") > lo + rules.alt_margin) & (F.col("f1") < hi - rules.alt_margin))
    third = best(held, 2, "dense", F.max_by(F.rint("center"), F.struct(F.col("n"), F.col("mean_conf"), -F.col("f0"))))
    found = first.unionByName(second).unionByName(third)
    found = found.groupBy(key, "lo").agg(F.min_by(F.struct(frame, "source"), "rank").alias("b"))
    return found.select(key, f"b.{frame}", "b.source")


def unclaimed_regions(hits: DataFrame, pool: DataFrame, weak: DataFrame, dense: DataFrame, key: str, frame: str, rules: CompletionRules) -> DataFrame:
    """R2: a hit in each lock region that none lies near: key, frame, source.

    The weak peak nearest to the region's centre if it swings enough (column swings), else the pool's point nearest to it. In order, so that
    a hit found for one region claims the next that it lies near.
    """
    lo, hi = F.col("f0") - rules.lock_guard, F.col("f1") + rules.lock_guard
    regions = lock_regions(dense, key, frame, rules.lock_run, rules.lock_conf).select(key, lo.alias("lo"), hi.alias("hi"), ((F.col("f0") + F.col("f1")) / 2).alias("c"))
    free = bands.beside(regions, hits, key, "lo", frame).where(F.col("above").isNull() | (F.col("above") > F.col("hi"))).drop("below", "above")
    for name, points in (("_weak", weak.where("is_peak")), ("_pool", pool)):
        free = bands.beside(free, points, key, "c", frame).withColumn(name, _nearest("c", F.col("lo"), F.col("hi"))).drop("below", "above")
    sure = weak.where("is_peak and swings").select(key, F.col(frame).alias("_weak"), F.lit(True).alias("_sure"))
    free = free.join(sure, [key, "_weak"], "left").withColumn("_weak", F.when(F.col("_sure"), F.col("_weak")))
    source = F.when(F.col("_weak").isNotNull(), "sens").otherwise("refine")
    picked = free.select(key, "lo", F.coalesce("_weak", "_pool").alias(frame), source.alias("source")).where(F.col(frame).isNotNull())
    return folds.first_come(picked, key, "lo", frame).select(key, frame, "source")


def _evidence(points: DataFrame, dense: DataFrame, key: str, at: str, frame: str, width: int) -> DataFrame:
    """points with the best confidence of a known label within `width` frames, 0 if none, and the side of most confidence, the first seen of two."""
    known = dense.where(F.col("label").isNotNull()).select(key, F.col(frame).alias(at), "side", "conf")
    near = bands.band_join(points, known, key, at, width, "left")
    votes = [F.struct(F.sum(F.when(F.col("r_side") == s, F.col("r_conf"))).alias("v"), -F.min(F.when(F.col("r_side") == s, F.col(f"r_{at}"))).alias("f"), F.lit(s).alias("s")) for s in ("top", "bottom")]
    top, bottom = votes
    voted = F.when(top["v"].isNull() & bottom["v"].isNull(), F.lit(None)).otherwise(F.greatest(*votes)["s"])
    return near.groupBy(*points.columns).agg(F.coalesce(F.max("r_conf"), F.lit(0.0)).alias("_conf"), voted.alias("_voted"))


def rescued_onsets(hits: DataFrame, pool: DataFrame, dense: DataFrame, key: str, frame: str, rules: CompletionRules) -> DataFrame:
    """R3: the pool's points on an onset of confident labels, away from hits, with a hit soon after: key, frame, source."""
    rows = bands.beside(pool.select(key, frame), hits, key, frame, frame)
    rows = rows.where((_distance(frame) > rules.rescue_near) & (F.col("above") - F.col(frame) <= rules.rescue_tail)).drop("below", "above")
    onsets = known_runs(dense, key, frame, rules.onset_run, rules.onset_conf)
    rows = bands.beside(rows, onsets, key, frame, "f0").where(_distance(frame) <= rules.rescue_onset).drop("below", "above")
    rows = _evidence(rows, dense, key, frame, frame, 3).where(F.col("_conf") >= rules.rescue_conf)
    alike = rows.select(key, frame, F.lit("").alias("_s"), F.lit(0.0).alias("_v"))
    return folds.greedy_dedup(alike, key, frame, "_s", "_v", rules.rescue_near + 1).select(key, frame, F.lit("refine").alias("source"))


def missing_serve(hits: DataFrame, rises: DataFrame, rejected: DataFrame, dense: DataFrame, key: str, frame: str, rules: CompletionRules) -> DataFrame:
    """R4: the serve at the first sustained rise, if no hit is near and labels about it are of its side; at a rejected candidate near by, if any."""
    rows = bands.beside(rises.select(key, "rise"), hits, key, "rise", frame)
    rows = rows.where(F.coalesce(_distance("rise") > rules.serve_near, F.lit(True))).select(key, "rise")
    rows = _evidence(rows, dense, key, "rise", frame, 4).where((F.col("_conf") >= rules.serve_conf) & (F.col("_voted") == rules.serve_side))
    rows = bands.beside(rows.select(key, "rise"), rejected, key, "rise", frame)
    at = F.coalesce(_nearest("rise", F.col("rise") - rules.serve_snap, F.col("rise") + rules.serve_snap), F.col("rise"))
    return rows.select(key, at.alias(frame), F.lit("serve").alias("source"))


def complete_hits(
    base: DataFrame, aux: DataFrame, weak: DataFrame, dense: DataFrame, rises: DataFrame, rejected: DataFrame, key: str, frame: str, side: str, rules: CompletionRules = CompletionRules()
) -> DataFrame:
    """Hits and what four rules add to them, each of which sees the additions of those before: key, frame, source and tag.

    base and aux: hits of two tracks, with sides; an aux hit near a base hit is the same. weak: see folds.weak_points, with side and swings.
    rises: key, rise. rejected: candidates that are no hits.
    """
    pool = written(bands.band_join(aux.select(key, frame, side), base.select(key, frame), key, frame, rules.fuse, "left_anti"))
    hits = written(base.select(key, frame, F.lit("ball").alias("source"), F.lit("").alias("tag")))

    def added(found: DataFrame, tag: str) -> DataFrame:
        return written(hits.unionByName(found.withColumn("tag", F.lit(tag))))

    hits = added(alternation(base, pool, weak, dense, key, frame, side, rules), "alt_fill")
    hits = added(unclaimed_regions(hits, pool, weak, dense, key, frame, rules), "lock_fill")
    hits = added(rescued_onsets(hits, pool, dense, key, frame, rules), "rescue")
    return added(missing_serve(hits, rises, rejected, dense, key, frame, rules), "serve_fill")


def prune_hits(hits: DataFrame, swing: DataFrame, dense: DataFrame, key: str, frame: str, serve: str, rules: PruneRules = PruneRules()) -> DataFrame:
    """The hits within the rally's span, without small swings after the last lock region or, at the end, far from an onset.

    serve: the condition, in SQL, of a label of a serve. A key without serves has no span; one without labels keeps all its hits.
    """
    regions = lock_regions(dense, key, frame, rules.span_run, rules.span_conf)
    span = regions.groupBy(key).agg(F.min(F.when(F.expr(serve), F.col("f0"))).alias("_a"), F.max("f1").alias("_z"))
    rows = hits.join(span, key, "left")
    within = F.col(frame).between(F.col("_a") - rules.span_lead, F.col("_z") + rules.span_tail)
    rows = rows.where(F.coalesce(within, F.lit(True))).drop("_a", "_z").join(swing.select(key, frame, "yamp", "xamp"), [key, frame], "left")
    tails = lock_regions(dense, key, frame, rules.tail_run, rules.tail_conf).groupBy(key).agg(F.max("f1").alias("_z"))
    small = (F.col(frame) > F.col("_z") + rules.tail_margin) & (F.col("yamp") < rules.tail_y) & (F.col("xamp") < rules.tail_x)
    rows = rows.join(tails, key, "left").where(~F.coalesce(small, F.lit(False))).drop("_z")
    rows = bands.beside(rows, known_runs(dense, key, frame, rules.onset_run, rules.onset_conf), key, frame, "f0")
    rows = rows.join(dense.select(key).distinct().withColumn("_told", F.lit(True)), key, "left")
    far = F.coalesce(_distance(frame) >= rules.gate_onset, F.lit(True))
    weak = F.col("_told") & far & (F.col("yamp") < rules.gate_y) & (F.col("xamp") < rules.gate_x)
    return folds.prune_tail(rows, key, frame, ~F.coalesce(weak, F.lit(False)), rules.gate_tail).select(*hits.columns)


def dead_keys(scores: DataFrame, dense: DataFrame, match: str, key: str, frame: str, a: str, b: str, serve: str, rules: PruneRules = PruneRules()) -> DataFrame:
    """Keys (segments, in order within their match) in a run of one break score, before the run's last one with a serve: key."""
    confident = dense.where(F.expr(serve) & (F.col("conf") >= rules.serve_conf))
    serves = runs.label_runs(confident.withColumn("_s", F.lit("serve")), key, frame, "_s", 1).where(F.col("n") >= rules.serve_run)
    rows = scores.select(match, key, a, b).join(serves.select(key).distinct().withColumn("_served", F.lit(True)), key, "left")
    is_break = F.coalesce(scalars.break_score(F.col(a), F.col(b)), F.lit(False))
    return runs.dead_rows(rows, match, key, F.struct(a, b), F.col("_served"), is_break).select(key)


def detect_hits(
    series: DataFrame, aux: DataFrame, dense: DataFrame, key: str, frame: str, x: str, y: str, side: str, serve: str, dead: DataFrame | None = None,
    select: HitRules = HitRules(), complete: CompletionRules = CompletionRules(), prune: PruneRules = PruneRules(), **signals: float,
) -> DataFrame:
    """Two tracks of an object to hits: signals and gates on each, completion, pruning, and no hits in dead keys: key, frame, side, source, tag."""
    series, aux, dense = (written(d) for d in (series.select(key, frame, x, y, side), aux.select(key, frame, x, y, side), dense.select(key, frame, "label", "side", "conf")))
    swing = written(swings(series, key, frame, x, y, side, select.around))
    candidates, kept = [], []
    for track, swung in ((series, swing), (aux, swings(aux, key, frame, x, y, side, select.around))):
        candidates.append(written(folds.contact_candidates(track, key, frame, x, y, **signals).select(key, frame)))
        kept.append(written(select_hits(candidates[-1], swung, key, frame, side, select)))
    rejected = [c.join(k.select(key, frame), [key, frame], "left_anti") for c, k in zip(candidates, kept, strict=True)]
    weak = folds.weak_points(series, key, frame, x, y, select.weak_y, select.weak_x).join(swing, [key, frame])
    enough = F.coalesce((F.col("yamp") >= select.y_swing) | (F.col("xamp") >= select.x_swing), F.lit(True))
    weak = written(weak.select(key, frame, side, "strength", "is_peak", enough.alias("swings")))
    pool = kept[1].select(key, frame).join(series.select(key, frame, side), [key, frame])
    rises = folds.first_rises(series, key, frame, y)
    hits = complete_hits(kept[0], pool, weak, dense, rises, rejected[0].union(rejected[1]).distinct(), key, frame, side, complete)
    hits = prune_hits(hits, swing, dense, key, frame, serve, prune)
    if dead is not None:
        hits = hits.join(dead, key, "left_anti")
    return hits.join(series.select(key, frame, side), [key, frame], "left").select(key, frame, side, "source", "tag")
