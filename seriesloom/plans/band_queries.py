"""Queries over bands of the order: windows, nearest, as-of, gaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalars
from ..operators import bands
from .registry import FRAMES, frames, query, r4
from .run_queries import LOW_RUNS, low_runs


def by_frame():
    return Window.partitionBy("seg").orderBy("frame")



@query(
    "D01_point_in_interval",
    f"""with {LOW_RUNS}, ok as (select * from runs where n_frames >= 2)
select fr.event_id, fr.seg, fr.frame, ok.start_frame segment_index, fr.frame - ok.start_frame local_frame
from fr left join ok on fr.seg = ok.seg and fr.frame between start_frame and end_frame""",
)
def d01(spark, sf):
    found = low_runs(spark, sf, 2).withColumn("segment_index", F.col("start_frame"))
    rows = frames(spark, sf).select("event_id", "seg", "frame")
    return bands.locate(rows, found, "seg", "frame", "start_frame", "end_frame", "segment_index")


@query(
    "D02_unmatched_hits",
    f"""with {LOW_RUNS} select count(*) unmatched from fr where y >= 200 and not exists (select 1 from runs r where r.seg = fr.seg and fr.frame between start_frame and end_frame)""",
)
def d02(spark, sf):
    found = low_runs(spark, sf).withColumn("i", F.col("start_frame"))
    hits = frames(spark, sf).where("y >= 200").select("seg", "frame")
    return bands.locate(hits, found, "seg", "frame", "start_frame", "end_frame", "i").agg(F.count_if(F.col("i").isNull()).alias("unmatched"))


@query(
    "D04_as_of_both",
    f"""with {FRAMES}, v as (select *, case when label <> 'error' then y end v from fr)
select seg, frame, last_value(v ignore nulls) over (partition by seg order by frame rows between unbounded preceding and 1 preceding) before,
first_value(v ignore nulls) over (partition by seg order by frame rows between current row and unbounded following) after from v""",
)
def d04(spark, sf):
    return bands.as_of_both(frames(spark, sf), "seg", "frame", F.col("y"), F.col("label") != "error").select("seg", "frame", "before", "after")


@query(
    "D05_nearest_in_ring",
    f"""with {FRAMES} select seg, frame, coalesce(side, lag(side, 1) over w, lead(side, 1) over w, lag(side, 2) over w, lead(side, 2) over w) near
from fr window w as (partition by seg order by frame)""",
)
def d05(spark, sf):
    return bands.nearest_in_ring(frames(spark, sf), "seg", "frame", F.col("side"), 2, "near").select("seg", "frame", "near")


@query(
    "D07_band_count",
    f"""with {FRAMES}, b as (select *, count(*) filter (side = 'top') over w t, count(*) filter (side = 'bottom') over w b
from fr window w as (partition by seg order by frame range between 14 preceding and 14 following))
select seg, frame, case side when 'top' then b when 'bottom' then t end opposite from b""",
)
def d07(spark, sf):
    counts = {f"n_{s}": F.count_if(F.col("side") == s) for s in ("top", "bottom")}
    rows = bands.band_aggregate(frames(spark, sf), "seg", "frame", -14, 14, **counts)
    other = F.when(F.col("side") == "top", F.col("n_bottom")).when(F.col("side") == "bottom", F.col("n_top"))
    return rows.select("seg", "frame", other.alias("opposite"))


@query(
    "D08_anti_band",
    f"""with {FRAMES} select a.seg, a.frame from fr a where label = 'purchase' and not exists
(select 1 from fr b where b.seg = a.seg and b.label = 'click' and abs(a.frame - b.frame) <= 2)""",
)
def d08(spark, sf):
    rows = frames(spark, sf).select("seg", "frame", "label")
    left, right = rows.where("label = 'purchase'"), rows.where("label = 'click'")
    return bands.band_join(left, right, "seg", "frame", 2, "left_anti").select("seg", "frame")


@query(
    "D09_nearest_neighbour",
    f"""with {FRAMES}, c as (select a.seg, a.frame, b.frame near, abs(a.frame - b.frame) d,
row_number() over (partition by a.seg, a.frame order by abs(a.frame - b.frame), b.frame) i
from fr a left join fr b on a.seg = b.seg and b.label = 'click' and abs(a.frame - b.frame) <= 10 where a.label = 'purchase')
select seg, frame, near, coalesce(d, 999) near_distance from c where i = 1""",
)
def d09(spark, sf):
    rows = frames(spark, sf).select("seg", "frame", "label")
    left, right = rows.where("label = 'purchase'").drop("label"), rows.where("label = 'click'").drop("label")
    return bands.nearest(left, right, "seg", "frame", "near", 10, F.lit(999))


@query(
    "D10_contained",
    f"""with {FRAMES}, h as (select seg, frame lo, lead(frame) over (partition by seg order by frame) hi from fr where label = 'click')
select h.seg, lo, hi, count(*) n, round(sum(y), 4) total from h join fr on fr.seg = h.seg and fr.frame between lo and hi group by all""",
)
def d10(spark, sf):
    rows = frames(spark, sf).select("seg", "frame", "y", "label")
    pairs = bands.contained(rows, rows.where("label = 'click'"), "seg", "frame")
    return pairs.groupBy("seg", "lo", "hi").agg(F.count("*").alias("n"), r4(F.sum("y")).alias("total"))


@query(
    "D11_anchored_points",
    f"""with {FRAMES}, m as (select *, max(y) over (partition by seg order by frame range between 2 preceding and 2 following) top from fr) select seg, frame from m where top >= 100""",
)
def d11(spark, sf):
    return bands.band_aggregate(frames(spark, sf), "seg", "frame", -2, 2, top=F.max("y")).where("top >= 100").select("seg", "frame")


@query(
    "D16_reasons",
    f"""with {FRAMES}, b as (select seg, frame, list_sort(list_distinct(list(label) over (partition by seg order by frame range between 1 preceding and 1 following))) l from fr)
select seg, frame, array_to_string(l, '+') reasons from b""",
)
def d16(spark, sf):
    rows = frames(spark, sf).select("seg", "frame", "label")
    near = bands.band_aggregate(rows, "seg", "frame", -1, 1, found=F.collect_set("label"))
    return near.select("seg", "frame", F.array_join(F.array_sort("found"), "+").alias("reasons"))


@query(
    "F06_amplitude",
    f"""with {FRAMES}, a as (select *, count(*) over w n, max(y) over w - min(y) over w dy, max(x) over w - min(x) over w dx
from fr window w as (partition by seg order by frame range between 18 preceding and 18 following))
select seg, frame, case when n >= 5 then round(dy, 4) end yamp, case when n >= 5 then round(dx, 4) end xamp from a""",
)
def f06(spark, sf):
    rows = bands.band_aggregate(frames(spark, sf), "seg", "frame", -18, 18, n=F.count("*"), y0=F.min("y"), y1=F.max("y"), x0=F.min("x"), x1=F.max("x"))
    amp = lambda c: F.when(F.col("n") >= 5, r4(F.col(f"{c}1") - F.col(f"{c}0")))
    return rows.select("seg", "frame", amp("y").alias("yamp"), amp("x").alias("xamp"))


@query(
    "C07_amplitude_gate",
    f"""with {FRAMES}, a as (select *, count(*) over w n, max(y) over w - min(y) over w dy, max(x) over w - min(x) over w dx
from fr window w as (partition by seg order by frame range between 2 preceding and 2 following))
select seg, frame from a where coalesce(case when n >= 5 then dy >= 60 or dx >= 90 end, true)""",
)
def c07(spark, sf):
    rows = bands.band_aggregate(frames(spark, sf), "seg", "frame", -2, 2, n=F.count("*"), y0=F.min("y"), y1=F.max("y"), x0=F.min("x"), x1=F.max("x"))
    swing = F.when(F.col("n") >= 5, (F.col("y1") - F.col("y0") >= 60) | (F.col("x1") - F.col("x0") >= 90))
    return rows.where(F.coalesce(swing, F.lit(True))).select("seg", "frame")


@query(
    "F07_side_mass",
    f"""with {FRAMES}, m as (select *, coalesce(sum(y) filter (side = 'top') over w, 0) t, coalesce(sum(y) filter (side = 'bottom') over w, 0) b
from fr window w as (partition by seg order by frame range between 3 preceding and 3 following))
select seg, frame, case when b >= t then 'bottom' else 'top' end decided from m where abs(t - b) >= 20""",
)
def f07(spark, sf):
    mass = {s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("y"))), F.lit(0.0)) for s in ("top", "bottom")}
    rows = bands.band_aggregate(frames(spark, sf), "seg", "frame", -3, 3, **{s: F.sum(F.when(F.col("side") == s, F.col("y"))) for s in mass})
    rows = rows.fillna(0.0, ["top", "bottom"])
    return rows.where(F.abs(F.col("top") - F.col("bottom")) >= 20).select("seg", "frame", F.when(F.col("bottom") >= F.col("top"), "bottom").otherwise("top").alias("decided"))


@query(
    "F11_speed_and_turn",
    f"""with {FRAMES}, d as (select seg, frame, x - lag(x, 3) over w ix, y - lag(y, 3) over w iy, lead(x, 3) over w - x ox, lead(y, 3) over w - y oy from fr window w as (partition by seg order by frame)),
a as (select *, cast(trunc(degrees(atan2(iy, ix))) as int) a, cast(trunc(degrees(atan2(oy, ox))) as int) b from d where ix is not null and ox is not null),
t as (select *, case when a * b >= 0 then abs(a - b) else abs(a) + abs(b) end t from a)
select seg, frame, round(sqrt(ix * ix + iy * iy), 4) speed_in, round(sqrt(ox * ox + oy * oy), 4) speed_out, case when t > 180 then 360 - t else t end turn from t""",
)
def f11(spark, sf):
    d = {"ix": F.col("x") - F.lag("x", 3).over(by_frame()), "iy": F.col("y") - F.lag("y", 3).over(by_frame()), "ox": F.lead("x", 3).over(by_frame()) - F.col("x"), "oy": F.lead("y", 3).over(by_frame()) - F.col("y")}
    rows = frames(spark, sf).withColumns(d).where("ix is not null and ox is not null")
    c = [F.col(k).cast("double") for k in d]
    return rows.select("seg", "frame", r4(F.hypot(c[0], c[1])).alias("speed_in"), r4(F.hypot(c[2], c[3])).alias("speed_out"), geo.angle_between(*c).alias("turn"))


@query(
    "F12_ramp",
    f"""with {FRAMES}, s as (select *, sqrt(power(x - lag(x) over w, 2) + power(y - lag(y) over w, 2)) step from fr window w as (partition by seg order by frame))
select seg, frame, round(avg(step) over (partition by seg order by frame rows between 2 preceding and current row), 4) step_before,
round(avg(step) over (partition by seg order by frame rows between 1 following and 3 following), 4) step_after from s""",
)
def f12(spark, sf):
    rows = frames(spark, sf).withColumn("step", F.hypot(F.col("x") - F.lag("x").over(by_frame()), F.col("y") - F.lag("y").over(by_frame())))
    return rows.select("seg", "frame", r4(F.avg("step").over(by_frame().rowsBetween(-2, 0))).alias("step_before"), r4(F.avg("step").over(by_frame().rowsBetween(1, 3))).alias("step_after"))


@query(
    "F13_first_drop",
    f"""with {FRAMES}, d as (select *, (y - lead(y) over w) / (lead(frame) over w - frame) v from fr window w as (partition by seg order by frame)) select seg, min(frame) first_drop from d where v >= 50 group by seg""",
)
def f13(spark, sf):
    v = (F.col("y") - F.lead("y").over(by_frame())) / (F.lead("frame").over(by_frame()) - F.col("frame"))
    return frames(spark, sf).withColumn("v", v).where("v >= 50").groupBy("seg").agg(F.min("frame").alias("first_drop"))


@query(
    "F14_valleys",
    f"""with {FRAMES}, h as (select seg, frame lo, lead(frame) over (partition by seg order by frame) hi from fr where y >= 80),
c as (select h.seg, lo, hi, fr.frame, y, row_number() over (partition by h.seg, lo order by y, fr.frame) i from h join fr on fr.seg = h.seg and fr.frame between lo and hi)
select seg, lo, hi, frame valley from c where i = 1""",
)
def f14(spark, sf):
    rows = frames(spark, sf).select("seg", "frame", "y")
    pairs = bands.contained(rows, rows.where("y >= 80"), "seg", "frame")
    return pairs.groupBy("seg", "lo", "hi").agg(F.min_by("frame", F.struct("y", "frame")).alias("valley"))


@query(
    "F17_between_hits_windows",
    f"""with {FRAMES}, h as (select seg, frame, lag(frame) over w p, lead(frame) over w q, max(frame) over (partition by seg) last from fr where label = 'click' window w as (partition by seg order by frame))
select seg, frame, greatest(1, greatest(coalesce(p, frame - 5), frame - 15)) win_start, least(last + 1, least(coalesce(q + 2, frame + 5), frame + 15)) win_end from h""",
)
def f17(spark, sf):
    f = F.col("frame")
    rows = frames(spark, sf).where("label = 'click'").withColumn("last", F.max("frame").over(Window.partitionBy("seg")))
    start = geo.clamp(F.coalesce(F.lag("frame").over(by_frame()), f - 5), f - 15, f)
    end = F.least(F.col("last") + 1, F.least(F.coalesce(F.lead("frame").over(by_frame()) + 2, f + 5), f + 15))
    return rows.select("seg", "frame", F.greatest(F.lit(1), start).alias("win_start"), end.alias("win_end"))


@query(
    "F18_scan_windows",
    f"""with {FRAMES}, m as (select seg, max(frame) n from fr group by seg), s as (select seg, n, unnest(generate_series(1, n, 5)) frame from m)
select seg, frame, greatest(1, frame - 7) win_start, least(n, frame + 7) win_end from s""",
)
def f18(spark, sf):
    rows = frames(spark, sf).groupBy("seg").agg(F.max("frame").alias("n")).select("seg", "n", F.explode(F.expr("sequence(1L, n, 5L)")).alias("frame"))
    return rows.select("seg", "frame", geo.clamp(F.col("frame") - 7, 1, F.col("n")).alias("win_start"), geo.clamp(F.col("frame") + 7, 1, F.col("n")).alias("win_end"))


@query(
    "F19_anchored_chunks",
    f"""with {FRAMES}, m as (select seg, count(*) n from fr group by seg), s as (select seg, n, unnest(generate_series(0, n - 8, 8)) a from m where n >= 8
union select seg, n, n - 8 from m where n >= 8) select seg, a chunk_start, a + 8 chunk_end from s""",
)
def f19(spark, sf):
    m = frames(spark, sf).groupBy("seg").agg(F.count("*").alias("n")).where("n >= 8")
    starts = F.array_distinct(F.concat(F.expr("sequence(0L, n - 8, 8L)"), F.array(F.col("n") - 8)))
    return m.select("seg", F.explode(starts).alias("chunk_start")).withColumn("chunk_end", F.col("chunk_start") + 8)


@query(
    "F20_resample",
    f"""with {FRAMES}, m as (select *, count(*) over (partition by seg) n from fr), s as (select *, greatest(1, ceil(n / 20.0)) k from m)
select seg, cast((frame - 1) // k as bigint) slot, y from s where (frame - 1) % k = 0""",
)
def f20(spark, sf):
    rows = frames(spark, sf).withColumn("k", F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy("seg")) / 20)))
    at = F.col("frame") - 1
    return rows.where(at % F.col("k") == 0).select("seg", F.floor(at / F.col("k")).alias("slot"), "y")


@query(
    "F21_overlap_average",
    f"""with {FRAMES}, p as (select seg, frame + o frame, y * (o + 1) v, (case o when 0 then 1 when 1 then 2 else 1 end) / 4.0 w from fr, (select unnest([0, 1, 2]) o))
select seg, frame, round(sum(v * w) / sum(w), 4) average from p group by seg, frame""",
)
def f21(spark, sf):
    w = F.array(*map(F.lit, scalars.triangular_weights(3)))
    rows = frames(spark, sf).select("seg", "frame", "y", F.posexplode(w).alias("o", "w"))
    rows = rows.select("seg", (F.col("frame") + F.col("o")).alias("frame"), (F.col("y") * (F.col("o") + 1)).alias("v"), "w")
    return rows.groupBy("seg", "frame").agg(r4(F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("average"))


HOLES = f"{FRAMES}, hl as (select seg, frame, case when label <> 'error' then y end v from fr)"


def holes(spark, sf):
    return frames(spark, sf).select("seg", "frame", F.when(F.col("label") != "error", F.col("y")).alias("v"))


@query(
    "F24_fill_linear",
    f"""with {HOLES}, n as (select *, last_value(case when v is not null then frame end ignore nulls) over a fa, last_value(v ignore nulls) over a va,
first_value(case when v is not null then frame end ignore nulls) over b fb, first_value(v ignore nulls) over b vb from hl
window a as (partition by seg order by frame rows between unbounded preceding and current row), b as (partition by seg order by frame rows between current row and unbounded following))
select seg, frame, round(coalesce(v, va + (vb - va) * (frame - fa) / nullif(fb - fa, 0)), 4) filled from n""",
)
def f24(spark, sf):
    return bands.fill_linear(holes(spark, sf), "seg", "frame", "v").select("seg", "frame", r4("filled").alias("filled"))


@query(
    "F26_null_gaps",
    f"""with {HOLES}, g as (select *, sum(case when v is not null then 1 else 0 end) over (partition by seg order by frame) g, lag(v) over w l, lead(v) over w r from hl window w as (partition by seg order by frame))
select seg, min(frame) "start", max(frame) "end", count(*) n, arg_min(coalesce(l, -1), frame) left_value, arg_max(coalesce(r, -1), frame) right_value from g where v is null group by seg, g""",
)
def f26(spark, sf):
    return bands.null_gaps(holes(spark, sf), "seg", "frame", "v").fillna(-1.0, ["left_value", "right_value"])


@query(
    "F25_gap_policy",
    f"""with {HOLES}, g as (select *, sum(case when v is not null then 1 else 0 end) over (partition by seg order by frame) g, lag(v) over w l, lead(v) over w r from hl window w as (partition by seg order by frame)),
s as (select seg, min(frame) a, count(*) n, arg_min(coalesce(l, -1), frame) l, arg_max(coalesce(r, -1), frame) r from g where v is null group by seg, g)
select seg, a "start", case when n <= 1 then 'keep' when l < 0 or r < 0 then 'erase' when abs(r - l) / n <= 20 then 'keep' else 'erase' end decision from s""",
)
def f25(spark, sf):
    g = bands.null_gaps(holes(spark, sf), "seg", "frame", "v")
    slow = F.coalesce(F.abs(F.col("right_value") - F.col("left_value")) / F.col("n") <= 20, F.lit(False))
    return g.select("seg", "start", F.when((F.col("n") <= 1) | slow, "keep").otherwise("erase").alias("decision"))


@query(
    "F27_dominant_spike",
    f"""with {FRAMES}, d as (select seg, frame, abs(y - lag(y) over (partition by seg order by frame)) d from fr),
m as (select seg, median(d) med, max(d) top from d group by seg), s as (select seg, arg_max(frame, (d, -frame)) frame from d where d is not null group by seg)
select m.seg, s.frame cut from m join s using (seg) where top >= 25 and top >= 3 * greatest(med, 1)""",
)
def f27(spark, sf):
    d = frames(spark, sf).withColumn("d", F.abs(F.col("y") - F.lag("y").over(by_frame()))).where("d is not null")
    m = d.groupBy("seg").agg(F.median("d").alias("med"), F.max("d").alias("top"), F.max_by("frame", F.struct(F.col("d"), -F.col("frame"))).alias("cut"))
    return m.where((F.col("top") >= 25) & (F.col("top") >= 3 * F.greatest("med", F.lit(1.0)))).select("seg", "cut")


@query(
    "E04_side_vote",
    f"""with {FRAMES}, v as (select a.seg, a.frame, b.side, sum(b.y) w, min(b.frame) f from fr a join fr b on a.seg = b.seg and abs(a.frame - b.frame) <= 3 and b.side is not null where a.label = 'error' group by all),
r as (select *, row_number() over (partition by seg, frame order by w desc, f) i from v) select seg, frame, side vote from r where i = 1""",
)
def e04(spark, sf):
    rows = frames(spark, sf).select("seg", "frame", "side", "y", "label")
    pairs = bands.band_join(rows.where("label = 'error'").select("seg", "frame"), rows.where("side is not null").drop("label"), "seg", "frame", 3)
    votes = pairs.groupBy("seg", "frame", "r_side").agg(F.sum("r_y").alias("w"), F.min("r_frame").alias("f"))
    return votes.groupBy("seg", "frame").agg(F.max_by("r_side", F.struct(F.col("w"), -F.col("f"))).alias("vote"))


@query(
    "E05_confidence_near",
    f"""with {FRAMES} select seg, frame, coalesce(max(case when label <> 'error' then y end) over (partition by seg order by frame range between 2 preceding and 2 following), 0) conf from fr""",
)
def e05(spark, sf):
    rows = bands.band_aggregate(frames(spark, sf), "seg", "frame", -2, 2, c=F.max(F.when(F.col("label") != "error", F.col("y"))))
    return rows.select("seg", "frame", F.coalesce("c", F.lit(0.0)).alias("conf"))


@query(
    "C16_rally_span",
    f"""with {FRAMES}, s as (select seg, min(frame) filter (label = 'signup') a, max(frame) filter (label = 'purchase') z from fr group by seg)
select seg, frame from fr join s using (seg) where coalesce(frame between a - 2 and z + 2, true)""",
)
def c16(spark, sf):
    rows = frames(spark, sf)
    span = rows.groupBy("seg").agg(F.min(F.when(F.col("label") == "signup", F.col("frame"))).alias("a"), F.max(F.when(F.col("label") == "purchase", F.col("frame"))).alias("z"))
    return rows.join(span, "seg").where(F.coalesce(F.col("frame").between(F.col("a") - 2, F.col("z") + 2), F.lit(True))).select("seg", "frame")


@query(
    "A15_back_fill",
    f"""with {FRAMES}, d as (select *, case when frame % 4 = 1 then y end v from fr)
select seg, frame, coalesce(first_value(v ignore nulls) over (partition by seg order by frame rows between current row and unbounded following),
last_value(v ignore nulls) over (partition by seg order by frame rows between unbounded preceding and current row)) score from d""",
)
def a15(spark, sf):
    v = F.when(F.col("frame") % 4 == 1, F.col("y"))
    ahead, behind = F.first(v, True).over(by_frame().rowsBetween(0, Window.unboundedFollowing)), F.last(v, True).over(by_frame().rowsBetween(Window.unboundedPreceding, 0))
    return frames(spark, sf).select("seg", "frame", F.coalesce(ahead, behind).alias("score"))
