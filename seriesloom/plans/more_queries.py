"""More queries over geometry, fallbacks, scatter and composed stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalars
from ..operators import bands, folds, runs, stats
from . import stages
from .registry import FRAMES, frames, query, r4, table
from .run_queries import LOW_RUNS, low_runs


@query(
    "B12_joint_normalisation",
    f"""with {FRAMES}, b as (select event_id, x, y, x + 10 w, y + 20 h, sqrt(power(x + 10, 2) + power(y + 20, 2)) d from fr)
select event_id, round((case when x = 0 then 0 else x / d end) - w / 2 / d, 6) jx, round((case when y = 0 then 0 else y / d end) - h / 2 / d, 6) jy from b""",
)
def b12(spark, sf):
    joints = F.array(F.array("x", "y"))
    box = F.array(F.lit(0.0), F.lit(0.0), F.col("x") + 10, F.col("y") + 20)
    j = F.get(geo.normalize_joints(joints, box), F.lit(0))
    return frames(spark, sf).select("event_id", F.round(F.get(j, F.lit(0)), 6).alias("jx"), F.round(F.get(j, F.lit(1)), 6).alias("jy"))


@query("B14_bones", f"with {FRAMES} select event_id, case when x = 0 then 0 else 50 - x end bx, round(case when y = 0 then 0 else 30 - y end, 6) by_ from fr")
def b14(spark, sf):
    bone = F.get(geo.bones(F.array(F.array("x", "y"), F.array(F.lit(50.0), F.lit(30.0))), [(0, 1)]), F.lit(0))
    return frames(spark, sf).select("event_id", F.get(bone, F.lit(0)).alias("bx"), F.round(F.get(bone, F.lit(1)), 6).alias("by_"))


@query(
    "B16_nearest_wrist",
    f"""with {FRAMES}, w as (select *, lag(x) over (partition by seg order by frame) px, lag(y) over (partition by seg order by frame) py from fr)
select event_id, round(case when px is null then sqrt(power(x + frame % 13 - 50, 2) + power(y - 3 - y / 2, 2)) else least(sqrt(power(x + frame % 13 - 50, 2) + power(y - 3 - y / 2, 2)), sqrt(power(px - 50, 2) + power(py - y / 2, 2))) end, 6) distance from w""",
)
def b16(spark, sf):
    """One wrist moves with the event; the other is where the event before was, and unknown at the start."""
    w = Window.partitionBy("seg").orderBy("frame")
    rows = frames(spark, sf).withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    wrists = [(F.col("x") + F.col("frame") % 13, F.col("y") - 3), (F.col("px"), F.col("py"))]
    return rows.select("event_id", F.round(geo.nearest_distance(wrists, F.lit(50.0), F.col("y") / 2), 6).alias("distance"))


@query("B19_clamped_offsets", f"with {FRAMES}, m as (select seg, max(frame) z from fr group by seg) select seg, frame, greatest(1, least(frame + case label when 'click' then 2 when 'view' then -3 else 0 end, z)) shifted from fr join m using (seg)")
def b19(spark, sf):
    offset = F.coalesce(F.try_element_at(F.create_map(F.lit("click"), F.lit(2), F.lit("view"), F.lit(-3)), F.col("label")), F.lit(0))
    last = F.max("frame").over(Window.partitionBy("seg"))
    return frames(spark, sf).select("seg", "frame", geo.clamp(F.col("frame") + offset, 1, last).alias("shifted"))


@query(
    "B22_line_intersections",
    f"""with {FRAMES}, p as (select event_id, x x1, y x2, x + frame % 7 - 3 x3, y / 3 x4, y y1, x + 5.0 y2, y - frame % 5 y3, x * 2.0 y4 from fr),
d as (select *, (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4) d, x1 * y2 - y1 * x2 e, x3 * y4 - y3 * x4 f, sqrt(power(x1 - x2, 2) + power(y1 - y2, 2)) * sqrt(power(x3 - x4, 2) + power(y3 - y4, 2)) n from p)
select event_id, case when abs(d / n) >= 1e-3 then round((e * (x3 - x4) - (x1 - x2) * f) / d, 4) + 0.0 end ix, case when abs(d / n) >= 1e-3 then round((e * (y3 - y4) - (y1 - y2) * f) / d, 4) + 0.0 end iy from d where n > 0""",
)
def b22(spark, sf):
    """Lines in any direction; those that are parallel but for a thousandth are left out of the comparison."""
    x, y, f = F.col("x").cast("double"), F.col("y"), F.col("frame")
    p, q = geo.line(x, y, y, x + 5), geo.line(x + f % 7 - 3, y - f % 5, y / 3, x * 2)
    rows = frames(spark, sf).withColumns({"p": F.struct(*(c.alias(n) for c, n in zip(p, "abc", strict=True))), "q": F.struct(*(c.alias(n) for c, n in zip(q, "abc", strict=True)))})
    rows = rows.where("p.a is not null and q.a is not null")
    ix, iy = geo.intersection(*(tuple(F.col(f"{n}.{c}") for c in "abc") for n in "pq"))
    apart = F.abs(F.col("p.a") * F.col("q.b") - F.col("q.a") * F.col("p.b")) >= 1e-3
    return rows.select("event_id", *(F.when(apart, F.round(c, 4) + 0.0).alias(n) for c, n in ((ix, "ix"), (iy, "iy"))))


@query(
    "C06_away_from_anchors",
    f"""with {FRAMES}, a as (select avg(y) ax, avg(x) ay from fr group by floor(y / 25), floor(x / 25) having count(*) >= 40)
select event_id from fr where not exists (select 1 from a where sqrt(power(fr.y - ax, 2) + power(fr.x - ay, 2)) < 6)""",
)
def c06(spark, sf):
    rows = frames(spark, sf)
    anchors = rows.groupBy(F.floor(F.col("y") / 25), F.floor(F.col("x") / 25)).agg(F.avg("y").alias("ax"), F.avg("x").alias("ay"), F.count("*").alias("n"))
    # anchors go to all bins of side 6 around theirs, so that points meet them by equality
    bin_ = lambda c: F.floor(c / 6)
    near = F.expr("sequence(-1, 1)")
    anchors = anchors.where("n >= 40").select("ax", "ay", F.explode(F.transform(near, lambda i: bin_(F.col("ax")) + i)).alias("bx"), "n").select("ax", "ay", "bx", F.explode(F.transform(near, lambda i: bin_(F.col("ay")) + i)).alias("by"))
    same = (bin_(rows["y"]) == F.col("bx")) & (bin_(rows["x"]) == F.col("by"))
    return rows.join(anchors, same & (F.hypot(rows["y"] - F.col("ax"), rows["x"] - F.col("ay")) < 6), "left_anti").select("event_id")


@query(
    "J10_fallback_chain",
    """with t as (select o_custkey k, o_orderkey, case when o_orderstatus <> 'P' then o_orderkey % 22 end a, case when o_orderpriority <> '5-LOW' then o_orderkey % 17 end b from orders),
r as (select *, row_number() over (partition by k order by (a is not null)::int + (b is not null)::int desc, o_orderkey) i from t) select k, o_orderkey, coalesce(a, -1) a, coalesce(b, -1) b from r where i = 1""",
)
def j10(spark, sf):
    o = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), o, F.when(F.col("o_orderstatus") != "P", o % 22).alias("a"), F.when(F.col("o_orderpriority") != "5-LOW", o % 17).alias("b"))
    rank = F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int")
    best = rows.groupBy("k").agg(F.max_by(F.struct("o_orderkey", "a", "b"), F.struct(rank, -o)).alias("x"))
    return best.select("k", "x.*").fillna(-1, ["a", "b"])


@query(
    "D03_positional_zip",
    f"""with {FRAMES}, a as (select *, row_number() over (partition by seg order by frame) i from fr where label = 'click'), b as (select *, row_number() over (partition by seg order by frame) i from fr where label = 'purchase')
select a.seg, a.i, a.frame hit, b.frame stroke from a join b on a.seg = b.seg and a.i = b.i""",
)
def d03(spark, sf):
    w = Window.partitionBy("seg").orderBy("frame")
    numbered = lambda label, name: frames(spark, sf).where(F.col("label") == label).select("seg", F.row_number().over(w).alias("i"), F.col("frame").alias(name))
    return numbered("click", "hit").join(numbered("purchase", "stroke"), ["seg", "i"])


@query("D15_dense_scatter", f"with {LOW_RUNS}, s as (select seg, start_frame, unnest(generate_series(start_frame, end_frame + 2)) frame from runs where n_frames >= 4) select s.seg, start_frame, s.frame - start_frame slot, coalesce(x, 0) x from s left join fr on fr.seg = s.seg and fr.frame = s.frame and fr.label <> 'view'")
def d15(spark, sf):
    spine = low_runs(spark, sf, 4).select("seg", "start_frame", F.explode(F.sequence("start_frame", F.col("end_frame") + 2)).alias("frame"))
    known = frames(spark, sf).where("label <> 'view'").select("seg", "frame", "x")
    return spine.join(known, ["seg", "frame"], "left").select("seg", "start_frame", (F.col("frame") - F.col("start_frame")).alias("slot"), F.coalesce("x", F.lit(0.0)).alias("x"))


@query(
    "D17_fallback_candidates",
    f"""with {FRAMES}, a as (select seg, x, frame from fr where label = 'click'), b as (select seg, x, frame from fr where label = 'view')
select * from a union all select * from b where not exists (select 1 from a where a.seg = b.seg and abs(a.x - b.x) <= 20)""",
)
def d17(spark, sf):
    rows = frames(spark, sf).select("seg", "x", "frame", "label")
    real, spare = rows.where("label = 'click'").drop("label"), rows.where("label = 'view'").drop("label")
    return real.unionByName(bands.band_join(spare, real, "seg", "x", 20, "left_anti"))


@query("E11_statistics", f"with {FRAMES} select count(*) n, count(*) filter (y < 40) low, round(avg((y < 40)::int), 6) share, count(distinct seg) keys, count(x) found from fr")
def e11(spark, sf):
    low = F.col("y") < 40
    return frames(spark, sf).agg(F.count("*").alias("n"), F.count_if(low).alias("low"), F.round(F.avg(low.cast("int")), 6).alias("share"), F.count_distinct("seg").alias("keys"), F.count("x").alias("found"))


@query("E16_coverage", f"with {FRAMES}, l as (select seg, label, avg((y < 40)::int) inside, avg((x > 90)::int) outside from fr group by seg, label) select seg, round(avg(case when outside > 0.4 then 0 else inside end) * avg((inside > 0.3)::int), 6) coverage from l group by seg")
def e16(spark, sf):
    lines = frames(spark, sf).groupBy("seg", "label").agg(F.avg((F.col("y") < 40).cast("int")).alias("inside"), F.avg((F.col("x") > 90).cast("int")).alias("outside"))
    share = F.avg(F.when(F.col("outside") > 0.4, 0.0).otherwise(F.col("inside"))) * F.avg((F.col("inside") > 0.3).cast("int"))
    return lines.groupBy("seg").agg(F.round(share, 6).alias("coverage"))


@query("E18_point_errors", f"with {FRAMES}, e as (select seg, sqrt(power(x - 50, 2) + power(y - 30, 2)) e from fr) select seg, round(avg(e), 6) mean, round(max(e), 6) max from e group by seg")
def e18(spark, sf):
    e = F.hypot(F.col("x") - 50, F.col("y") - 30)
    return frames(spark, sf).groupBy("seg").agg(F.round(F.avg(e), 6).alias("mean"), F.round(F.max(e), 6).alias("max"))


@query("F10_first_rise")
def f10(spark, sf):
    return folds.first_rises(frames(spark, sf), "seg", "frame", "y", steps=3, gap=1, wobble=2.0, total=40.0)


@query(
    "F29_line_clusters",
    f"""with {FRAMES}, g as (select seg, y, frame, case when y - lag(y) over (partition by seg order by y, frame) <= 2 then 0 else 1 end n from fr),
c as (select *, sum(n) over (partition by seg order by y, frame) c from g)
select seg, min(y) low, max(y) high, count(*) n, round(regr_slope(frame, y), 3) slope from c group by seg, c having count(*) >= 5 and max(y) > min(y)""",
)
def f29(spark, sf):
    w = Window.partitionBy("seg").orderBy("y", "frame")
    rows = frames(spark, sf).withColumn("n", F.coalesce((F.col("y") - F.lag("y").over(w) > 2), F.lit(True)).cast("int"))
    rows = rows.withColumn("c", F.sum("n").over(w))
    out = rows.groupBy("seg", "c").agg(F.min("y").alias("low"), F.max("y").alias("high"), F.count("*").alias("n"), F.round(F.regr_slope("frame", "y"), 3).alias("slope"))
    return out.where("n >= 5 and high > low").drop("c")


@query("G07_smallest_that_fits", "select p_brand, arg_min(p_partkey, (p_size, p_partkey)) part from part where p_size >= 20 and p_size < 45 group by p_brand")
def g07(spark, sf):
    return table(spark, sf, "part").where("p_size >= 20 and p_size < 45").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", "p_partkey")).alias("part"))


@query("H06_mask_without_excluded", f"with {FRAMES}, e as (select distinct floor(o_totalprice / 5000) * 2 frame from orders) select seg, frame, y < 40 and frame not in (select frame from e) low from fr")
def h06(spark, sf):
    excluded = table(spark, sf, "orders").select((F.floor(F.col("o_totalprice") / 5000) * 2).alias("frame")).distinct().withColumn("out", F.lit(True))
    return frames(spark, sf).join(excluded, "frame", "left").select("seg", "frame", ((F.col("y") < 40) & F.col("out").isNull()).alias("low"))


@query("I05_without_fences", "select page_id, 'a' || chr(10) || url kept from pages")
def i05(spark, sf):
    text = F.concat(F.lit("```json\na\n  ```\n"), F.col("url"), F.lit("\n```"))
    return table(spark, sf, "pages").select("page_id", scalars.without_fences(text).alias("kept"))


@query("I09_formatted", f"with {FRAMES} select event_id, printf('seg%04d', seg) name, left(label || '-' || event_id, 8) short from fr")
def i09(spark, sf):
    return frames(spark, sf).select("event_id", F.format_string("seg%04d", "seg").alias("name"), F.left(F.concat_ws("-", "label", "event_id"), F.lit(8)).alias("short"))


@query("I12_status_default", f"with {FRAMES} select event_id, case when label in ('click', 'view') then label else 'pending' end status from fr")
def i12(spark, sf):
    return frames(spark, sf).select("event_id", F.coalesce(F.when(F.col("label").isin("click", "view"), F.col("label")), F.lit("pending")).alias("status"))


@query(
    "J13_side_decision",
    f"""with {FRAMES}, k as (select seg, frame, label, x, y, coalesce(side, lag(side, 1) over w, lead(side, 1) over w) s from fr window w as (partition by seg order by frame))
select seg, frame, coalesce(s, case when x * 1.5 <= y then 'top' when y * 1.5 <= x then 'bottom' end) side from k where label = 'error'""",
)
def j13(spark, sf):
    rows = frames(spark, sf)
    return stages.decide_sides(rows.where("label = 'error'"), rows, "seg", "frame", "side", "x", "y", 1)


@query("J02_track")
def j02(spark, sf):
    rows = frames(spark, sf).withColumn("conf", F.least(F.col("y") / 100, F.lit(1.0)))
    found = stages.track(rows.where("label <> 'error'"), "seg", "frame", "x", "y", "conf", rows)
    return found.withColumns({c: r4(c) for c in ("x", "y", "conf")})


@query(
    "J09_constant_score_runs",
    """with o as (select o_custkey k, o_orderkey // 3000 s, row_number() over (partition by o_custkey order by o_orderkey) i from orders),
c as (select *, sum(case when s is distinct from p then 1 else 0 end) over (partition by k order by i) r from (select *, lag(s) over (partition by k order by i) p from o))
select k, s, min(i) f0, max(i) f1, count(*) n from c group by k, s, r""",
)
def j09(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.floor(F.col("o_orderkey") / 3000).alias("s"), F.row_number().over(w).alias("i"))
    return runs.label_runs(rows, "k", "i", "s", None).select("k", "s", "f0", "f1", "n")


@query("G03_longest_lines", f"with {FRAMES} select event_id, length from (select event_id, round(sqrt(x * x + y * y), 6) length, row_number() over (order by x * x + y * y desc, event_id) i from fr) where i <= 180")
def g03(spark, sf):
    d = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    rows = frames(spark, sf).orderBy(d.desc(), "event_id").limit(180)
    return rows.select("event_id", F.round(F.sqrt(d), 6).alias("length"))


@query("C12_scene_by_key", f"with {FRAMES} select seg, quantile_cont(y, 0.99) < 3 * greatest(median(y), 1) and max(y) < 6 * greatest(median(y), 1) single_scene from fr group by seg")
def c12_by_key(spark, sf):
    base = F.greatest(F.median("y"), F.lit(1.0))
    return frames(spark, sf).groupBy("seg").agg(((F.percentile("y", F.lit(0.99)) < 3 * base) & (F.max("y") < 6 * base)).alias("single_scene"))


@query("C17_tail_swings", f"with {FRAMES}, l as (select seg, max(frame) z from fr where label = 'signup' group by seg) select seg, frame from fr left join l using (seg) where coalesce(not (frame > z and case when label <> 'error' then y end < 30), true)")
def c17(spark, sf):
    rows = frames(spark, sf)
    last = rows.where("label = 'signup'").groupBy("seg").agg(F.max("frame").alias("z"))
    small_swing = (F.col("frame") > F.col("z")) & (F.when(F.col("label") != "error", F.col("y")) < 30)
    return rows.join(last, "seg", "left").where(F.coalesce(~small_swing, F.lit(True))).select("seg", "frame")


@query("A16_required_frames", f"with {LOW_RUNS}, q as (select seg, unnest([start_frame, end_frame]) frame from runs where n_frames >= 3) select distinct fr.seg, fr.frame, y from fr join q on fr.seg = q.seg and fr.frame = q.frame")
def a16(spark, sf):
    wanted = low_runs(spark, sf, 3).select("seg", F.explode(F.array("start_frame", "end_frame")).alias("frame"))
    return frames(spark, sf).select("seg", "frame", "y").join(wanted, ["seg", "frame"], "left_semi")
