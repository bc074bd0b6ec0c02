"""Queries over limbs, lines, run statistics, candidates, fills and lenient parsing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalars
from ..operators import bands, folds, kernels
from ..sources import envelope
from . import stages
from .band_queries import HOLES, by_frame, holes
from .registry import FRAMES, frames, query, r4, table


@query(
    "A08_known_scores",
    "select o_orderkey segment_index, case when o_orderkey % 5 <> 0 and o_custkey % 3 <> 0 then o_orderkey % 22 end a, case when o_orderkey % 5 <> 0 and o_custkey % 3 <> 0 then o_custkey % 22 end b from orders",
)
def a08(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rallies = table(spark, sf, "orders").select(o.alias("segment_index"), F.when(o % 5 != 0, o % 22).alias("score_a"), F.when(c % 3 != 0, c % 22).alias("score_b"))
    return envelope.known_scores(rallies).select("segment_index", "score.a", "score.b")


@query(
    "A09_parsed_segments",
    """with t as (select o_orderkey segment_index, case when o_orderkey % 10 <> 3 then cast(o_orderkey % 100 as double) end a, cast(o_custkey % 150 as double) z, case when o_orderkey % 4 <> 0 then 2.5 end d from orders)
select segment_index, a start_sec, z end_sec, coalesce(cast(d as double), z - a) duration_sec from t where a is not null and z > a""",
)
def a09(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(
        o.alias("segment_index"), F.when(o % 10 == 3, "bad").otherwise((o % 100).cast("string")).alias("start_sec"),
        (c % 150).cast("string").alias("end_sec"), F.when(o % 4 != 0, "2.5").alias("duration_sec"),
    )
    return envelope.parsed_segments(rows)


@query("B07_model_ground_points", f"with {FRAMES} select event_id, case when x <> 0 and y <> 0 then x + 4 else x + 8 end gx, round(case when x <> 0 and y <> 0 then y + 1 else y + 2 end, 4) gy from fr")
def b07(spark, sf):
    gx, gy = geo.ground_point_for_model([(F.col("x"), F.col("y")), (F.col("x") + 8, F.col("y") + 2)])
    return frames(spark, sf).select("event_id", gx.alias("gx"), r4(gy).alias("gy"))


@query("B11_court_sizes", f"with {FRAMES} select event_id, y / greatest(x, 1e-6) size from fr")
def b11(spark, sf):
    return frames(spark, sf).select("event_id", geo.court_size(F.col("y"), F.col("x")).alias("size"))


@query("B13_normalised_points", f"with {FRAMES} select event_id, round(cast(cast(x / 1280 as float) as double), 6) nx, round(cast(cast(y / 720 as float) as double), 6) ny from fr")
def b13(spark, sf):
    part = lambda c, n: F.round((F.col(c) / n).cast("float").cast("double"), 6)
    return frames(spark, sf).select("event_id", part("x", 1280).alias("nx"), part("y", 720).alias("ny"))


@query("B15_limb_lengths", f"with {FRAMES} select event_id, round(greatest(case when x / 100 > 0.2 then 17 else sqrt(265) end, case when label <> 'error' then 20 end), 6) scale from fr")
def b15(spark, sf):
    x, y = F.col("x"), F.col("y")
    left = ((x, y, F.lit(0.9)), (x + 3, y + 4, x / 100), (x + 3, y + 16, F.lit(0.5)))
    right = ((x + 10, y, F.lit(0.9)), (x, y, F.lit(0.1)), (x + 10, y + 20, F.when(F.col("label") == "error", 0.1).otherwise(0.8)))
    return frames(spark, sf).select("event_id", F.round(geo.player_scale(left, right), 6).alias("scale"))


@query("B23_projected_points", f"with {FRAMES}, m as (select unnest([0, 1, 2, 3]) i) select event_id, i, round(x + 610.0 * (i % 2), 4) px, round(y + 1341.0 * (i // 2), 4) py from fr, m where label = 'click'")
def b23(spark, sf):
    court = [[F.lit(100.0), F.lit(0.0), F.col("x")], [F.lit(0.0), F.lit(100.0), F.col("y")], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    rows = frames(spark, sf).where("label = 'click'").withColumn("i", F.explode(F.array(*map(F.lit, range(4)))))
    px, py = geo.project(court, F.col("i") % 2 * 6.1, F.floor(F.col("i") / 2) * 13.41)
    return rows.select("event_id", "i", r4(px).alias("px"), r4(py).alias("py"))


@query("B29_clockwise", "select event_id, concat_ws(',', event_id, event_id + 1, event_id + 3, event_id + 2) corners from events")
def b29(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.array_join(geo.clockwise(F.array(*((e + i).cast("string") for i in range(4)))), ",").alias("corners"))


@query("C04_candidates", f"with {FRAMES} select event_id from fr where x > 10 and x < 90 and y > 5 and y < 80")
def c04(spark, sf):
    return frames(spark, sf).where("x > 10 and x < 90 and y > 5 and y < 80").select("event_id")


@query("C14_valid_corners", f"with {FRAMES} select event_id, x * y * 2 > 1e-6 valid from fr")
def c14(spark, sf):
    zero, x, y = F.lit(0.0), F.col("x"), F.col("y")
    corners = F.array(F.array(zero, zero), F.array(x, zero), F.array(zero, y), F.array(x, y))
    return frames(spark, sf).select("event_id", geo.valid_corners(corners).alias("valid"))


@query(
    "D13_line_grid",
    f"""with {FRAMES}, v as (select seg, min(x) x from fr where label = 'click' group by seg, floor(x / 14)),
h as (select seg, min(y) y from fr where label = 'view' group by seg, floor(y / 14)),
g as (select a.seg, a.x l, b.x r, c.y t, d.y b, row_number() over (partition by a.seg order by round(abs(b.x - a.x - d.y + c.y), 6), a.x, b.x, c.y, d.y) i
from v a join v b on a.seg = b.seg and a.x < b.x join h c on a.seg = c.seg join h d on a.seg = d.seg and c.y < d.y) select seg, l, r, t, b from g where i = 1""",
)
def d13(spark, sf):
    # lines are clustered by position first, so a picture's width and height bound their number
    rows = frames(spark, sf)
    lines = lambda label, c, name: rows.where(F.col("label") == label).groupBy("seg", F.floor(F.col(c) / 14).alias("at")).agg(F.min(c).alias(name)).drop("at")
    across = lines("click", "x", "l").join(lines("click", "x", "r"), "seg").where("l < r")
    down = lines("view", "y", "t").join(lines("view", "y", "b"), "seg").where("t < b")
    misfit = F.round(F.abs(F.col("r") - F.col("l") - F.col("b") + F.col("t")), 6)
    best = across.join(down, "seg").groupBy("seg").agg(F.min(F.struct(misfit.alias("m"), "l", "r", "t", "b")).alias("x"))
    return best.select("seg", "x.l", "x.r", "x.t", "x.b")


@query("E02_grouped_frames", f"with {FRAMES} select seg, string_agg(frame, ',' order by frame) frames from fr where label = 'error' group by seg")
def e02(spark, sf):
    rows = frames(spark, sf).where("label = 'error'").groupBy("seg").agg(F.array_sort(F.collect_list("frame")).alias("f"))
    return rows.select("seg", F.array_join(F.transform("f", lambda x: x.cast("string")), ",").alias("frames"))


@query(
    "E06_run_statistics",
    f"""with {FRAMES}, c as (select *, case when label is distinct from lag(label) over (partition by seg order by frame) then 1 else 0 end n from fr), r as (select *, sum(n) over (partition by seg order by frame) r from c)
select seg, min(frame) f0, max(frame) f1, count(*) length, round(avg(y), 4) mean, max(y) peak, round(sum(frame * y) / coalesce(nullif(sum(y), 0), 1), 4) centre, any_value(label) label, bool_or(x > 90) far from r group by seg, r""",
)
def e06(spark, sf):
    new = F.coalesce(F.col("label") != F.lag("label").over(by_frame()), F.lit(True)).cast("int")
    rows = frames(spark, sf).withColumn("n", new).withColumn("r", F.sum("n").over(by_frame()))
    centre = F.sum(F.col("frame") * F.col("y")) / F.coalesce(F.nullif(F.sum("y"), F.lit(0.0)), F.lit(1.0))
    return rows.groupBy("seg", "r").agg(
        F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.count("*").alias("length"), r4(F.avg("y")).alias("mean"), F.max("y").alias("peak"),
        r4(centre).alias("centre"), F.any_value("label").alias("label"), F.bool_or(F.col("x") > 90).alias("far"),
    ).drop("r")


@query("E10_found", f"with {FRAMES} select seg, count(side) found, count(*) expected from fr group by seg")
def e10(spark, sf):
    return frames(spark, sf).groupBy("seg").agg(F.count("side").alias("found"), F.count("*").alias("expected"))


@query(
    "E17_chamfer",
    f"""with {FRAMES}, d as (select a.event_id, a.seg, coalesce(min(abs(a.x - b.x)), 20) d from fr a left join fr b on a.seg = b.seg and b.label = 'view' and abs(a.x - b.x) <= 20 where a.label = 'click' group by all)
select seg, round(avg((d < 4)::int), 6) inliers, round(avg(d), 4) mean from d group by seg""",
)
def e17(spark, sf):
    rows = frames(spark, sf).select("event_id", "seg", "x", "label")
    near = bands.nearest(rows.where("label = 'click'").drop("label"), rows.where("label = 'view'").select("seg", "x"), "seg", "x", "at", 20, F.lit(20.0))
    return near.groupBy("seg").agg(F.round(F.avg((F.col("at_distance") < 4).cast("int")), 6).alias("inliers"), r4(F.avg("at_distance")).alias("mean"))


@query("F15_all_signals")
def f15(spark, sf):
    return folds.contact_candidates(frames(spark, sf).withColumn("x", F.when(F.col("label") != "error", F.col("x"))), "seg", apart=3, spacing=3, clear=0)


@query("G05_first_argmax", f"with {FRAMES} select seg, arg_max(frame, (floor(y / 10), -frame)) frame from fr group by seg")
def g05(spark, sf):
    return frames(spark, sf).groupBy("seg").agg(F.max_by("frame", F.struct(F.floor(F.col("y") / 10), -F.col("frame"))).alias("frame"))


@query("I03_lenient_int", "select event_id, case when event_type = 'click' then cast(event_id as int) end n from events")
def i03(spark, sf):
    e, kind = F.col("event_id").cast("string"), F.col("event_type")
    text = F.when(kind == "click", F.concat(F.lit(" "), e)).when(kind == "view", F.concat(e, F.lit(".7"))).when(kind == "error", "n/a")
    return table(spark, sf, "events").select("event_id", scalars.lenient_int(text).alias("n"))


@query(
    "I04_lenient_ints",
    f"""with {FRAMES} select event_id, case when label <> 'error' then (label = 'click')::int + 1 + (frame % 3 = 0)::int end n,
case when label = 'click' then cast(event_id as int) when label <> 'error' then cast(x as int) end first, case when label <> 'error' then case when frame % 3 = 0 then cast(-frame as int) else cast(x as int) end end last from fr""",
)
def i04(spark, sf):
    """Lists of texts of which one, two or three can be read; for some labels there is no list."""
    whole = F.when(F.col("label") == "click", F.col("event_id").cast("string")).otherwise(F.concat(F.col("label"), F.lit("7")))
    own = F.array(whole, F.col("y").cast("string"), F.concat(F.lit(" "), F.col("x").cast("int").cast("string")), F.lit(None).cast("string"), F.when(F.col("frame") % 3 == 0, F.concat(F.lit("-"), F.col("frame").cast("string"))).otherwise("n/a"))
    rows = frames(spark, sf).select("event_id", "label", scalars.lenient_ints(own).alias("found"))
    told = lambda c: F.when(F.col("label") != "error", c)
    return rows.select("event_id", told(F.size("found")).alias("n"), told(F.get("found", F.lit(0))).alias("first"), told(F.element_at("found", -1)).alias("last"))


@query("I07_label_tests", "select event_id, event_type like 'p%' begins, event_type like '%ic%' has from events")
def i07(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select("event_id", kind.startswith("p").alias("begins"), kind.contains("ic").alias("has"))


@query("I13_numbers", f"with {FRAMES} select event_id, round(sqrt(x * x + y * y), 6) h, round(atan2(y, x), 6) a, round(log10(y + 1), 6) l, cast(floor((frame - 50) / 7.0) as bigint) q from fr")
def i13(spark, sf):
    x, y = F.col("x"), F.col("y")
    return frames(spark, sf).select("event_id", F.round(F.hypot(x, y), 6).alias("h"), F.round(F.atan2(y, x), 6).alias("a"), F.round(F.log10(y + 1), 6).alias("l"), F.floor((F.col("frame") - 50) / 7).alias("q"))


@query("I14_sums_and_steps", f"with {FRAMES} select seg, frame, round(sum(y) over w, 3) total, round(y - lag(y) over w, 3) step from fr window w as (partition by seg order by frame)")
def i14(spark, sf):
    y = F.col("y")
    return frames(spark, sf).select("seg", "frame", F.round(F.sum(y).over(by_frame()), 3).alias("total"), F.round(y - F.lag(y).over(by_frame()), 3).alias("step"))


@query("I15_weighted_counter", f"with {FRAMES} select seg, round(coalesce(sum(y) filter (label = 'error'), 0), 3) error from fr group by seg")
def i15(spark, sf):
    by_label = frames(spark, sf).groupBy("seg", "label").agg(F.sum("y").alias("w"))
    weights = by_label.groupBy("seg").agg(F.map_from_entries(F.collect_list(F.struct("label", "w"))).alias("m"))
    return weights.select("seg", F.round(F.coalesce(F.try_element_at("m", F.lit("error")), F.lit(0.0)), 3).alias("error"))


def filled(spark, sf, how):
    rows = frames(spark, sf).where("label <> 'error'").withColumn("conf", F.least(F.col("y") / 100, F.lit(1.0)))
    return folds.fill_path(rows, "seg", how=how).withColumns({c: r4(c) for c in ("x", "y")})


@query("J06_spline_fill")
def j06(spark, sf):
    return filled(spark, sf, "spline")


@query("J07_piecewise_fill")
def j07(spark, sf):
    return filled(spark, sf, "pieces")


@query(
    "J20_homography",
    f"""with {FRAMES}, q as (select seg, min(x) * 1.0 x0, min(y) y0, max(x) + 20.0 x1, min(y) + avg(x) / 9 y1, min(x) - avg(y) / 7 x3, max(y) + 50 y3, max(x) + 35 + avg(x) / 5 x2, max(y) + 20 - avg(x) / 11 y2, avg(x) / 100 u, least(avg(y) / 100, 1) v from fr group by seg),
d as (select *, x1 - x2 a, x3 - x2 b, x0 - x1 + x2 - x3 s, y1 - y2 c, y3 - y2 e, y0 - y1 + y2 - y3 t from q),
g as (select *, (s * e - b * t) / (a * e - b * c) g, (a * t - s * c) / (a * e - b * c) h from d),
p as (select *, g * u + h * v + 1 w from g)
select seg, round(((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * v + x0) / w, 4) px, round(((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * v + y0) / w, 4) py, cast(0 as double) bu, cast(0 as double) bv from p""",
)
def j20(spark, sf):
    """A point of the unit square in a quad of each user's own, and how far off it comes back."""
    rows = frames(spark, sf).groupBy("seg").agg(*(f(c).alias(f"{c}{n}") for c in "xy" for n, f in (("a", F.min), ("z", F.max), ("m", F.avg))))
    unit = np.array([[0, 0], [1, 0], [0, 1], [1, 1]], dtype=float)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples():
                quad = np.array([[r.xa, r.ya], [r.xz + 20, r.ya + r.xm / 9], [r.xa - r.ym / 7, r.yz + 50], [r.xz + 35 + r.xm / 5, r.yz + 20 - r.xm / 11]], dtype=float)
                at = kernels.homography(unit, quad) @ [r.xm / 100, min(r.ym / 100, 1), 1]
                back = kernels.homography(quad, unit) @ (at / at[2])
                out.append((r.seg, *(at[:2] / at[2]), back[0] / back[2] - r.xm / 100, back[1] / back[2] - min(r.ym / 100, 1)))
            yield pd.DataFrame(out, columns=["seg", "px", "py", "bu", "bv"])

    found = rows.mapInPandas(run, "seg long, px double, py double, bu double, bv double")
    return found.select("seg", *((r4(c) + 0.0).alias(c) for c in ("px", "py", "bu", "bv")))


@query(
    "K05_repair",
    f"""with {HOLES}, g as (select *, sum(case when v is not null then 1 else 0 end) over (partition by seg order by frame) g from hl),
n as (select *, max(v) over (partition by seg, g) l, first_value(v ignore nulls) over b r, last_value(case when v is not null then frame end ignore nulls) over a fa, first_value(case when v is not null then frame end ignore nulls) over b fb from g
window a as (partition by seg order by frame rows between unbounded preceding and current row), b as (partition by seg order by frame rows between current row and unbounded following)),
k as (select *, v is null and coalesce(r > 15, false) and (l is null or l > 15) repaired from n)
select seg, frame, round(case when repaired then coalesce(l + (r - l) * (frame - fa) / nullif(fb - fa, 0), r) else v end, 4) v, repaired from k""",
)
def k05(spark, sf):
    return stages.repair(holes(spark, sf), "seg", "frame", "v", 15).withColumn("v", r4("v"))
