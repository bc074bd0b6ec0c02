"""Queries over scalars, aggregates, thresholds and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import scalars
from ..operators import stats
from ..schemas import COURT_LENGTH, COURT_WIDTH
from .registry import FRAMES, frames, query, r4, table
from .run_queries import LOW_RUNS, low_runs


@query("B01_segment_seconds", f"with {LOW_RUNS} select seg, start_frame, end_frame, round(start_frame / 30.0, 3) start_sec, round(end_frame / 30.0, 3) end_sec, round(end_frame / 30.0 - start_frame / 30.0, 3) duration_sec from runs")
def b01(spark, sf):
    rows = low_runs(spark, sf).drop("n_frames")
    return rows.withColumns(geo.segment_seconds(F.col("start_frame"), F.col("end_frame"), 30.0))


@query("B02_round_and_clamp", f"with {FRAMES} select event_id, cast(round_even(y, 0) as bigint) nearest, greatest(5, least(y, 50)) clamped from fr")
def b02(spark, sf):
    return frames(spark, sf).select("event_id", geo.round_to_int(F.col("y")).alias("nearest"), geo.clamp(F.col("y"), 5.0, 50.0).alias("clamped"))


@query(
    "B03_middle_frames",
    f"""with {LOW_RUNS}, h as (select *, cast(floor(start_frame + (end_frame + 1 - start_frame) / 2.0) as bigint) h from runs)
select seg, start_frame, cast(floor((start_frame + h) / 2.0) as bigint) middle_1, cast(floor((h + end_frame + 1) / 2.0) as bigint) middle_2 from h""",
)
def b03(spark, sf):
    a, b = geo.middle_frames(F.col("start_frame"), F.col("end_frame"))
    return low_runs(spark, sf).select("seg", "start_frame", a.alias("middle_1"), b.alias("middle_2"))


@query("B04_widening", f"with {FRAMES} select event_id, round(case when y <= 10 then 0.1 when y >= 40 then 0 else 0.1 * (40 - y) / 30 end, 6) share from fr")
def b04(spark, sf):
    return frames(spark, sf).select("event_id", F.round(geo.widening(F.col("y")), 6).alias("share"))


@query(
    "B05_angles",
    f"""with {FRAMES}, a as (select event_id, cast(trunc(degrees(atan2(y - 30, x - 50))) as int) a, cast(trunc(degrees(atan2(x - 50, 30 - y))) as int) b from fr),
t as (select event_id, case when a * b >= 0 then abs(a - b) else abs(a) + abs(b) end t from a) select event_id, case when t > 180 then 360 - t else t end angle from t""",
)
def b05(spark, sf):
    x, y = F.col("x") - 50, F.col("y") - 30
    return frames(spark, sf).select("event_id", geo.angle_between(x, y, 30 - F.col("y"), x).alias("angle"))


@query(
    "B06_ground_points",
    f"""with {FRAMES}, s as (select event_id, x, y, x / 100 s, (99 - x) / 100 t from fr), n as (select *, (s >= 0.4)::int + (t >= 0.4)::int n from s)
select event_id, round(case when n = 0 then x + 5 else ((case when s >= 0.4 then x else 0 end) + (case when t >= 0.4 then x + 8 else 0 end)) / n end, 4) gx,
round(case when n = 0 then y + 20 else ((case when s >= 0.4 then y else 0 end) + (case when t >= 0.4 then y + 2 else 0 end)) / n end, 4) gy from n""",
)
def b06(spark, sf):
    x, y = F.col("x"), F.col("y")
    gx, gy = geo.ground_point([(x, y, x / 100), (x + 8, y + 2, (99 - x) / 100)], [x, y, x + 10, y + 20], 0.4)
    return frames(spark, sf).select("event_id", r4(gx).alias("gx"), r4(gy).alias("gy"))


@query(
    "B09_court_projection",
    f"""with {FRAMES}, p as (select event_id, y * 3 px, x * 5 py from fr) select event_id, round((px - 200) / 100 / {COURT_WIDTH}, 6) cx, round((py - 100) / 100 / {COURT_LENGTH}, 6) cy, cast(100 as double) scale from p""",
)
def b09(spark, sf):
    court = [[F.lit(v) for v in row] for row in ((100.0, 0.0, 200.0), (0.0, 100.0, 100.0), (0.0, 0.0, 1.0))]
    back = geo.inverse(court)
    x, y = F.col("y") * 3, F.col("x") * 5
    cx, cy = geo.to_court(back, x, y)
    return frames(spark, sf).select("event_id", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"), r4(geo.ground_scale(court, back, x, y)).alias("scale"))


@query(
    "B17_labels",
    f"with {FRAMES} select event_id, case label when 'click' then 'ick' when 'view' then 'view' when 'purchase' then 'chase' else label end base, side from fr",
)
def b17(spark, sf):
    base = scalars.strip_prefix(F.col("label"), ["cl", "pur"])
    return frames(spark, sf).select("event_id", base.alias("base"), scalars.side_of(F.col("label"), ["click", "view"], ["purchase", "signup"]).alias("side"))


@query(
    "B21_probability_label",
    """with e as (select vec_id, embedding v from embeddings), m as (select vec_id, v, list_position(v, list_max(v)) - 1 i from e)
select vec_id, case when i <> 0 then 'class' || i end label, round(cast(list_max(v) as double), 4) confidence from m""",
)
def b21(spark, sf):
    name, conf = scalars.probability_label(F.col("embedding"), [f"class{i}" for i in range(64)], 0)
    return table(spark, sf, "embeddings").select("vec_id", name.alias("label"), r4(conf.cast("double")).alias("confidence"))


@query(
    "B25_timestamps",
    f"""with {FRAMES}, s as (select event_id, cast(round(y * 1000) as bigint) ms from fr)
select event_id, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms % 3600000 // 60000, ms % 60000 // 1000, ms % 1000) stamp from s""",
)
def b25(spark, sf):
    return frames(spark, sf).select("event_id", scalars.timestamp(F.round("y", 3)).alias("stamp"))


@query("B26_quantize", f"with {FRAMES} select event_id, cast(floor(greatest(0.0, least(255.0, y / 200 * 255))) as bigint) level from fr")
def b26(spark, sf):
    return frames(spark, sf).select("event_id", scalars.quantize(F.col("y") / 200).alias("level"))


@query("C01_min_duration", f"with {LOW_RUNS} select * from runs where n_frames >= ceil(0.1 * 30)")
def c01(spark, sf):
    return low_runs(spark, sf).where(F.col("n_frames") >= F.ceil(F.lit(0.1) * 30))


@query("C03_reject_outliers", f"with {FRAMES}, m as (select median(y) med from fr), s as (select avg((y > 3 * med)::int) share from fr, m) select event_id, y from fr, m, s where share > 0.3 or y <= 3 * med")
def c03(spark, sf):
    return stats.reject_outliers(frames(spark, sf).select("event_id", "y"), "y")


@query("C05_halves", f"with {FRAMES} select event_id, case when x / 100 < 0.5 then 'top' else 'bottom' end half from fr where x between 2 and 97")
def c05(spark, sf):
    rows = frames(spark, sf).where(F.col("x").between(2, 97))
    return rows.select("event_id", F.when(F.col("x") / 100 < 0.5, "top").otherwise("bottom").alias("half"))


@query(
    "C09_score_jumps",
    """with o as (select o_custkey k, o_orderkey, o_orderkey % 22 a, o_orderkey % 17 b, row_number() over (partition by o_custkey order by o_orderkey) i from orders),
l as (select *, lag(a) over (partition by k order by i) pa, lag(b) over (partition by k order by i) pb from o)
select o_orderkey, coalesce(not (a = 0 and b = 0) and a >= pa and b >= pb and a - pa + b - pb >= 2, false) jump, (a = 0 and b = 0) or (greatest(a, b) = 11 and least(a, b) < 11) is_break from l""",
)
def c09(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    a, b = F.col("o_orderkey") % 22, F.col("o_orderkey") % 17
    return table(spark, sf, "orders").select("o_orderkey", scalars.score_jump(a, b, F.lag(a).over(w), F.lag(b).over(w)).alias("jump"), scalars.break_score(a, b).alias("is_break"))


@query("C12_single_scene", f"with {FRAMES} select quantile_cont(y, 0.99) < 3 * greatest(median(y), 1) and max(y) < 6 * greatest(median(y), 1) single_scene from fr")
def c12(spark, sf):
    return stats.single_scene(frames(spark, sf), "y")


@query("C13_threshold_tail", f"with {FRAMES} select 40 < quantile_cont(y, 0.05) or 40 > quantile_cont(y, 0.95) near_edge from fr")
def c13(spark, sf):
    found = stats.quantiles(frames(spark, sf), "y", [0.05, 0.95])
    return spark.range(1).select(F.lit(bool(found) and (found[0] > 40 or found[1] < 40)).alias("near_edge"))


ABS = """c as (select vec_id, unnest(generate_series(1, 64)) d, embedding v from embeddings), x as (select vec_id, d, cast(v[d] as double) x from c),
t as (select a.vec_id, sum(abs(a.x - b.x)) total from x a join x b on a.d = b.d group by a.vec_id)"""


@query("D12_cross_distances", f"with {ABS} select vec_id, round(total, 3) total from t")
def d12(spark, sf):
    return stats.absolute_differences(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", F.round("total", 3).alias("total"))


@query("E07_cross_threshold", f"with {ABS}, a as (select vec_id, cast(round_even(total, 0) as bigint) avg from t) select vec_id, avg from a where avg <= (select round_even(min(avg) * 1.1, 0) from a)")
def e07(spark, sf):
    rows = stats.absolute_differences(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", geo.round_to_int(F.col("total")).alias("avg"))
    least = rows.agg(F.rint(F.min("avg") * 1.1).alias("limit"))
    return rows.join(F.broadcast(least)).where("avg <= limit").select("vec_id", "avg")


@query("E01_report", "select event_type, count(*) n, round(count(*) * 100.0 / sum(count(*)) over (), 4) share from events where event_type <> 'error' group by event_type")
def e01(spark, sf):
    counts = table(spark, sf, "events").where("event_type <> 'error'").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", r4(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())))


@query(
    "E03_static_cells",
    f"""with {FRAMES}, t as (select count(distinct seg) n from fr)
select cast(floor(y / 25) as bigint) cx, cast(floor(x / 25) as bigint) cy, count(distinct seg) frames, round(avg(y), 7) mx, round(avg(x), 7) my
from fr group by 1, 2 having count(distinct seg) / (select n from t)::double >= 0.25 and stddev_pop(y) <= 8 and stddev_pop(x) <= 8""",
)
def e03(spark, sf):
    return stats.static_cells(frames(spark, sf), "y", "x", "seg", 25, 0.25, 8).withColumns({c: F.round(c, 7) for c in ("mx", "my")})


@query(
    "E09_otsu_threshold",
    """with l as (select log10(greatest(value, 1.0)) x from events), r as (select min(x) lo, max(x) hi from l),
b as (select cast(least(floor((x - lo) / ((hi - lo) / 256)), 255) as int) i, count(*) c from l cross join r group by 1),
s as (select k.i, coalesce(c, 0) * cast(1 as double) / sum(coalesce(c, 0)) over () p, lo + (k.i + cast(0.5 as double)) * (hi - lo) / 256 ctr from (select range i from range(256)) k left join b on k.i = b.i cross join r),
w as (select i, ctr, sum(p) over (order by i) wt, sum(p * ctr) over (order by i) m, sum(p * ctr) over () mt from s),
v as (select a.i, z.i j, a.ctr, a.wt * pow(a.m / a.wt - a.mt, 2) + (z.wt - a.wt) * pow((z.m - a.m) / (z.wt - a.wt) - a.mt, 2) + (1 - z.wt) * pow((a.mt - z.m) / (1 - z.wt) - a.mt, 2) var
from w a join w z on z.i > a.i and z.i <= 254 where a.wt > 0 and z.wt - a.wt > 0 and 1 - z.wt > 0)
select round(pow(10, ctr), 4) threshold from v order by var desc, i, j limit 1""",
)
def e09(spark, sf):
    return stats.otsu3(table(spark, sf, "events"), F.col("value")).select(r4("threshold").alias("threshold"))


PIXELS = "px as (select l_suppkey cell, l_quantity v, l_orderkey, l_linenumber, l_extendedprice from lineitem)"


@query(
    "E12_composites",
    f"""with {PIXELS}, r as (select *, row_number() over (partition by cell order by v, l_orderkey, l_linenumber) i, count(*) over (partition by cell) n from px),
k as (select *, greatest(1, cast(floor(n * 0.1) as bigint)) k from r)
select cell, round(avg(v), 4) mean, round(median(v), 4) median, max(v) max, min(v) min, round(stddev_pop(v), 4) std, round(coalesce(avg(case when i > k and i <= n - k then v end), avg(v)), 4) trimmed from k group by cell""",
)
def e12(spark, sf):
    px = table(spark, sf, "lineitem").withColumnsRenamed({"l_suppkey": "cell", "l_quantity": "v"})
    out = stats.composites(px, "cell", "v", ["l_orderkey", "l_linenumber"])
    return out.withColumns({c: r4(c) for c in ("mean", "median", "std", "trimmed")})


@query(
    "E13_sigma_clip",
    f"""with {PIXELS}, s0 as (select cell, avg(v) m, greatest(stddev_pop(v), 1) s from px group by cell), p1 as (select cell, v from px join s0 using (cell) where abs(v - m) < 1.5 * s),
s1 as (select cell, avg(v) m, greatest(stddev_pop(v), 1) s from p1 group by cell), p2 as (select cell, v from p1 join s1 using (cell) where abs(v - m) < 1.5 * s)
select cell, round(avg(v), 4) clipped, count(*) n from p2 group by cell""",
)
def e13(spark, sf):
    px = table(spark, sf, "lineitem").withColumnsRenamed({"l_suppkey": "cell", "l_quantity": "v"})
    return stats.sigma_clip(px, "cell", "v", 2, 1.5).withColumn("clipped", r4("clipped"))


@query(
    "E14_dominant_bin",
    f"""with {PIXELS}, b as (select cell, cast(floor(l_extendedprice / 2000) as bigint) b, count(*) n, avg(l_extendedprice) m from px group by 1, 2),
r as (select *, row_number() over (partition by cell order by n desc, b) i from b) select cell, round(m, 2) dominant, n from r where i = 1""",
)
def e14(spark, sf):
    px = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "cell")
    return stats.dominant_bin(px, "cell", "l_extendedprice", 2000).withColumn("dominant", F.round("dominant", 2))


@query("E20_side_mass", "select vec_id, round(list_sum(cast(embedding[2:13] as double[])), 4) mass from embeddings")
def e20(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", r4(scalars.mass(v, 1, 12)).alias("mass"))


@query(
    "F05_top_classes",
    """with c as (select vec_id, unnest(generate_series(1, 64)) d, embedding v from embeddings), x as (select vec_id, d - 1 i, v[d] v from c),
r as (select *, row_number() over (partition by vec_id order by v desc, i) place from x) select vec_id, cast(i as int) i, round(cast(v as double), 5) v from r where place <= 3""",
)
def f05(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.explode(scalars.top_k(F.col("embedding"), 3)).alias("t"))
    return rows.select("vec_id", "t.i", F.round(F.col("t.v").cast("double"), 5).alias("v"))


@query("H01_union_first_wins", f"with {FRAMES}, u as (select seg, frame, 1 r from fr where label = 'click' union all select seg, frame, 2 from fr where y > 60), k as (select *, row_number() over (partition by seg, frame order by r) i from u) select seg, frame, r from k where i = 1")
def h01(spark, sf):
    rows = frames(spark, sf)
    hits = rows.where("label = 'click'").select("seg", "frame", F.lit(1).alias("r")).unionByName(rows.where("y > 60").select("seg", "frame", F.lit(2).alias("r")))
    return hits.groupBy("seg", "frame").agg(F.min("r").alias("r"))


@query("H02_rejected", f"with {FRAMES} select seg, frame from fr where y > 60 and label <> 'click'")
def h02(spark, sf):
    rows = frames(spark, sf)
    return rows.where("y > 60").select("seg", "frame").join(rows.where("label = 'click'").select("seg", "frame"), ["seg", "frame"], "left_anti")


@query("H03_union_max", f"with {FRAMES} select seg, x, max(y) top from (select seg, x, y from fr where label = 'click' union all select seg, x, y from fr where label = 'view') group by seg, x")
def h03(spark, sf):
    rows = frames(spark, sf).select("seg", "x", "y", "label")
    both = rows.where("label = 'click'").unionByName(rows.where("label = 'view'"))
    return both.groupBy("seg", "x").agg(F.max("y").alias("top"))


@query("H05_missing_frames", f"with {FRAMES}, n as (select seg, max(frame) n from fr group by seg), s as (select seg, unnest(generate_series(1, n)) frame from n) select s.seg, s.frame from s left join fr on s.seg = fr.seg and s.frame = fr.frame and fr.label <> 'error' where fr.seg is null")
def h05(spark, sf):
    rows = frames(spark, sf)
    spine = rows.groupBy("seg").agg(F.max("frame").alias("n")).select("seg", F.explode(F.expr("sequence(1L, n)")).alias("frame"))
    return spine.join(rows.where("label <> 'error'").select("seg", "frame"), ["seg", "frame"], "left_anti")


@query("H07_ordered_distinct", f"with {FRAMES} select seg, label, min(frame) first_frame from fr group by seg, label")
def h07(spark, sf):
    return frames(spark, sf).groupBy("seg", "label").agg(F.min("frame").alias("first_frame"))


@query("D14_densify", f"with {FRAMES}, n as (select seg, max(frame) n from fr group by seg), s as (select seg, unnest(generate_series(1, n)) frame from n), p as (select seg, frame, p.side player from s, (select unnest(['top', 'bottom']) side) p) select p.seg, p.frame, player, y from p left join fr on fr.seg = p.seg and fr.frame = p.frame and fr.side = player")
def d14(spark, sf):
    rows = frames(spark, sf)
    spine = rows.groupBy("seg").agg(F.max("frame").alias("n")).select("seg", F.explode(F.expr("sequence(1L, n)")).alias("frame"))
    spine = spine.select("seg", "frame", F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("player"))
    known = rows.where("side is not null").select("seg", "frame", F.col("side").alias("player"), "y")
    return spine.join(known, ["seg", "frame", "player"], "left")


@query("A07_excluded_frames", "with i as (select least(100 * o_orderkey, 100 * o_orderkey + o_custkey % 60 - 30) s, greatest(100 * o_orderkey, 100 * o_orderkey + o_custkey % 60 - 30) e from orders) select distinct unnest(generate_series(s, e)) frame from i")
def a07(spark, sf):
    rows = table(spark, sf, "orders")
    a = 100 * F.col("o_orderkey")
    z = a + F.col("o_custkey") % 60 - 30  # before the start, for some
    return rows.select(F.explode(F.sequence(F.least(a, z), F.greatest(a, z))).alias("frame")).distinct()


@query("A17_sample_frames", f"with {LOW_RUNS}, s as (select seg, start_frame, end_frame, unnest(generate_series(0, 2)) i from runs where n_frames >= 3) select distinct seg, start_frame, cast(floor(start_frame + i * ((end_frame - start_frame) / 2.0)) as bigint) frame from s")
def a17(spark, sf):
    rows = low_runs(spark, sf, 3)
    return rows.select("seg", "start_frame", F.explode(scalars.spaced(F.col("start_frame"), F.col("end_frame"), F.lit(3))).alias("frame"))


@query("I01_json_scores", """with j as (select event_id, cast(json_extract_string(props, '$.k') as int) k from events) select event_id, k - 1 score_a, k % 7 score_b from j""")
def i01(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    text = F.format_string('```json\n{"all_a": [3, %d], "score_b": %d\n```', k - 1, k % 7)
    a, b = scalars.scores(text)
    return table(spark, sf, "events").select("event_id", a.alias("score_a"), b.alias("score_b"))


@query("I02_salvage", """select event_id, len(regexp_extract_all(props, '-?[0-9]+')) n, cast(regexp_extract(props, '-?[0-9]+') as int) first from events""")
def i02(spark, sf):
    cut_off = F.concat(F.lit('{"k": ['), F.regexp_extract("props", "([0-9]+)", 1))
    found = scalars.salvage_array(cut_off, "k")
    return table(spark, sf, "events").select("event_id", F.size(found).alias("n"), F.get(found, F.lit(0)).alias("first"))


@query("I06_attempts", "select o_orderkey, 'm:' || o_orderstatus || ':None; n:' || o_custkey || ':1' note from orders")
def i06(spark, sf):
    one = lambda m, a, b: F.struct(F.lit(m).alias("m"), a.cast("string").alias("a"), b.cast("string").alias("b"))
    return table(spark, sf, "orders").select("o_orderkey", scalars.attempts(F.array(one("m", F.col("o_orderstatus"), F.lit(None)), one("n", F.col("o_custkey"), F.lit(1)))).alias("note"))


@query("I08_joined_flags", f"with {FRAMES} select event_id, concat_ws('+', case when y > 50 then 'high' end, case when x > 50 then 'wide' end, case when label = 'error' then 'error' end) reasons from fr")
def i08(spark, sf):
    return frames(spark, sf).select("event_id", scalars.joined_flags(high=F.col("y") > 50, wide=F.col("x") > 50, error=F.col("label") == "error").alias("reasons"))


@query("I11_fingerprints", "select page_id, substr(sha256(html), 1, 16) fingerprint from pages")
def i11(spark, sf):
    return table(spark, sf, "pages").select("page_id", scalars.fingerprint(F.col("html")).alias("fingerprint"))
