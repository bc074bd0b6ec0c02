"""Queries of records, views, debug tables, caches and envelopes that are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions import records, scalars
from ..operators import folds, runs
from ..sources import cache, envelope
from ..sources.shared import shared_path, written
from . import runner
from .registry import FRAMES, frames, query, r4, table
from .run_queries import LOW_RUNS, low_runs

@query("A06_first_court", f"with {FRAMES} select event_id, round((x - 10) / 2, 6) u, round((y - 20) / 4, 6) v from fr")
def a06(spark, sf):
    path = shared_path(spark, "court")
    one = 'named_struct("homography", array(array(2D, 0D, 10D), array(0D, 4D, 20D), array(0D, 0D, 1D)))'
    spark.range(1).select(F.expr(f"array({one}, named_struct('homography', array(array(1D), array(1D), array(1D)))) courts")).coalesce(1).write.json(path)
    court = envelope.read_court(spark, path)
    u, v = geo.project(geo.matrix(F.col("image_to_court")), F.col("x"), F.col("y"))
    return frames(spark, sf).join(F.broadcast(court)).select("event_id", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("A03_segments_envelope", f"with {LOW_RUNS} select seg, start_frame, end_frame, 25.0::double fps, row_number() over (order by seg, start_frame) - 1 segment_index from runs where n_frames >= 6")
def a03(spark, sf):
    """Records, segments and their metadata (A01, A02, A04, A05), written as one envelope and read back."""
    path = shared_path(spark, "segments")
    envelope.write_records(low_runs(spark, sf, 6).select("seg", "start_frame", "end_frame"), path, "segments", ["seg", "start_frame"], fps=25.0)
    return envelope.read_segments(spark, path, T.StructType.fromDDL("seg long, start_frame long, end_frame long"))


@query("A19_heatmap_cache", f"with {FRAMES} select seg, frame, x, y from fr where y >= 10")
def a19(spark, sf):
    """Pixels in a cache by segment (A19, A21), dark ones dropped; a second pass has nothing to add (L05)."""
    rows = frames(spark, sf).select("seg", "frame", "x", "y")
    kept = cache.Cache(spark, shared_path(spark, "cache"), "part", height=288)
    pixels = cache.sparse_pixels(rows.withColumn("part", F.col("seg") % 16), "y")
    kept.add(pixels)
    assert kept.missing(pixels.select("part").distinct()).isEmpty()
    return kept.read().select("seg", "frame", "x", "y")


@query("A20_ragged_cache", f"with {FRAMES} select seg, frame // 5 g, frame, y from fr")
def a20(spark, sf):
    """Detections of a frame as an array, cached, read and split again."""
    rows = frames(spark, sf).groupBy("seg", F.floor(F.col("frame") / 5).alias("g")).agg(F.collect_list(F.struct("frame", "y")).alias("d"))
    kept = cache.Cache(spark, shared_path(spark, "cache"), "part", rows="ragged")
    kept.add(rows.withColumn("part", F.col("seg") % 16))
    return kept.read().select("seg", "g", F.explode("d").alias("d")).select("seg", "g", "d.frame", "d.y")


@query("A22_skeleton_csv", f"with {FRAMES}, n as (select seg, max(frame) n from fr group by seg), s as (select seg, unnest(generate_series(1, n)) frame, unnest(['top', 'bottom']) player from n where false union all select seg, unnest(generate_series(1, n)) frame, 'top' from n union all select seg, unnest(generate_series(1, n)) frame, 'bottom' from n) select s.seg, s.frame, s.player, case when y is not null then printf('%.2f', y) end y from s left join fr on s.seg = fr.seg and s.frame = fr.frame and s.player = fr.side")
def a22(spark, sf):
    path = shared_path(spark, "skeletons")
    rows = frames(spark, sf)
    spine = rows.groupBy("seg").agg(F.max("frame").alias("n")).select("seg", F.explode(F.expr("sequence(1L, n)")).alias("frame"))
    spine = spine.select("seg", "frame", F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("player"))
    known = rows.where("side is not null").select("seg", "frame", F.col("side").alias("player"), "y")
    on = ["part", "seg", "frame", "player"]
    envelope.write_dense_csv(known.withColumn("part", F.col("seg") % 16), spine.withColumn("part", F.col("seg") % 16), on, "part", path, {"y": "%.2f"})
    return spark.read.schema("seg long, frame long, player string, y string, part long").option("header", True).csv(path).drop("part")


@query("A26_points", f"with {FRAMES} select x, y from fr where x is not null")
def a26(spark, sf):
    path = shared_path(spark, "points")
    frames(spark, sf).where("x is not null").select("x", "y").write.option("sep", ";").csv(path)
    return envelope.read_points(spark, path)


@query(
    "A23_hit_table",
    f"""with {FRAMES} select seg, frame "Frame", case when label <> 'error' then 1 else 0 end "Visibility", case when label <> 'error' then cast(round_even(x, 0) as bigint) else 0 end "X",
case when label <> 'error' then cast(round_even(y, 0) as bigint) else 0 end "Y", case when y >= 60 then 1 else 0 end "Hit",
case when side is not null then label || '+Ypeak' end "Reason", case when side is not null then 1 end "Candidate", case when side is not null then y >= 60 end "Kept" from fr""",
)
def a23(spark, sf):
    rows = frames(spark, sf)
    seen = rows.select("seg", "frame", *(F.when(F.col("label") != "error", F.col(c)).alias(c) for c in ("x", "y")))
    details = rows.where("side is not null").select("seg", "frame", F.concat_ws("+", "label", F.lit("Ypeak")).alias("Reason"), F.lit(1).alias("Candidate"), (F.col("y") >= 60).alias("Kept"))
    made = records.hit_table(seen, details, rows.where("y >= 60"), "seg")
    assert made.columns == ["seg", *records.HIT_COLUMNS]
    return made.select("seg", *records.HIT_COLUMNS[:7], "Kept")


@query(
    "A24_stroke_table",
    f"""with {FRAMES}, q as (select *, [x / 400.0, floor(y) / 1000.0, (frame % 7) / 20.0] q from fr), p as (select *, list_append(q, 1 - list_sum(q)) p from q),
k as (select *, ['unknown', 'top_a', 'top_b', 'bottom_a'] names, list_reverse_sort(list_transform([1, 2, 3, 4], lambda i: {{'v': p[i], 'i': i}})) o from p)
select event_id "Event", frame "Frame", printf('%.4f', x / 100.0) "Confidence", names[list_position(p, list_max(p))] "RawClass", printf('%.4f', p[1]) p_unknown, printf('%.4f', p[2] + p[3]) p_top, printf('%.4f', p[4]) p_bottom,
names[o[1].i] || '(' || printf('%.0f', round_even(o[1].v * 100, 0)) || '%)' "Top1", names[o[2].i] || '(' || printf('%.0f', round_even(o[2].v * 100, 0)) || '%)' "Top2", frame + 2 - greatest(frame - 2, 1) "WinLen", coalesce(side, '') "Player" from k""",
)
def a24(spark, sf):
    path = shared_path(spark, "strokes")
    own = [F.col("x") / 400.0, F.floor("y") / 1000.0, F.col("frame") % 7 / 20.0]
    p = F.array(*own, 1 - (own[0] + own[1] + own[2]))
    rows = frames(spark, sf).select(F.col("event_id").alias("event"), "frame", F.col("seg").alias("segment"), F.col("frame").alias("local_frame"), F.greatest(F.col("frame") - 2, F.lit(1)).alias("win_start"), (F.col("frame") + 2).alias("win_end"), F.col("side").alias("player"), F.lit("b").alias("stroke"), (F.col("x") / 100.0).alias("confidence"), p.alias("p"))
    made = records.stroke_table(rows, ["unknown", "top_a", "top_b", "bottom_a"], 0, [1, 2], [3], 2)
    records.write_csv_with_mark(made, path)
    kinds = ", ".join(f"`{c}` {'long' if t in ('bigint', 'int') else t}" for c, t in made.dtypes)
    return spark.read.schema(kinds).option("header", True).option("enforceSchema", True).option("emptyValue", "").csv(path).select("Event", "Frame", "Confidence", "RawClass", "p_unknown", "p_top", "p_bottom", "Top1", "Top2", "WinLen", F.coalesce("Player", F.lit("")).alias("Player"))


@query(
    "B08_inverse",
    f"""with {FRAMES}, m as (select event_id, x + 1.0 a, y / 10 b, 3.0 c, frame % 5 - 2.0 d, x - y / 7 e, 1.0 f, case when frame % 9 = 0 then 2 * (x + 1.0) else frame % 3 / 4.0 end g, case when frame % 9 = 0 then y / 5 else x / 50 end h, case when frame % 9 = 0 then 6.0 else 1.0 + frame % 4 end i from fr),
k as (select *, a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) det from m)
select event_id, case when ok then round((e * i - f * h) / det, 6) + 0.0 end p, case when ok then round((c * h - b * i) / det, 6) + 0.0 end q, case when ok then round((c * d - a * f) / det, 6) + 0.0 end r, case when ok then round((d * h - e * g) / det, 6) + 0.0 end s, case when ok then round((a * e - b * d) / det, 6) + 0.0 end t
from (select *, abs(det) > 1e-6 ok from k)""",
)
def b08(spark, sf):
    """Inverses of full matrices, every ninth of them singular: its last row is twice its first."""
    x, y, f, bad = F.col("x"), F.col("y"), F.col("frame"), F.col("frame") % 9 == 0
    rows = [[x + 1.0, y / 10, F.lit(3.0)], [f % 5 - 2.0, x - y / 7, F.lit(1.0)], [F.when(bad, 2 * (x + 1.0)).otherwise(f % 3 / 4.0), F.when(bad, y / 5).otherwise(x / 50), F.when(bad, 6.0).otherwise(1.0 + f % 4)]]
    m = geo.inverse(rows)
    # what is singular but for rounding is left out of the comparison
    det = rows[0][0] * (rows[1][1] * rows[2][2] - rows[1][2] * rows[2][1]) - rows[0][1] * (rows[1][0] * rows[2][2] - rows[1][2] * rows[2][0]) + rows[0][2] * (rows[1][0] * rows[2][1] - rows[1][1] * rows[2][0])
    told = {"p": m[0][0], "q": m[0][1], "r": m[1][2], "s": m[2][0], "t": m[2][2]}
    return frames(spark, sf).select("event_id", *(F.when(F.abs(det) > 1e-6, F.round(c, 6) + 0.0).alias(n) for n, c in told.items()))


@query("B10_ground_scale", f"with {FRAMES} select event_id, round(sqrt(power(20 * (1 + x / 100), 2)), 6) scale from fr where x is not null")
def b10(spark, sf):
    """A view whose pixels a metre grow with x."""
    down = F.lit(20.0) * (1 + F.col("x") / 100)
    court = [[F.lit(10.0), F.lit(0.0), F.lit(5.0)], [F.lit(0.0), down, F.lit(7.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]
    return frames(spark, sf).where("x is not null").select("event_id", F.round(geo.ground_scale(court, geo.inverse(court), F.col("x"), F.col("y")), 6).alias("scale"))


@query("B18_rescaled", "select p_partkey, greatest(1, cast(round_even(12 * (p_size / 25.0), 0) as bigint)) n, round(p_size / 512.0, 6) sx, round(p_size / 288.0, 6) sy from part")
def b18(spark, sf):
    sx, sy = records.scale_factors(F.col("p_size"), F.col("p_size"), 512.0, 288.0)
    return table(spark, sf, "part").select("p_partkey", records.rescaled(F.lit(12), F.col("p_size") / 25.0).alias("n"), F.round(sx, 6).alias("sx"), F.round(sy, 6).alias("sy"))


@query("B20_records", f"with {FRAMES} select event_id, 100 + frame frame, case when label <> 'error' then round(x / 7, 2) end x, case when label <> 'error' then round(y / 7, 2) end y, label <> 'error' visible, round(y / 100, 4) confidence, case when side is not null then round(y / 3, 2) end kx, case when side is not null then round(y / 100, 4) end ks from fr")
def b20(spark, sf):
    x, y = (F.when(F.col("label") != "error", F.col(c) / 7) for c in ("x", "y"))
    joints = F.when(F.col("side").isNotNull(), F.array(F.array(F.col("y") / 3, F.col("y") / 9, F.col("y") / 100)))
    keypoints, _ = records.pose_record(joints, F.array(F.col("y"), F.col("y")))
    first = F.get(keypoints, F.lit(0))
    return frames(spark, sf).select("event_id", *records.shuttle_record(F.lit(100), F.col("frame"), x, y, F.col("y") / 100), F.get(first, F.lit(0)).alias("kx"), F.get(first, F.lit(2)).alias("ks"))


@query("B24_view_sizes", "select p_partkey, round(least(640.0 / p_size, 20.0 / (p_size + 5), 1.0), 6) fit, round(cast(0.75 * p_size as double), 6) x, round(cast(0.25 * (p_size + 5) as double), 6) y, greatest(1, cast(round_even((p_size + 5) * 100 / p_size, 0) as bigint)) h from part")
def b24(spark, sf):
    """Fit to a display, default corners (the right upper one) and a proportional height (B27)."""
    w, h = F.col("p_size"), F.col("p_size") + 5
    corner = F.get(records.default_corners(w, h), F.lit(1))
    return table(spark, sf, "part").select("p_partkey", F.round(records.fit_scale(w, h, 640.0, 20.0), 6).alias("fit"), F.round(F.get(corner, F.lit(0)), 6).alias("x"), F.round(F.get(corner, F.lit(1)), 6).alias("y"), records.proportional_height(w, h, 100).alias("h"))


@query("B28_ensemble_weights", f"with {FRAMES}, w as (select seg, frame, y, frame - min(frame) over (partition by seg) i from fr) select seg, round(sum(y * [1, 2, 3, 2, 1][i + 1]) / 9, 4) v from w where i < 5 group by seg")
def b28(spark, sf):
    weights = F.array(*map(F.lit, scalars.triangular_weights(5)))
    return frames(spark, sf).where("frame <= 5").groupBy("seg").agg(r4(F.sum(F.col("y") * F.get(weights, (F.col("frame") - 1).cast("int")))).alias("v"))


@query("C02_within_threshold", f"with {FRAMES}, a as (select seg, avg(y) v from fr group by seg), t as (select 1.1 * min(v) bar from a) select seg from a, t where v <= bar")
def c02(spark, sf):
    means = written(frames(spark, sf).groupBy("seg").agg(F.avg("y").alias("v")))
    bar = means.agg((1.1 * F.min("v")).alias("bar"))
    return means.join(F.broadcast(bar)).where("v <= bar").select("seg")


@query("C08_person_area", "select p_partkey from part where p_size * (p_size + 2) >= 400")
def c08(spark, sf):
    size, zero = F.col("p_size"), F.lit(0)
    return table(spark, sf, "part").where(records.large_enough(zero, zero, size, size + 2, 400)).select("p_partkey")


@query("C10_break_scores", "select event_id, (a = 0 and b = 0) or (greatest(a, b) = 11 and least(a, b) < 11) brk from (select event_id, event_id % 12 a, user_id % 12 b from events)")
def c10(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.break_score(F.col("event_id") % 12, F.col("user_id") % 12).alias("brk"))


@query("C11_reading_rank", "select event_id, a is not null and b is not null stop, case when a is not null and b is not null then 0 else 1 end rank from (select event_id, nullif(event_id % 3, 0) a, nullif(user_id % 2, 0) b from events)")
def c11(spark, sf):
    a, b = F.nullif(F.col("event_id") % 3, F.lit(0)), F.nullif(F.col("user_id") % 2, F.lit(0))
    return table(spark, sf, "events").select("event_id", records.both_known(a, b).alias("stop"), records.reading_rank(a, b).alias("rank"))


@query("C15_of_method", f"with {FRAMES} select event_id from fr where label = 'view' and x is not null and side = 'top'")
def c15(spark, sf):
    return records.of_method(frames(spark, sf), "view", "label").where("x is not null and side = 'top'").select("event_id")


@query("D18_nested_skeletons", f"with {FRAMES} select seg, frame, side player, j joint, y + j y from fr, (select unnest([0, 1, 2]) j) where side is not null")
def d18(spark, sf):
    tall = frames(spark, sf).where("side is not null").select("seg", "frame", F.col("side").alias("player"), F.explode(F.array(*map(F.lit, range(3)))).alias("joint"), "y")
    nest = records.nested_skeletons(tall.withColumn("y", F.col("y") + F.col("joint")), "seg", "frame", "player", "joint", ["y"])
    split = nest.select("seg", "frame", F.explode("skeletons").alias("player", "j"))
    return split.select("seg", "frame", "player", F.explode("j").alias("joint", "v")).select("seg", "frame", "player", "joint", "v.y")


@query(
    "E15_background_median",
    f"""with {FRAMES}, n as (select seg, max(frame) n from fr group by seg),
s as (select distinct seg, cast(floor(1 + i * ((n - 1) / greatest(least(n, 12) - 1, 1))) as bigint) frame from n, (select unnest(range(12)) i) where i < least(n, 12))
select seg, round(median(y), 4) background from s join fr using (seg, frame) group by seg""",
)
def e15(spark, sf):
    """The median over at most 12 frames spread evenly over a segment."""
    rows = frames(spark, sf)
    n = rows.groupBy("seg").agg(F.max("frame").alias("n"))
    at = n.select("seg", F.explode(scalars.spaced(F.lit(1), F.col("n"), F.least("n", F.lit(12)))).alias("frame"))
    return rows.join(at, ["seg", "frame"]).groupBy("seg").agg(r4(F.percentile("y", 0.5)).alias("background"))


def pixels(spark, sf):
    return frames(spark, sf).groupBy((F.col("seg") % 10).alias("g"), F.floor("y").alias("x"), F.floor("x").alias("y")).agg(F.count("*").cast("double").alias("v"))


@query("G08_largest_blob")
def g08(spark, sf):
    return folds.largest_blobs(folds.blobs(pixels(spark, sf), ["g"]), ["g"]).withColumns({"cx": r4("cx"), "cy": r4("cy")})


@query("J04_baseline_track")
def j04(spark, sf):
    return folds.baseline_track(pixels(spark, sf), ["g"], 2.0, 3.0, 1.0)


@query("G06_restored_order", f"with {FRAMES}, m as (select seg, label, count(*) n, min(frame) first from fr group by seg, label) select seg, label, row_number() over (partition by seg order by first) - 1 event_index from m")
def g06(spark, sf):
    """Labels in the order in which they first come, whatever grouping did to it."""
    first = frames(spark, sf).groupBy("seg", "label").agg(F.min("frame").alias("first"))
    order = first.groupBy("seg").agg(F.array_sort(F.collect_list(F.struct("first", "label"))).alias("o"))
    return order.select("seg", F.posexplode("o").alias("event_index", "r")).select("seg", "r.label", F.col("event_index").cast("long").alias("event_index"))


@query("I10_iso_utc", "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') iso from events")
def i10(spark, sf):
    return table(spark, sf, "events").select("event_id", records.iso_utc(F.col("ts").cast("timestamp")).alias("iso"))


_NEEDS = "(select n_name from nation m where n.n_nationkey > 0 and m.n_nationkey = n.n_nationkey // 2)"
_AFTER = "(select n_name from nation m where m.n_nationkey = n.n_nationkey - 1 - n.n_regionkey)"


@query(
    "L01_stage_order",
    f"""with recursive st as materialized (select n_name, list_filter([{_NEEDS}, {_AFTER}], lambda d: d is not null) deps from nation n),
r as (select 0 i, cast([] as varchar[]) done union all
select i + 1, list_append(done, (select min(n_name) from st where not list_contains(done, n_name) and len(list_filter(deps, lambda d: not list_contains(done, d))) = 0)) from r where i < (select count(*) from st))
select generate_subscripts(done, 1) - 1 place, unnest(done) stage from r where i = (select count(*) from st)""",
)
def l01(spark, sf):
    """Stages and what they need (L01) or only follow (L02) from a table; by name among those ready."""
    rows = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name").collect()  # a graph of stages
    name = {r["n_nationkey"]: r["n_name"] for r in rows}
    own = lambda k: (name[k],) if k in name else ()
    stages = [runner.Stage(r["n_name"], lambda: "", own(r["n_nationkey"] // 2) if r["n_nationkey"] > 0 else (), own(r["n_nationkey"] - 1 - r["n_regionkey"])) for r in rows]
    return spark.createDataFrame([(i, s.name) for i, s in enumerate(runner.ordered(stages))], "place long, stage string")


@query(
    "L03_resumed_run",
    """with n as (select r_name, r_regionkey k, count(c_custkey) n from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by all),
e as (select k from n where r_name = 'EUROPE')
select run, r_name stage, case when run = 2 or n.k < e.k then 'completed' when n.k = e.k then 'failed' else 'pending' end status, case when run = 2 or n.k < e.k then n end customers from n, e, (values (1), (2)) t(run)""",
)
def l03(spark, sf):
    """A stage for each region counts its customers (L07) once the region before is done (L03); one fails at first (L04), and a second run goes on from there."""
    regions = {r["r_regionkey"]: r["r_name"] for r in table(spark, sf, "region").select("r_regionkey", "r_name").collect()}  # a graph of stages
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    store, told, broken = shared_path(spark, "states").removeprefix("file:"), [], {"EUROPE"}

    def stage(key):
        def body():
            if regions[key] in broken:
                broken.clear()
                raise RuntimeError("the first time")
            path = shared_path(spark, "customers")
            people.where(F.col("n_regionkey") == key).agg(F.count("*").alias("customers")).write.parquet(path)
            return path

        return runner.Stage(regions[key], body, (regions[key - 1],) if key - 1 in regions else ())

    for attempt in (1, 2):
        states = runner.States(f"{store}/states.json")
        runner.run([stage(k) for k in regions], states)
        for name in regions.values():
            path = states.known.get(name, {}).get("output_path")
            told.append((attempt, name, states.of(name), spark.read.parquet(path).first()["customers"] if path else None))
    return spark.createDataFrame(told, "run int, stage string, status string, customers long")


@query("L06_two_phases", f"with {FRAMES}, d as (select seg, frame, abs(y - lag(y) over (partition by seg order by frame)) d from fr) select seg, frame from d where d >= 30")
def l06(spark, sf):
    """The expensive scan is cached by segment; the cheap decision is made on the cache, so another bar needs no new scan."""
    scans = []

    def scan(rows):
        scans.append(1)
        moved = runs.changes(rows, "seg", "frame", "y")
        return moved.withColumn("part", F.col("seg") % 16)

    kept = cache.Cache(spark, shared_path(spark, "scan"), "part", rows="changes")
    for bar in (50, 30):
        out = cache.two_phases(kept, frames(spark, sf).withColumn("part", F.col("seg") % 16), scan, lambda found, bar=bar: found.where(F.col("d") >= bar))
    assert len(scans) == 1
    return out.select("seg", "frame")
