"""Queries over runs, intervals and sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import bands, folds, runs, stats
from ..operators.smoothing import Motion
from .registry import FRAMES, frames, query, r4, table

LOW_RUNS = f"""{FRAMES}, m as (select *, y < 40 low from fr), g as (select *, frame - row_number() over (partition by seg order by frame) g from m where low),
runs as (select seg, min(frame) start_frame, max(frame) end_frame, count(*) n_frames from g group by seg, g)"""


def low_runs(spark, sf, least=1):
    return runs.mask_runs(frames(spark, sf), "seg", "frame", F.col("y") < 40, least)


@query(
    "S00_low_value_segments",
    f"""with {LOW_RUNS}, ok as (select * from runs where n_frames >= 3)
select ok.seg, start_frame, end_frame, n_frames, count(*) n_events, round(avg(y), 4) mean_y, round(start_frame / 25.0, 3) start_sec,
round(end_frame / 25.0, 3) end_sec, round((end_frame - start_frame) / 25.0, 3) duration_sec
from ok join fr on fr.seg = ok.seg and frame between start_frame and end_frame group by all""",
)
def s00(spark, sf):
    rows = frames(spark, sf)
    found = runs.mask_runs(rows, "seg", "frame", F.col("y") < 40, 3).withColumn("index", F.col("start_frame"))
    inside = bands.locate(rows, found, "seg", "frame", "start_frame", "end_frame", "index").where("index is not null")
    counts = inside.groupBy("seg", F.col("index").alias("start_frame")).agg(F.count("*").alias("n_events"), r4(F.avg("y")).alias("mean_y"))
    return found.drop("index").join(counts, ["seg", "start_frame"]).withColumns(geo.segment_seconds(F.col("start_frame"), F.col("end_frame"), 25.0))


@query("F01_mask_runs", f"with {LOW_RUNS} select * from runs where n_frames >= 3")
def f01(spark, sf):
    return low_runs(spark, sf, 3)


@query(
    "F02_label_runs",
    f"""with {FRAMES}, k as (select * from fr where label <> 'error'),
c as (select *, case when label = lag(label) over w and frame - lag(frame) over w <= 1 then 0 else 1 end n from k window w as (partition by seg order by frame)),
r as (select *, sum(n) over (partition by seg order by frame) run from c)
select seg, label, min(frame) f0, max(frame) f1, count(*) n, round(avg(y), 4) mean_conf, max(y) peak, round(sum(frame * y) / sum(y), 4) center
from r group by seg, label, run having count(*) >= 2 and max(y) >= 20""",
)
def f02(spark, sf):
    rows = frames(spark, sf).withColumn("label", F.when(F.col("label") != "error", F.col("label")))
    found = runs.label_runs(rows, "seg", "frame", "label", 1, "y").where("n >= 2 and peak >= 20")
    return found.withColumns({c: r4(c) for c in ("mean_conf", "center")})


@query(
    "F03_known_runs",
    f"""with {FRAMES}, g as (select *, frame - row_number() over (partition by seg order by frame) g from fr where label <> 'error')
select seg, min(frame) onset, max(frame) end_frame, count(*) n_frames from g group by seg, g""",
)
def f03(spark, sf):
    return runs.mask_runs(frames(spark, sf), "seg", "frame", F.col("label") != "error").withColumnRenamed("start_frame", "onset")


@query(
    "F04_merge_by_gap",
    f"""with {LOW_RUNS}, e as (select *, lag(end_frame) over (partition by seg order by start_frame) p from runs),
n as (select *, sum(case when start_frame > p + 3 or p is null then 1 else 0 end) over (partition by seg order by start_frame) i from e)
select seg, min(start_frame) start_frame, max(end_frame) end_frame, count(*) n from n group by seg, i""",
)
def f04(spark, sf):
    return runs.merge_intervals(low_runs(spark, sf), "seg", "start_frame", "end_frame", 3)


INTERVALS = """iv as (select user_id, event_id, epoch_us(ts) // 1000000 - 600 st, epoch_us(ts) // 1000000 + 600 en from events)"""
MERGED = f"""{INTERVALS}, r as (select *, max(en) over (partition by user_id order by st, en rows between unbounded preceding and 1 preceding) reach from iv),
i as (select *, sum(case when reach is null or st > reach then 1 else 0 end) over (partition by user_id order by st, en rows unbounded preceding) isl from r),
mg as (select user_id, min(st) st, max(en) en, count(*) n from i group by user_id, isl)"""


def intervals(spark, sf):
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    return table(spark, sf, "events").select("user_id", (t - 600).alias("st"), (t + 600).alias("en"))


@query("E08_merge_intervals", f"with {MERGED} select * from mg")
def e08(spark, sf):
    return runs.merge_intervals(intervals(spark, sf), "user_id", "st", "en")


@query(
    "H04_interval_complement",
    f"""with {MERGED}, g as (select user_id, en a, lead(st) over (partition by user_id order by st) z from mg
union all select user_id, min(st) - 3600, min(st) from mg group by 1 union all select user_id, max(en), max(en) + 3600 from mg group by 1)
select user_id, a st, z en from g where z > a""",
)
def h04(spark, sf):
    merged = runs.merge_intervals(intervals(spark, sf), "user_id", "st", "en")
    w = Window.partitionBy("user_id")
    merged = merged.withColumn("lo", F.min("st").over(w) - 3600).withColumn("hi", F.max("en").over(w) + 3600)
    return runs.complement(merged, "user_id", "st", "en", F.col("lo"), F.col("hi"))


ORDERED = "od as (select o_custkey k, o_orderkey, o_orderstatus s, o_orderpriority p, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) i from orders)"


def ordered(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.row_number().over(w).alias("i"))


@query("F23_collapse_equal", f"with {ORDERED}, l as (select *, lag(s) over (partition by k order by i) b from od) select k, o_orderkey, s, p, i from l where i = 1 or b is distinct from s")
def f23(spark, sf):
    return runs.collapse_equal(ordered(spark, sf), "k", ["i"], F.col("s"))


@query(
    "F22_dead_rows",
    f"""with {ORDERED}, l as (select *, lag(s) over (partition by k order by i) b from od),
r as (select *, sum(case when i = 1 or b is distinct from s then 1 else 0 end) over (partition by k order by i) run from l),
n as (select *, count(*) over (partition by k, run) n, max(case when p = '1-URGENT' then i end) over (partition by k, run) z from r)
select k, o_orderkey, s, p, i from n where n >= 2 and s <> 'P' and i < z""",
)
def f22(spark, sf):
    return runs.dead_rows(ordered(spark, sf), "k", "i", F.col("s"), F.col("p") == "1-URGENT", F.col("s") != "P")


@query(
    "D06_previous_known",
    f"""with {ORDERED}, v as (select *, case when s <> 'P' then o_orderkey end v from od)
select k, i, last_value(v ignore nulls) over (partition by k order by i rows between unbounded preceding and 1 preceding) prev from v""",
)
def d06(spark, sf):
    rows = bands.previous_known(ordered(spark, sf), "k", ["i"], F.when(F.col("s") != "P", F.col("o_orderkey")), "prev")
    return rows.select("k", "i", "prev")


@query(
    "F16_greedy_dedup",
    f"""with recursive {FRAMES}, q as (select seg, frame f, side, coalesce(y, 'infinity') s, row_number() over (partition by seg order by frame) i from fr where side is not null),
r as (select seg, i, f, side, s, cast(null as bigint) df, cast(null as varchar) dside from q where i = 1
union all select q.seg, q.i, case when q.f - r.f < 4 and q.side = r.side and q.s <= r.s then r.f else q.f end, q.side, case when q.f - r.f < 4 and q.side = r.side then greatest(q.s, r.s) else q.s end,
case when q.f - r.f < 4 and q.side = r.side then null else r.f end, case when q.f - r.f < 4 and q.side = r.side then null else r.side end from r join q on q.seg = r.seg and q.i = r.i + 1)
select seg, df frame, dside side from r where df is not null union all select seg, arg_max(f, i), arg_max(side, i) from r group by seg""",
)
def f16(spark, sf):
    rows = frames(spark, sf).where("side is not null")
    return folds.greedy_dedup(rows, "seg", "frame", "side", "y", 4)


@query(
    "F28_snap_boundaries",
    f"""with recursive {LOW_RUNS}, q as (select seg, start_frame a, end_frame z, case when start_frame % 3 = 0 then start_frame - 2 else start_frame end c,
row_number() over (partition by seg order by start_frame) i from runs where n_frames >= 2),
r as (select seg, i, greatest(c, 0) a, greatest(z, c, 0) z from q where i = 1
union all select q.seg, q.i, greatest(q.c, r.z + 1), greatest(q.z, q.c, r.z + 1) from r join q on q.seg = r.seg and q.i = r.i + 1) select seg, a start_frame, z end_frame from r""",
)
def f28(spark, sf):
    rows = low_runs(spark, sf, 2).withColumn("cut", F.when(F.col("start_frame") % 3 == 0, F.col("start_frame") - 2))
    return folds.snap_boundaries(rows, "seg", "start_frame", "end_frame", "cut", 5)


@query(
    "J12_prune_tail",
    f"""with {FRAMES}, q as (select seg, frame, coalesce(y >= 30, true) k, case when frame - lag(frame) over (partition by seg order by frame) <= 3 then 0 else 1 end n from fr where side is not null),
r as (select *, sum(n) over (partition by seg order by frame) r from q), m as (select *, max(frame) filter (k) over (partition by seg, r) z from r) select seg, frame from m where frame <= z""",
)
def j12(spark, sf):
    return folds.prune_tail(frames(spark, sf).where("side is not null"), "seg", "frame", F.col("y") >= 30, 3).select("seg", "frame")


PEAKS = f"""{FRAMES}, u as (select *, lag(y) over (partition by seg order by frame) py from fr),
v as (select *, sum(case when py is null or y <> py then 1 else 0 end) over (partition by seg order by frame) g from u),
level as (select seg, g, min(frame) a, max(frame) e, any_value(y) y from v group by seg, g),
beside as (select *, lag(y) over (partition by seg order by g) before, lead(y) over (partition by seg order by g) after from level),
pk as (select seg, (a - 1 + e - 1) // 2 + 1 frame, y from beside where y > before and y > after)"""


@query(
    "F08_prominent_peaks",
    f"""with {PEAKS}, h as (select pk.seg, pk.frame, pk.y, max(fr.frame) filter (fr.frame < pk.frame and fr.y > pk.y) l, min(fr.frame) filter (fr.frame > pk.frame and fr.y > pk.y) r
from pk join fr on pk.seg = fr.seg group by all),
m as (select h.seg, h.frame, h.y, min(fr.y) filter (fr.frame <= h.frame and fr.frame > coalesce(l, 0)) lm, min(fr.y) filter (fr.frame >= h.frame and (r is null or fr.frame < r)) rm
from h join fr on h.seg = fr.seg group by h.seg, h.frame, h.y) select seg, frame, y from m where y - greatest(lm, rm) >= 30""",
)
def f08(spark, sf):
    return folds.peaks(frames(spark, sf), "seg", "frame", "y", 1, 30.0)


@query(
    "F09_spaced_peaks",
    f"""with recursive {PEAKS}, k as (select *, row_number() over (partition by seg order by y desc, frame desc) i from pk),
r as (select seg, i, frame, y, true ok, [frame] kept from k where i = 1
union all select k.seg, k.i, k.frame, k.y, len(list_filter(kept, lambda f: abs(f - k.frame) < 5)) = 0,
case when len(list_filter(kept, lambda f: abs(f - k.frame) < 5)) = 0 then list_append(kept, k.frame) else kept end from r join k on k.seg = r.seg and k.i = r.i + 1)
select seg, frame, y from r where ok""",
)
def f09(spark, sf):
    return folds.peaks(frames(spark, sf), "seg", "frame", "y", 5)


#: A place of 0 to 100 and 0 to 490: the published speeds are for 1,920 by 1,080 pixels.
STEPS = {"speed": 30.0, "slack": 10.0, "usual": 25.0}


@query("J01_viterbi_path")
def j01(spark, sf):
    return folds.viterbi_path(confident(spark, sf), "seg", "frame", "x", "y", "conf", **STEPS)


def confident(spark, sf):
    return frames(spark, sf).withColumn("conf", F.least(F.col("y") / 100, F.lit(1.0)))


@query("J05_kalman_gate")
def j05(spark, sf):
    return folds.kalman_accepted(confident(spark, sf), "seg", motion=Motion(gate=2.0))


@query("J05_kalman_fill")
def j05_fill(spark, sf):
    rows = confident(spark, sf).where("label <> 'error'")
    return folds.fill_path(rows, "seg", how="kalman", motion=Motion(gate=2.0)).withColumns({c: r4(c) for c in ("x", "y")})


@query("J08_two_player_tracks")
def j08(spark, sf):
    rows = frames(spark, sf).select("seg", F.floor(F.col("frame") / 3).alias("frame"), "y", F.col("x").cast("double").alias("x"), (F.col("x") / 100).alias("court"), (F.col("x") % 10).alias("size"))
    anchors = stats.static_cells(rows, "x", "y", "seg", 10, 0.7, 2.9)
    return folds.two_player_tracks(rows, "seg", anchors=anchors, radius=2.0, reach=25.0)


@query("J03_blobs")
def j03(spark, sf):
    rows = frames(spark, sf).groupBy((F.col("seg") % 10).alias("g"), F.floor("y").alias("x"), F.floor("x").alias("y")).agg(F.count("*").cast("double").alias("v"))
    return folds.blobs(rows, ["g"], least=2).withColumns({"cx": r4("cx"), "cy": r4("cy")})


@query(
    "G01_longest_segments",
    f"with {LOW_RUNS} select seg, start_frame, n_frames from (select *, row_number() over (order by n_frames desc, seg, start_frame) i from runs) where i <= 20",
)
def g01(spark, sf):
    return low_runs(spark, sf).select("seg", "start_frame", "n_frames").orderBy(F.desc("n_frames"), "seg", "start_frame").limit(20)


@query("G02_top_candidates", f"with {FRAMES} select seg, frame, y from (select *, row_number() over (partition by seg order by y desc, frame) i from fr) where i <= 8")
def g02(spark, sf):
    return stats.top_k(frames(spark, sf), ["seg"], [F.desc("y"), F.col("frame")], 8).select("seg", "frame", "y")


@query(
    "G04_best_run",
    f"with {LOW_RUNS} select seg, start_frame, n_frames from (select *, row_number() over (partition by seg order by n_frames desc, start_frame) i from runs) where i = 1",
)
def g04(spark, sf):
    best = F.max_by(F.struct("start_frame", "n_frames"), F.struct(F.col("n_frames"), -F.col("start_frame")))
    return low_runs(spark, sf).groupBy("seg").agg(best.alias("b")).select("seg", "b.*")
