"""Queries over court geometry. Their scenes are made from events: each is a segment on one of the court's lines, seen in a view of its user's (or group's) own, or a stray one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import court
from .registry import FRAMES, frames, query, r4

WIDTH, HEIGHT = 1280, 720
#: A scene's view: h in w = 1.6 - 0.045 y + h x, and the middle of the picture; by key.
H, G, W0, P, Q = 0.01, 0.045, 1.6, 256.0, 29.2

_LINE = f"[{', '.join(map(str, (*court.ACROSS, *court.DOWN)))}]"
SCENE = f"""{FRAMES}, cl as (select *, event_id % 12 i, ({_LINE})[event_id % 12 + 1] pos, 640.0 + seg % 40 cx from fr),
ce as (select *, case when i < 5 then pos else x * 0.037 end ax, case when i < 5 then x * 0.05 else pos end ay, case when i < 5 then pos else x * 0.037 + 2.4 end bx, case when i < 5 then x * 0.05 + 8 else pos end by_ from cl),
cw as (select *, {W0} - {G} * ay + {H} * ax aw, {W0} - {G} * by_ + {H} * bx bw from ce),
sc as (select seg, event_id, frame, case when label = 'error' then x * 12.5 else round((150 * (ax - 3.05) + cx * aw) / aw + frame % 3 / 2.0, 2) end x1, case when label = 'error' then y * 2.0 else round(({P} + {Q} * ay) / aw + frame % 5 / 4.0, 2) end y1,
case when label = 'error' then x * 12.5 + frame + 20.0 else round((150 * (bx - 3.05) + cx * bw) / bw + frame % 7 / 8.0, 2) end x2, case when label = 'error' then y * 2.0 + x * 3.0 else round(({P} + {Q} * by_) / bw, 2) end y2 from cw)"""


def scene(spark, sf, users=1):
    """seg, event_id, frame, x1, y1, x2, y2; so many users make one scene."""
    rows = frames(spark, sf).withColumn("seg", F.floor(F.col("seg") / users) * users)
    rows = rows.withColumn("i", F.col("event_id") % 12).withColumn("cx", 640.0 + F.col("seg") % 40)
    at = F.element_at(F.array(*map(F.lit, (*court.ACROSS, *court.DOWN))), (F.col("i") + 1).cast("int"))
    steep, x, y, f = F.col("i") < 5, F.col("x"), F.col("y"), F.col("frame")
    ends = {"ax": F.when(steep, at).otherwise(x * 0.037), "ay": F.when(steep, x * 0.05).otherwise(at), "bx": F.when(steep, at).otherwise(x * 0.037 + 2.4), "by": F.when(steep, x * 0.05 + 8).otherwise(at)}
    rows = rows.withColumns(ends)
    deep = {n: W0 - G * F.col(f"{n}y") + H * F.col(f"{n}x") for n in "ab"}
    u = {n: (150 * (F.col(f"{n}x") - 3.05) + F.col("cx") * deep[n]) / deep[n] for n in "ab"}
    v = {n: (P + Q * F.col(f"{n}y")) / deep[n] for n in "ab"}
    stray = F.col("label") == "error"
    return rows.select(
        "seg", "event_id", "frame", F.when(stray, x * 12.5).otherwise(F.round(u["a"] + f % 3 / 2.0, 2)).alias("x1"), F.when(stray, y * 2.0).otherwise(F.round(v["a"] + f % 5 / 4.0, 2)).alias("y1"),
        F.when(stray, x * 12.5 + f + 20.0).otherwise(F.round(u["b"] + f % 7 / 8.0, 2)).alias("x2"), F.when(stray, y * 2.0 + x * 3.0).otherwise(F.round(v["b"], 2)).alias("y2"),
    )


def along(segments, key, n=24):
    """key, x, y: n points on each segment, in whole pixels."""
    t = F.explode(F.array(*(F.lit(i / (n - 1)) for i in range(n))))
    rows = segments.select(key, "x1", "y1", "x2", "y2", t.alias("t"))
    at = lambda a, z: F.rint(F.col(a) + (F.col(z) - F.col(a)) * F.col("t"))
    return rows.select(key, at("x1", "x2").alias("x"), at("y1", "y2").alias("y"))


@query(
    "J16_vanishing_point",
    f"""with {SCENE}, fa as (select *, abs(degrees(atan2(y2 - y1, x2 - x1))) an, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) len from sc),
li as (select *, case when an < 40 then 'shallow' when an > 40 and an < 140 then 'steep' end fam, (y2 - y1) / len a, -(x2 - x1) / len b, (x1 + x2) / 2 mx, (y1 + y2) / 2 my from fa where len > 0),
lc as (select *, -(a * x1 + b * y1) c, row_number() over (partition by seg, fam order by len desc, event_id) - 1 i from li where fam is not null),
ln as materialized (select * from lc), n as (select seg, fam, count(*) n from ln group by all having count(*) > 1),
dr as (select *, md5(concat_ws('/', seg, fam, round)) h from (select *, unnest(range(300)) round from n)),
pq as (select *, cast('0x' || h[1:8] as bigint) % n p, (cast('0x' || h[1:8] as bigint) % n + 1 + cast('0x' || h[9:16] as bigint) % (n - 1)) % n q from dr),
vp as materialized (select seg, fam, round, n, (pb * qc - qb * pc) / det vx, (pc * qa - qc * pa) / det vy from (
  select pq.*, k.a pa, k.b pb, k.c pc, m.a qa, m.b qb, m.c qc, k.a * m.b - m.a * k.b det from pq join ln k on k.seg = pq.seg and k.fam = pq.fam and k.i = p join ln m on m.seg = pq.seg and m.fam = pq.fam and m.i = q) where abs(det) >= 1e-9),
vo as (select vp.seg, vp.fam, round, n, vx, vy, round(sum(len), 3) weight, count(*) inliers from vp join ln using (seg, fam)
  where abs(a * vx + b * vy + c) / (sqrt((vx - mx) * (vx - mx) + (vy - my) * (vy - my)) + 1e-9) < 0.02 group by all)
select seg, fam family, round(vx, 1) vx, round(vy, 1) vy, round(weight, 1) weight, inliers, n from vo qualify row_number() over (partition by seg, fam order by weight desc, round) = 1""",
)
def j16(spark, sf):
    rows = court.family(court.lines(scene(spark, sf))).where("family is not null")
    found = court.vanishing_points(rows.select("seg", "family", "event_id", "x1", "y1", "x2", "y2"), ["seg", "family"], "event_id")
    return found.withColumns({c: F.round(c, 1) for c in ("vx", "vy", "weight")})


@query(
    "E19_quad_overlap",
    f"""with {FRAMES}, q as (select seg, min(x) x0, max(x) x1, trunc(min(y) * 2) y0, trunc(max(y) * 2) y1, trunc(avg(x)) ax from fr group by seg),
c as (select seg, unnest([0, 1, 2, 3]) e, [[trunc(x0 * 3), y0], [trunc(x1 * 4), y0 + 9], [trunc(x1 * 3), y1], [trunc(ax), y1 - 5]] c from q),
ed as (select seg, c[e + 1][1] xa, c[e + 1][2] ya, c[(e + 1) % 4 + 1][1] xb, c[(e + 1) % 4 + 1][2] yb from c),
rw as (select seg, unnest(range(cast(greatest(0, least(y0, y0 + 9, y1, y1 - 5)) as bigint), cast(least(479, greatest(y0 + 9, y1)) as bigint) + 1)) r from q),
sp as (select seg, r, greatest(0, floor(min(case when ya = yb then xa else xa + (xb - xa) * (r - ya) / (yb - ya) end) + 0.5)) a, least(359, floor(max(case when ya = yb then xa else xa + (xb - xa) * (r - ya) / (yb - ya) end) + 0.5)) z
  from rw join ed using (seg) where r between least(ya, yb) and greatest(ya, yb) group by seg, r),
mk as (select seg, cast(floor(y * 2) as bigint) r, min(x) * 2 f, max(x) * 4 l from fr where label <> 'error' group by all),
ar as (select seg, sum(greatest(0, z - a + 1)) area from sp group by seg), bo as (select seg, sum(greatest(0, least(z, l) - greatest(a, f) + 1)) b from sp join mk using (seg, r) group by seg)
select seg, round(case when area >= 100 then coalesce(b, 0) / area else 0 end, 6) overlap from ar left join bo using (seg)""",
)
def e19(spark, sf):
    rows = frames(spark, sf)
    box = rows.groupBy("seg").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.floor(F.min("y") * 2).alias("y0"), F.floor(F.max("y") * 2).alias("y1"), F.floor(F.avg("x")).alias("ax"))
    quads = box.select("seg", F.array(*(F.array(x.cast("double"), y.cast("double")) for x, y in ((F.col("x0") * 3, F.col("y0")), (F.col("x1") * 4, F.col("y0") + 9), (F.col("x1") * 3, F.col("y1")), (F.col("ax"), F.col("y1") - 5)))).alias("corners"))
    mask = rows.where("label <> 'error'").groupBy("seg", F.floor(F.col("y") * 2).alias("row")).agg((F.min("x") * 2).alias("first"), (F.max("x") * 4).alias("last"))
    found = court.quad_overlap(quads, mask, ["seg"], "seg", 360, 480)
    return found.withColumn("overlap", F.round("overlap", 6))


def first_guess(rows, key):
    """A view some ten pixels beside each scene's own: key, view."""
    shift = (F.col(key) % 40).cast("double")
    corners = [[345.0, 166.0], [908.0, 149.0], [190.0, 640.0], [1080.0, 621.0]]
    return rows.select(key).distinct().select(key, court.view_of(F.array(*(F.array(F.lit(x) + shift, F.lit(y)) for x, y in corners))).alias("view"))


@query("J17_fitted_views")
def j17(spark, sf):
    rows = scene(spark, sf)
    found = court.fit_views(along(rows, "seg"), first_guess(rows, "seg"), ["seg"], "seg")
    found = found.withColumn("c", court.corners_of(F.col("view")))
    return found.select("seg", "near", *(F.round(F.get(F.get("c", F.lit(i)), F.lit(k)), 2).alias(f"{n}{'xy'[k]}") for i, n in enumerate(("tl", "tr", "bl", "br")) for k in range(2)))


@query("J18_court_proposals")
def j18(spark, sf):
    rows = scene(spark, sf, 10)
    mask = rows.select("seg").distinct().select("seg", F.explode(F.sequence(F.lit(180), F.lit(660))).alias("row")).withColumns({"first": F.lit(200), "last": F.lit(1100)})
    found = court.detect_court(rows, along(rows, "seg"), "seg", "event_id", WIDTH, HEIGHT, mask)
    found = found.withColumn("c", court.corners_of(F.col("view")))
    corners = (F.round(F.get(F.get("c", F.lit(i)), F.lit(k)), 2).alias(f"{n}{'xy'[k]}") for i, n in enumerate(("tl", "tr", "bl", "br")) for k in range(2))
    return found.select("seg", "name", *(r4(c).alias(c) for c in ("score", "coverage", "inliers")), "refined", *corners)
