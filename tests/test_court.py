"""Court geometry on scenes whose views are known, and quads against pixels looked at one by one."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import court
from seriesloom.plans import court_queries as q
from seriesloom.plans.catalog import SQL

SF = "/root/testdata/sf0.001"
VIEW = np.array([[118.0, -9.0, 300.0], [4.0, 31.0, 190.0], [0.004, -0.021, 1.0]])


def image(view, x, y):
    u, v, w = view @ [x, y, 1.0]
    return u / w, v / w


def test_a_planted_vanishing_point_is_found(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        (x1, y1), (x2, y2) = rng.uniform(0, 1000, 2), rng.uniform(0, 1000, 2)
        if i % 4:  # towards (700, -300)
            t = rng.uniform(0.2, 0.5)
            x2, y2 = x1 + t * (700 - x1), y1 + t * (-300 - y1)
        rows.append((1, i, *map(float, (x1, y1, x2, y2))))
    rows += [(2, 0, 0.0, 0.0, 5.0, 5.0), (3, 0, 0.0, 0.0, 9.0, 0.0), (3, 1, 0.0, 4.0, 9.0, 4.0), (4, 0, 1.0, 1.0, 1.0, 1.0), (4, 1, 0.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "k long, i long, x1 double, y1 double, x2 double, y2 double")
    found = court.vanishing_points(df, ["k"], "i")
    (got,) = found.collect()  # one line, parallel lines and a line without length have none
    assert got.k == 1 and math.hypot(got.vx - 700, got.vy + 300) < 1e-6 and got.n == 40 and got.inliers >= 30
    held = {(r.k, r.i) for r in court.on_points(df, found, ["k"]).collect()}
    assert {(1, i) for i in range(40) if i % 4} <= held and (2, 0) in held and (4, 0) not in held


def test_hypotheses_are_not_joined(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0, 5.0), (1, 1, 9.0, 0.0, 5.0, 6.0), (None, 0, 0.0, 0.0, 5.0, 5.0), (None, 1, 9.0, 0.0, 5.0, 6.0)], "k long, i long, x1 double, y1 double, x2 double, y2 double")
    found = court.vanishing_points(df, ["k"], "i")
    assert not multiplied(found._jdf.queryExecution().optimizedPlan())
    assert [(r.k, r.n) for r in found.collect()] == [(1, 2)]


def made_lines(rng, n, strays, key=1):
    """So many lines towards (700, -300), and longer ones that go anywhere."""
    rows = []
    for i in range(n + strays):
        (x1, y1), t = rng.uniform(0, 1000, 2), rng.uniform(0.2, 0.5)
        x2, y2 = (x1 + t * (700 - x1), y1 + t * (-300 - y1)) if i < n else rng.uniform(2000, 4000, 2)
        rows.append((key, i, *map(float, (x1, y1, x2, y2))))
    return rows


LINES = "k long, i long, x1 double, y1 double, x2 double, y2 double"


def test_all_lines_of_a_key_vote(spark):
    """The lines that meet are shorter than 190 strays."""
    rows = made_lines(np.random.default_rng(4), 900, 190)
    (got,) = court.vanishing_points(spark.createDataFrame(rows, LINES), ["k"], "i").collect()
    assert math.hypot(got.vx - 700, got.vy + 300) < 1e-6 and got.n == 1090 and got.inliers >= 900


def test_keys_in_pieces_have_the_points_of_whole_ones(spark):
    rng = np.random.default_rng(6)
    rows = made_lines(rng, 700, 100) + made_lines(rng, 300, 300, 2) + made_lines(rng, 40, 10, 3) + [(4, i, 0.0, float(i), 9.0, float(i)) for i in range(80)]
    rows += [(5, i, *r[2:]) for i, r in enumerate(rows[:60] * 2)]  # equal lengths
    df = spark.createDataFrame(rows, LINES).withColumn("side", F.when(F.col("i") % 3 == 0, "a").otherwise("b")).repartition(7)
    for keys in (["k"], ["k", "side"]):
        a, b = ({(r.k, *r[1 : len(keys)]): r for r in court.vanishing_points(df, keys, "i", piece=p).collect()} for p in (1 << 16, 60))
        assert a.keys() == b.keys() and {k for k, *_ in a} == {1, 2, 3, 5}
        for at, r in a.items():
            assert (b[at].n, b[at].inliers, b[at].vx, b[at].vy, b[at].weight) == pytest.approx((r.n, r.inliers, r.vx, r.vy, r.weight), rel=1e-12)


def test_vanishing_points_of_many_lines_are_those_of_the_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"copy (select * replace (user_id % 2 as user_id) from '{SF}/events.parquet') to '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.sql(SQL["J16_vanishing_point"])
    want = {r[:2]: r[2:] for r in want.select("seg, family, vx, vy, weight, inliers, n").fetchall()}
    got = {(r.seg, r.family): (r.vx, r.vy, r.weight, r.inliers, r.n) for r in q.j16(spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 4 and all(r[4] > 180 for r in got.values())


def test_vanishing_points_of_the_table_are_the_views(spark):
    """Steep lines meet where w is 0 in the direction down the court."""
    got = {r.seg: r for r in q.j16(spark, SF).where("family = 'steep'").collect()}
    near = [abs(r.vx - 640 - seg % 40) < 15 and abs(r.vy + q.Q / q.G) < 40 for seg, r in got.items()]
    assert len(near) == 15 and sum(near) >= 13


def covered(quad, width, height):
    """Pixels whose unit of width meets the quad at their height, by half-planes."""
    out = set()
    quad = [(math.trunc(x), math.trunc(y)) for x, y in quad]
    for y in range(height):
        lo, hi, ok = -1e9, 1e9, min(p[1] for p in quad) <= y <= max(p[1] for p in quad)
        for (x1, y1), (x2, y2) in zip(quad, quad[1:] + quad[:1], strict=True):
            # clockwise in the image: inside is where the cross product is not negative
            a, b = -(y2 - y1), (x2 - x1) * (y - y1) + (y2 - y1) * x1
            if a > 0:
                lo = max(lo, -b / a)
            elif a < 0:
                hi = min(hi, -b / a)
        if ok:
            out |= {(x, y) for x in range(width) if lo <= x + 0.5 and x - 0.5 < hi or lo <= x <= hi}
    return out


def test_quads_over_masks(spark):
    rng = np.random.default_rng(7)
    quads, masks, want = [], [], {}
    for k in range(12):
        x0, y0 = rng.uniform(-10, 40, 2)
        quad = [(x0, y0), (x0 + rng.uniform(20, 60), y0 + rng.uniform(-4, 4)), (x0 + rng.uniform(30, 70), y0 + rng.uniform(30, 50)), (x0 + rng.uniform(-5, 5), y0 + rng.uniform(28, 45))]
        quads.append((k, [list(map(float, p)) for p in quad]))
        mask = {}
        for row in range(0, 80, 1 + k % 3):
            a = int(rng.integers(0, 60))
            mask[row] = [(a, a + 9), (a + 12, a + 20 + k)]
            masks += [(k, row, f, l) for f, l in mask[row]]
        pixels = covered(quad, 90, 80)
        inside = sum(any(f <= x <= l for f, l in mask.get(y, [])) for x, y in pixels)
        want[k] = inside / len(pixels) if len(pixels) >= 100 else 0.0
    quads += [(50, [[1.0, 1.0], [4.0, 1.0], [4.0, 4.0], [1.0, 4.0]]), (51, [[500.0, 500.0]] * 4)]
    masks += [(50, r, 0, 80) for r in range(80)]
    df = spark.createDataFrame(quads, "k long, corners array<array<double>>")
    got = {r.k: r.overlap for r in court.quad_overlap(df, spark.createDataFrame(masks, "k long, row long, first long, last long"), ["k"], "k", 90, 80).collect()}
    assert got.pop(50) == got.pop(51) == 0.0
    assert got == pytest.approx(want, abs=0.004)


def multiplied(node, joined=False):
    """Whether a plan joins rows that were multiplied out and not yet added up."""
    joined = node.nodeName() == "Join" or joined and node.nodeName() != "Aggregate"
    if joined and node.nodeName() == "Generate":
        return True
    return any(multiplied(node.children().apply(i), joined) for i in range(node.children().size()))


def test_scanlines_are_added_up_before_a_join(spark):
    """Spark takes a table to stay as small as it was when its rows are multiplied, and would broadcast them."""
    quads = spark.createDataFrame([(1, [[0.0, 0.0], [40.0, 0.0], [40.0, 60.0], [0.0, 60.0]])], "k long, corners array<array<double>>")
    found = court.quad_overlap(quads, spark.createDataFrame([(1, 5, 0, 19)], "k long, row long, first long, last long"), ["k"], "k", 90, 80)
    assert not multiplied(found._jdf.queryExecution().optimizedPlan())
    assert found.collect()[0].overlap == 20 / (41 * 61)


def made_points(rng, view, n=900, strays=150):
    out = []
    for _ in range(n):
        i, t = rng.integers(12), rng.uniform()
        x, y = (court.ACROSS[i], t * 13.41) if i < 5 else (t * 6.1, court.DOWN[i - 5])
        u, v = image(view, x, y)
        out.append((u + rng.normal(0, 0.7), v + rng.normal(0, 0.7)))
    return [tuple(map(float, p)) for p in out + [tuple(rng.uniform(0, 900, 2)) for _ in range(strays)]]


def test_a_view_is_recovered_from_noisy_points(spark):
    rng = np.random.default_rng(3)
    shift = VIEW.copy()
    shift[0, 2] += 9
    shift[1, 2] -= 7
    shift[0, 0] *= 1.01
    points = [(1, *p) for p in made_points(rng, VIEW)] + [(2, *p) for p in made_points(rng, VIEW, 8, 0)] + [(None, 1.0, 1.0)]
    views = [(1, shift.ravel().tolist()), (2, shift.ravel().tolist()), (3, VIEW.ravel().tolist())]
    df = spark.createDataFrame(points, "k long, x double, y double").repartition(5)
    got = {r.k: r for r in court.fit_views(df, spark.createDataFrame(views, "k long, view array<double>"), ["k"], "k").collect()}
    found = np.array(got[1].view).reshape(3, 3)
    ends = [(x, y) for x in (0, 6.1) for y in (0, 13.41)]
    before = max(math.dist(image(shift, *p), image(VIEW, *p)) for p in ends)
    assert before > 20 and max(math.dist(image(found, *p), image(VIEW, *p)) for p in ends) < 2.0
    assert got[1].near >= 800
    assert got[2].view == views[1][1] and got[3].view == views[2][1]  # under 12 points a view stays


def test_large_keys_are_fitted_as_small_ones(spark):
    rng = np.random.default_rng(5)
    shift = VIEW + np.array([[0, 0, 9.0], [0, 0, -7.0], [0, 0, 0]])
    points = [(1, *p) for p in made_points(rng, VIEW)] + [(2, *p) for p in made_points(rng, VIEW, 200, 20)] + [(2, None, 1.0)]
    views = spark.createDataFrame([(k, n, shift.ravel().tolist()) for k in (1, 2, 3) for n in "ab"], "k long, n string, view array<double>")
    df = spark.createDataFrame(points, "k long, x double, y double").repartition(3)
    a, b = ({(r.k, r.n): r for r in court.fit_views(df, views, ["k", "n"], "k", most=m).collect()} for m in (1 << 16, 300))
    assert len(a) == len(b) == 6
    for at, r in a.items():
        assert b[at].near == r.near and b[at].view == pytest.approx(r.view, rel=1e-6, abs=1e-9)
    assert a[3, "a"].near == 0
    found = np.array(a[1, "a"].view).reshape(3, 3)
    assert max(math.dist(image(found, x, y), image(VIEW, x, y)) for x in (0, 6.1) for y in (0, 13.41)) < 1


def test_fitted_views_of_the_table(spark):
    """The scenes' views were made by hand, so their corners are known."""
    off = []
    for r in q.j17(spark, SF).collect():
        for name, (x, y) in {"tl": (0, 0), "tr": (6.1, 0), "bl": (0, 13.41), "br": (6.1, 13.41)}.items():
            w = q.W0 - q.G * y + q.H * x
            want = (150 * (x - 3.05) / w + 640 + r.seg % 40, (q.P + q.Q * y) / w)
            off.append(math.dist((r[f"{name}x"], r[f"{name}y"]), want))
    assert len(off) == 60 and np.mean(off) < 3 and max(off) < 8  # a fifth of the segments are strays


def test_coverage_is_that_of_single_samples(spark):
    """Against every sample looked up by itself; and samples are not made as rows."""
    rng = np.random.default_rng(2)
    points = [(1, *p) for p in made_points(rng, VIEW, 1500, 50)] + [(1, 0.0, 0.0), (1, 5000.0, 3.0), (2, 100.0, 100.0)]
    shift = VIEW + np.array([[0, 0, 25.0], [0, 0, 0], [0, 0, 0]])
    views = [(1, "a", VIEW), (1, "b", shift), (1, "c", VIEW + [[0, 0, 5000.0], [0, 0, 0], [0, 0, 0]]), (2, "a", VIEW), (3, "a", VIEW)]
    df = spark.createDataFrame([(k, n, v.ravel().tolist()) for k, n, v in views], "k long, n string, view array<double>")
    found = court.coverage(df, court.supported(spark.createDataFrame(points, "k long, x double, y double"), "k", 640, 480), ["k", "n"], "k", 640, 480)
    assert not multiplied(found._jdf.queryExecution().optimizedPlan()) and "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.k, r.n): r.coverage for r in found.collect()}
    for k, n, v in views:
        near = {(int(np.rint(x)), int(np.rint(y))) for key, x, y in points if key == k}
        shares = []
        for i, line in enumerate((*court.ACROSS, *court.DOWN)):
            at = [image(v, line, 13.41 * s / 79) if i < 5 else image(v, 6.1 * s / 79, line) for s in range(80)]
            at = [(int(np.rint(x)), int(np.rint(y))) for x, y in at]
            at = [p for p in at if 0 <= p[0] < 640 and 0 <= p[1] < 480]
            hit = sum(any((x - a) ** 2 + (y - b) ** 2 < 16 for a, b in near) for x, y in at)
            shares.append(hit / len(at) if len(at) >= 32 else 0.0)
        assert got[k, n] == pytest.approx(sum(shares) / 12 * sum(c > 0.3 for c in shares) / 12)
    assert got[1, "a"] > got[1, "b"] > got[1, "c"] == 0


def test_the_court_is_found_among_the_lines(spark):
    got = q.j18(spark, SF).collect()
    assert sorted(r.seg for r in got) == [0, 10]
    for r in got:
        assert r.coverage > 0.85 and r.inliers > 0.75
        for name, (x, y) in {"tl": (0, 0), "tr": (6.1, 0), "bl": (0, 13.41), "br": (6.1, 13.41)}.items():
            w = q.W0 - q.G * y + q.H * x
            assert math.dist((r[f"{name}x"], r[f"{name}y"]), (150 * (x - 3.05) / w + 640 + r.seg % 40, (q.P + q.Q * y) / w)) < 2


def test_views_take_the_corners_where_they_belong(spark):
    corners = [[340.0, 178.0], [900.0, 150.0], [188.0, 660.0], [1100.0, 655.0]]
    df = spark.createDataFrame([(corners,), ([[1.0, 1.0]] * 4,)], "c array<array<double>>").select(court.view_of(F.col("c")).alias("view"))
    good, bad = (r.view for r in df.collect())
    assert bad is None
    for (x, y), want in zip([(0, 0), (6.1, 0), (0, 13.41), (6.1, 13.41)], corners, strict=True):
        assert image(np.array(good).reshape(3, 3), x, y) == pytest.approx(want)
    assert court.valid_views(df, 1280, 720).count() == 1 and court.valid_views(df, 500, 720).count() == 0


def test_all_pairs_of_lines_are_proposed(spark):
    steep = [(1, "steep", i, 1.0, 0.0, -40.0 * i) for i in range(1, 14)]
    shallow = [(1, "shallow", i, 0.0, -1.0, 30.0 * i) for i in range(1, 15)]
    got = court.proposals(spark.createDataFrame(steep + shallow, "k long, family string, i int, a double, b double, c double"), "k").collect()
    ends = {(tuple(r.corners[0]), tuple(r.corners[3])) for r in got}
    assert len(got) == len({r.name for r in got}) == len(ends) == 13 * 12 // 2 * (14 * 13 // 2)
    assert [r.corners for r in got if r.name == "lines-01-13-01-14"] == [[[40.0, 30.0], [520.0, 30.0], [40.0, 420.0], [520.0, 420.0]]]


def test_lines_near_each_other_are_one(spark):
    """Against places put in order one by one; some are a distance apart exactly, and some on a bin's edge."""
    rng = np.random.default_rng(8)
    places = {1: sorted(rng.uniform(-300, 2000, 120)), 2: [0.0, 14.0, 27.5, 28.0, 41.5, 56.0, 69.0, 300.0], 3: [5.0] * 300 + [7.0, 21.0]}
    rows = [(k, "steep", x, -2.0, x, 2.0) for k, v in places.items() for x in map(float, v)] + [(k, "shallow", -5.0, 0.0, 5.0, 0.0) for k in places] + [(1, "steep", float("inf"), 0.0, 3.0, 9.0)]
    df = court.lines(spark.createDataFrame(rows, "k long, family string, x1 double, y1 double, x2 double, y2 double"))
    got = {(r.k, r.i): -r.c / r.a for r in court.physical_lines(df, "k").where("family = 'steep'").collect()}
    want = {}
    for k, v in places.items():
        groups = [[v[0]]]
        for a, b in zip(v, v[1:]):
            groups.append([b]) if b - a >= 14 else groups[-1].append(b)
        want |= {(k, i): sum(g) / len(g) for i, g in enumerate(groups, 1)}
    assert got == pytest.approx(want)


def test_coverage_of_views_in_pieces(spark):
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(k, *p) for k in (1, 2) for p in made_points(rng, VIEW, 400, 50)], "k long, x double, y double")
    views = [(k, n, (VIEW + [[0, 0, 3.0 * n], [0, 0, 0], [0, 0, 0]]).ravel().tolist()) for k, m in ((1, 40), (2, 3), (3, 9)) for n in range(m)]
    df = spark.createDataFrame(views, "k long, n long, view array<double>")
    near = court.supported(points, "k", 640, 480)
    a, b = ({(r.k, r.n): r.coverage for r in court.coverage(df, near, ["k", "n"], "k", 640, 480, piece=p).collect()} for p in (1 << 13, 4))
    assert a == b and len(a) == 52 and a[1, 0] > 0


def test_short_lines_of_the_court_are_not_dropped(spark):
    """The 240 longest segments are on inner lines; the outer ones have short segments only."""
    rng = np.random.default_rng(10)
    rows = []
    for n in range(960):
        i = int(rng.choice([1, 2, 3, 7, 8, 9])) if n < 240 else n % 12
        lo, hi = (0.15, 0.95) if n < 240 else (t := rng.uniform(0, 0.9), t + 0.1)
        at = [(court.ACROSS[i], t * 13.41) if i < 5 else (t * 6.1, court.DOWN[i - 5]) for t in (lo, hi)]
        ends = [image(VIEW, *p) for p in at]
        rows.append((1, n, *(float(v) for p in ends for v in p)))
    df = spark.createDataFrame(rows, LINES)
    (got,) = court.detect_court(df, q.along(df, "k"), "k", "i", 1280, 1000).collect()
    found = np.array(got.view).reshape(3, 3)
    assert max(math.dist(image(found, x, y), image(VIEW, x, y)) for x in (0, 6.1) for y in (0, 13.41)) < 2 and got.coverage > 0.9
