"""Paths, smoothed fills, trackers and labels over a table's keys, against statements of them that share no code."""

import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.operators import folds, kernels, smoothing, stats
from seriesloom.plans import further_queries, more_queries, run_queries
from seriesloom.plans.registry import frames

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(spark):
    by = defaultdict(list)
    for r in sorted(frames(spark, SF).collect(), key=lambda r: (r.seg, r.frame)):
        by[r.seg].append(r)
    return by


def best_path(nodes, speed=120.0, slack=40.0, usual=25.0):
    """The best path by trying every step: places."""
    best, back = [], []
    for j, b in enumerate(nodes):
        options = [(0.0, -1)]
        for i, a in enumerate(nodes[:j]):
            dt, d = b[0] - a[0], math.dist(a[1:3], b[1:3])
            if 0 < dt <= 15 and d <= speed * dt + slack:
                options.append((best[i] - (d / dt / usual) ** 2 - 0.8 * (dt - 1), i))
        top = max(v for v, _ in options)
        best.append(6 + 8 * b[3] + top)
        back.append(next(i for v, i in options if v == top))
    path, j = [], best.index(max(best))
    while j >= 0:
        path.append(j)
        j = back[j]
    return path[::-1]


def test_viterbi_over_the_table(spark, series):
    got = defaultdict(list)
    for r in run_queries.j01(spark, SF).collect():
        got[r.seg].append(r.frame)
    for seg, rows in series.items():
        nodes = [(r.frame, r.x, r.y, min(r.y / 100, 1.0)) for r in rows]
        assert sorted(got[seg]) == [nodes[i][0] for i in best_path(nodes, **run_queries.STEPS)]


def test_tracks_over_the_table(spark, series):
    """The path, near confident points only, and lines over gaps of up to ten frames within it."""
    got = {(r.seg, r.frame): r for r in more_queries.j02(spark, SF).collect()}
    for seg, rows in series.items():
        nodes = [(r.frame, r.x, r.y, min(r.y / 100, 1.0)) for r in rows if r.label != "error"]
        path = [nodes[i] for i in best_path(nodes)]
        kept = {n[0]: n for n in path if any(m[3] >= 0.8 and abs(m[0] - n[0]) <= 8 for m in path)}
        for r in rows:
            g = got[seg, r.frame]
            if r.frame in kept:
                assert g.visible and (g.x, g.y) == pytest.approx(kept[r.frame][1:3], abs=1e-4) and g.conf == pytest.approx(kept[r.frame][3], abs=1e-4)
                continue
            a, z = max((f for f in kept if f < r.frame), default=None), min((f for f in kept if f > r.frame), default=None)
            if a is None or z is None or z - a - 1 > 10:
                assert not g.visible and g.x is None and g.y is None
            else:
                w = (r.frame - a) / (z - a)
                assert g.visible and g.conf == 0
                assert (g.x, g.y) == pytest.approx(tuple(p + w * (q - p) for p, q in zip(kept[a][1:3], kept[z][1:3], strict=True)), abs=2e-4)


class Flight:
    """One coordinate as a Gaussian in its start, its speed and the push of each frame: estimates are weighted least squares."""

    def __init__(self, n, start):
        self.n, self.rows, self.values = n, [], []
        self.see(self.place(0), start, 5.0)
        self.see(np.eye(n + 1)[1], 0.0, 20.0)
        for s in range(n - 1):
            self.see(np.eye(n + 1)[2 + s], 0.0, 6.0)

    def place(self, t):
        row = np.zeros(self.n + 1)
        row[0], row[1] = 1, t
        row[2 : 2 + t] = t - np.arange(t) - 0.5
        return row

    def see(self, row, value, deviation):
        self.rows.append(row / deviation)
        self.values.append(value / deviation)

    def estimate(self):
        a = np.array(self.rows)
        return np.linalg.lstsq(a, np.array(self.values), rcond=None)[0], np.linalg.inv(a.T @ a)


def posterior(points, gate):
    """points (frame, x, y, conf): which are believed, and the mean of every frame's place."""
    first, n = points[0][0], points[-1][0] - points[0][0] + 1
    xs, ys = Flight(n, points[0][1]), Flight(n, points[0][2])
    believed = []
    for f, x, y, c in points:
        row = xs.place(f - first)
        (ux, cov), (uy, _) = xs.estimate(), ys.estimate()
        noise = 4.0 / max(c, 0.15)
        spread = row @ cov @ row + noise**2
        ok = ((x - row @ ux) ** 2 + (y - row @ uy) ** 2) / spread <= gate**2
        believed.append(bool(ok))
        if ok:
            xs.see(row, x, noise)
            ys.see(row, y, noise)
    places = np.array([xs.place(t) for t in range(n)])
    return believed, places @ xs.estimate()[0], places @ ys.estimate()[0]


def test_the_gate_over_the_table(spark, series):
    got = {(r.seg, r.frame): r.accepted for r in run_queries.j05(spark, SF).collect()}
    for seg in list(series)[:5]:
        points = [(r.frame, r.x, r.y, min(r.y / 100, 1.0)) for r in series[seg]]
        assert [got[seg, p[0]] for p in points] == posterior(points, 2.0)[0]
    assert 0.1 < np.mean(list(got.values())) < 0.95


def test_smoothed_fills_over_the_table(spark, series):
    got = defaultdict(dict)
    for r in run_queries.j05_fill(spark, SF).collect():
        got[r.seg][r.frame] = (r.x, r.y)
    assert set(got) == set(series)
    for seg in list(series)[:5]:
        points = [(r.frame, r.x, r.y, min(r.y / 100, 1.0)) for r in series[seg] if r.label != "error"]
        believed, x, y = posterior(points, 2.0)
        exact = {p[0]: p[1:3] for p, ok in zip(points, believed, strict=True) if ok}
        assert sorted(got[seg]) == list(range(points[0][0], points[-1][0] + 1))
        for t, f in enumerate(sorted(got[seg])):
            assert got[seg][f] == pytest.approx(exact.get(f, (x[t], y[t])), abs=1e-3)


def cox_de_boor(knots, i, degree, x):
    if degree == 0:
        inside = knots[i] <= x < knots[i + 1] or (x == knots[-1] and knots[i] < knots[i + 1] == knots[-1])
        return 1.0 if inside else 0.0
    out = 0.0
    for j, sign in ((i, 1), (i + 1, -1)):
        width = knots[j + degree] - knots[j]
        if width > 0:
            share = (x - knots[i]) / width if sign == 1 else (knots[i + degree + 1] - x) / width
            out += share * cox_de_boor(knots, j, degree - 1, x)
    return out


def third(knots, i, x):
    """The third derivative of a cubic B-spline within an interval, by its differences, which are exact for cubics."""
    right = min(k for k in knots if k > x)
    left = max(k for k in knots if k <= x)
    h = (right - left) / 4
    at = [cox_de_boor(knots, i, 3, left + h * (0.5 + j)) for j in range(4)]
    return (at[3] - 3 * at[2] + 3 * at[1] - at[0]) / h**3


def dense_spline(knots, x, y, w, bound, at):
    """The same least jumps for the same sum of residuals, by a dense solve: values at `at`."""
    n = len(knots) - 4
    b = np.array([[cox_de_boor(knots, i, 3, v) for i in range(n)] for v in x])
    inner = [k for k in knots[4:-4]]
    unique = sorted(set(knots))
    jumps = np.array([[third(knots, i, k) - third(knots, i, max(u for u in unique if u < k)) for i in range(n)] for k in inner]).reshape(-1, n)
    lo, hi = -12.0, 12.0
    for _ in range(80):
        p = 10 ** ((lo + hi) / 2)
        rows = np.concatenate([np.sqrt(p) * w[:, None] * b, jumps])
        c = np.linalg.lstsq(rows, np.concatenate([np.sqrt(p) * w * y, np.zeros(len(jumps))]), rcond=None)[0]
        total = ((w * (b @ c - y)) ** 2).sum()
        if not inner:
            break
        lo, hi = ((lo + hi) / 2, hi) if total > bound else (lo, (lo + hi) / 2)
    return np.array([[cox_de_boor(knots, i, 3, v) for i in range(n)] for v in at]) @ c, total


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.02, 0.3, 4.0, 400.0]))
def test_splines_are_those_of_a_dense_solve(seed, slack):
    rng = np.random.default_rng(seed)
    x = np.sort(rng.choice(80, 40, replace=False)).astype(float)
    y = 20 * np.sin(x / 7) + rng.normal(0, 1, 40)
    w = rng.uniform(0.15, 1, 40)
    knots, c = smoothing.knotted(x, y, w, slack * 40)
    total = float(((w * (smoothing.spline_at(knots, c, x) - y)) ** 2).sum())
    assert total <= slack * 40 * 1.001
    want, _ = dense_spline(knots.tolist(), x, y, w, slack * 40, x)
    assert np.abs(smoothing.spline_at(knots, c, x) - want).max() < 0.05
    if len(knots) > 8:  # a cubic would not do, so the bound is used up
        assert total >= slack * 40 * 0.99


def test_a_cubic_needs_no_knots():
    x = np.arange(12.0)
    knots, c = smoothing.knotted(x, 0.1 * x**3 - x, np.ones(12), 1e-6)
    assert len(knots) == 8 and smoothing.spline_at(knots, c, np.array([2.5])) == pytest.approx([0.1 * 2.5**3 - 2.5], abs=1e-6)


def test_spline_fills_over_the_table(spark, series):
    got = defaultdict(dict)
    for r in further_queries.j06(spark, SF).collect():
        got[r.seg][r.frame] = (r.x, r.y)
    for seg in list(series)[:3]:
        points = [(r.frame, r.x, r.y, min(r.y / 100, 1.0)) for r in series[seg] if r.label != "error"]
        f, x, y, conf = (np.array(v, dtype=float) for v in zip(*points, strict=True))
        w = np.maximum(conf, 0.15)
        believed, *_ = posterior(points, 6.0)
        span = np.arange(f[0], f[-1] + 1)
        exact = {p[0]: p[1:3] for p, ok in zip(points, believed, strict=True) if ok}
        want = []
        for v in (x, y):
            knots, _ = smoothing.knotted(f, v, w, 9.0 * len(f))
            want.append(dense_spline(knots.tolist(), f, v, w, 9.0 * len(f), span)[0])
        for t, frame in enumerate(span.astype(int).tolist()):
            assert got[seg][frame] == pytest.approx(exact.get(frame, (want[0][t], want[1][t])), abs=0.1)


def test_piecewise_fills_over_the_table(spark, series):
    """Between turns of the smoothed height, gaps lie on quadratics that what they miss by much hardly moves."""
    got = defaultdict(dict)
    for r in further_queries.j07(spark, SF).collect():
        got[r.seg][r.frame] = (r.x, r.y)
    quadratics = 0
    for seg in list(series)[:5]:
        points = [(r.frame, r.x, r.y, min(r.y / 100, 1.0)) for r in series[seg] if r.label != "error"]
        believed, *path = posterior(points, 6.0)
        first, seen = points[0][0], {p[0]: p for p in points}
        level = path[1]
        turns = {0, len(level) - 1}
        for sign in (1, -1):
            v = sign * level
            for t in range(1, len(v) - 1):
                if v[t - 1] < v[t] > v[t + 1]:
                    left = next((s for s in range(t, -1, -1) if v[s] > v[t]), -1)
                    right = next((s for s in range(t, len(v)) if v[s] > v[t]), len(v))
                    if v[t] - max(v[left + 1 : t + 1].min(), v[t:right].min()) >= 20:
                        turns.add(t)
        turns = sorted(turns)
        for a, z in zip(turns[:-1], turns[1:], strict=True):
            own = [seen[first + t] for t in range(a, z + 1) if first + t in seen]
            gap = [t for t in range(a, z + 1) if first + t not in seen]
            if z - a < 6 or len(own) < 6 or not gap:
                continue
            quadratics += len(gap)
            t = np.array([p[0] - first for p in own], dtype=float)
            m = np.stack([np.ones(len(t)), t - t.mean(), (t - t.mean()) ** 2], axis=1)
            for k in (0, 1):
                v, base = np.array([p[1 + k] for p in own]), np.maximum([p[3] for p in own], 0.15)
                w = base
                for _ in range(4):
                    c = np.linalg.solve(m.T @ (m * (w**2)[:, None]), m.T @ (w**2 * v))
                    off = np.abs(m @ c - v)
                    w = base / np.maximum(1, off / (2 * max(1.4826 * np.median(off), 2)))
                for g in gap:
                    path[k][g] = c @ [1, g - t.mean(), (g - t.mean()) ** 2]
        exact = {p[0]: p[1:3] for p, ok in zip(points, believed, strict=True) if ok}
        for t in range(len(level)):
            assert got[seg][first + t] == pytest.approx(exact.get(first + t, (path[0][t], path[1][t])), abs=0.02)
    assert quadratics > 0


def test_two_players_over_the_table(spark, series):
    """Candidates (y, x) in pixels with x / 100 down the court; those who stand still in most keys are no players."""
    got = {(r.seg, r.frame, r.player): (r.x, r.y) for r in run_queries.j08(spark, SF).collect()}
    cells = defaultdict(list)
    for seg, rows in series.items():
        for r in rows:
            cells[r.x // 10, r.y // 10].append((seg, float(r.x), r.y))
    still = []
    for own in cells.values():
        xs, ys = np.array([p[1] for p in own]), np.array([p[2] for p in own])
        if len({p[0] for p in own}) / len(series) >= 0.7 and xs.std() <= 2.9 and ys.std() <= 2.9:
            still.append((xs.mean(), ys.mean()))
    want = {}
    for seg, rows in series.items():
        by = defaultdict(list)
        for r in rows:
            if all(math.dist((r.x, r.y), a) >= 2 for a in still):
                by[r.frame // 3].append((float(r.x), r.y, r.x / 100, r.x % 10))
        last = {}
        for f in sorted(by):
            for player, mine in (("top", lambda c: c[2] < 0.5), ("bottom", lambda c: c[2] >= 0.5)):
                own = sorted(c for c in by[f] if mine(c))
                if player in last and f - last[player][2] > 5:
                    del last[player]
                if player in last:
                    x, y, at = last[player]
                    own = [c for c in own if math.dist(c[:2], (x, y)) <= 25 * (f - at)]
                    pick = min(own, key=lambda c: math.dist(c[:2], (x, y)), default=None)
                else:
                    pick = max((c for c in own if c[3] >= 4), key=lambda c: c[3], default=None)
                if pick:
                    last[player] = (*pick[:2], f)
                    want[seg, f, player] = pick[:2]
    assert still and got == want


def test_anchors_take_all_near_them(spark):
    rng = np.random.default_rng(2)
    points = [(i, *map(float, rng.uniform(-50, 50, 2))) for i in range(400)]
    anchors = [(0.0, 0.0), (-20.5, 13.0), (49.0, 49.0)]
    df = spark.createDataFrame(points, "i long, x double, y double")
    got = {r.i for r in stats.away_from(df, "x", "y", spark.createDataFrame(anchors, "mx double, my double"), 9.0).collect()}
    assert got == {i for i, *p in points if all(math.dist(p, a) >= 9 for a in anchors)}


def test_unknown_confidence_is_the_least(spark):
    rows = [(1, f, 10.0 * f, 0.0, None if f == 3 else 0.9) for f in range(6)] + [(2, 0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "seg long, frame long, x double, y double, conf double")
    got = folds.kalman_accepted(df, "seg").orderBy("frame").collect()
    assert [r.accepted for r in got] == [True] * 6 and list(kernels.viterbi(*(np.zeros(0),) * 4)) == []
    assert folds.kalman_accepted(df.limit(0), "seg").count() == 0 and folds.fill_path(df.where("seg = 2"), "seg", how="kalman").where(F.col("x").isNotNull()).count() == 0


def test_first_rises_over_the_table(spark, series):
    """By trying every start: steps onwards that hardly go down, without a pause, of which the falls (y grows downwards) are enough."""
    got = {r.seg: r.rise for r in more_queries.f10(spark, SF).collect()}
    want = {}
    for seg, rows in series.items():
        for i in range(len(rows)):
            run = [rows[i]]
            while i + len(run) < len(rows):
                b = rows[i + len(run)]
                if b.frame - run[-1].frame > 1 or b.y - run[-1].y > 2:
                    break
                run.append(b)
            falls = sum(max(0.0, a.y - b.y) for a, b in zip(run, run[1:], strict=False))
            if len(run) > 3 and falls >= 40:
                want[seg] = rows[i].frame
                break
    assert got == want and want


def marked(frames_, last, apart):
    """Of marked frames (0 to last) the middle of each stretch away from the ends, and of those nearer than `apart` the later one, from the back."""
    stretches = []
    for f in sorted(frames_):
        if stretches and stretches[-1][-1] == f - 1:
            stretches[-1].append(f)
        else:
            stretches.append([f])
    middles = [(s[0] + s[-1]) // 2 for s in stretches if s[0] > 0 and s[-1] < last]
    kept = []
    for f in reversed(middles):
        if all(abs(f - g) >= apart for g in kept):
            kept.append(f)
    return sorted(kept)


def high_points(y, least):
    out = []
    for i in range(1, len(y) - 1):
        z = i
        while z + 1 < len(y) and y[z + 1] == y[i]:
            z += 1
        if y[i - 1] < y[i] and z + 1 < len(y) and y[z + 1] < y[i]:
            left = next((s for s in range(i, -1, -1) if y[s] > y[i]), -1)
            right = next((s for s in range(i, len(y)) if y[s] > y[i]), len(y))
            if y[i] - max(min(y[left + 1 : i + 1]), min(y[i:right])) >= least:
                out.append((i + z) // 2)
    return out


def angle(dx, dy):
    return math.trunc(math.degrees(math.atan2(dy, dx)))


def test_signals_over_the_table(spark, series):
    got = {(r.seg, r.frame): r.reasons for r in further_queries.f15(spark, SF).collect()}
    want = {}
    for seg, rows in series.items():
        first, last = rows[0].frame, rows[-1].frame
        f, x, y = zip(*[(r.frame - first, r.x, r.y) for r in rows if r.label != "error"], strict=True)
        m, fired = len(f), {}
        serve = [f[i] for i in range(m - 1) if y[i] - y[i + 1] >= 5 * (f[i + 1] - f[i])][:1]
        fired["serve"] = serve
        peaks = high_points(y, 5)
        if len(peaks) >= 5:
            lone = [y[p] - min(y[min(p, q) : max(p, q) + (1 if p > q else 0)]) < 5 for p, q in ((peaks[0], peaks[1]), (peaks[-1], peaks[-2]))]
            peaks = peaks[lone[0] : len(peaks) - lone[1]]
        fired["ypeak"] = [f[p] for p in peaks if f[p] >= (serve[0] if serve else 0)]
        turns = set()
        for a, z in zip(peaks, peaks[1:], strict=False):
            valley = a + min(range(z - a + 1), key=lambda k: (y[a + k], k))
            for j in range(max(valley + 1, 3), min(z, m - 4) + 1):
                (p, q), (r, s) = (x[j] - x[j - 3], y[j] - y[j - 3]), (x[j + 3] - x[j], y[j + 3] - y[j])
                one, two = angle(p, q), angle(r, s)
                turn = abs(one - two) if one * two >= 0 else abs(one) + abs(two)
                slow, fast = sorted((math.hypot(p, q), math.hypot(r, s)))
                if min(turn, 360 - turn) > 30 and fast >= 1.5 * slow:
                    turns.add(f[j])
        fired["accel"] = marked(turns, last - first, 3)
        fired["ramp"] = []
        for j in range(3, m - 3):
            steps = [math.dist((x[i], y[i]), (x[i + 1], y[i + 1])) for i in range(j - 3, j + 3)]
            before, after = sum(steps[:3]) / 3, sum(steps[3:]) / 3
            if 0 < before < 12 and after >= 1.8 * before and abs((x[j + 3] - x[j]) - (x[j] - x[j - 3])) / 3 >= 2:
                fired["ramp"].append(f[j])
        kept = marked(set().union(*fired.values()), last - first, 3)
        for i in range(m):  # the first sustained rise: six steps, pauses of three frames at most, 60 in all
            run = [i]
            while run[-1] + 1 < m and f[run[-1] + 1] - f[run[-1]] <= 3 and y[run[-1] + 1] - y[run[-1]] <= 2:
                run.append(run[-1] + 1)
            if len(run) > 6 and sum(max(0.0, y[k] - y[k + 1]) for k in run[:-1]) >= 60:
                if all(abs(f[i] - k) >= 3 for k in kept):
                    kept.append(f[i])
                    fired["serve_rise"] = [f[i]]
                break
        for k in kept:
            names = sorted(n for n, at in fired.items() if any(abs(k - g) <= 5 for g in at)) or ["ypeak"]
            want[seg, first + k] = "+".join(names)
    assert got == want and len({n for r in want.values() for n in r.split("+")}) >= 4


def test_paths_are_fitted_side_by_side(monkeypatch):
    """Many paths take no more solves than a few rounds, and each comes out as it does alone."""
    rng = np.random.default_rng(5)
    paths = []
    for n in [1, 3, 7, *rng.integers(8, 60, 80)]:
        f = np.sort(rng.choice(90, n, replace=False))
        paths.append((f, rng.uniform(0, 100, n), rng.uniform(0, 60, n), rng.uniform(0, 1, n)))
    solves = []
    solve = smoothing._bands_solve
    monkeypatch.setattr(smoothing, "_bands_solve", lambda *a: solves.append(1) or solve(*a))
    for how in ("kalman", "spline", "pieces"):
        together = kernels.fill_paths(paths, how)
        assert len(solves) < 120
        for path, got in zip(paths[::6], together[::6], strict=True):
            for a, b in zip(got, kernels.fill_path(*path, how), strict=True):
                assert np.allclose(a, b, rtol=0, atol=1e-6)
        solves.clear()
    alone = [kernels.fill_path(*p) for p in paths]
    monkeypatch.setattr(smoothing, "CELLS", 500)  # parts of a few paths
    for got, want in zip(kernels.fill_paths(paths), alone, strict=True):
        assert all(np.allclose(a, b, rtol=0, atol=1e-6) for a, b in zip(got, want, strict=True))


def test_keys_of_many_batches_come_whole(spark):
    rows = spark.range(4000).selectExpr("case when id < 3000 then 1 else id div 7 end k", "id at").repartition(1)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        run = lambda part, cuts: part.iloc[cuts[:-1]].assign(n=np.diff(cuts), last=[part["at"].iloc[z - 1] for z in cuts[1:]])[["k", "n", "last"]]
        got = sorted(map(tuple, folds.by_keys(rows, ["k"], ["at"], run, "k long, n long, last long", 5).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert got == sorted(map(tuple, rows.groupBy("k").agg(F.count("*"), F.max("at")).collect()))


def test_candidates_cost_no_array_calls(monkeypatch):
    """A frame has a few candidates, for each of which a call on arrays costs more than all the rest."""
    rng = np.random.default_rng(3)
    frames_ = [(f, [tuple(c) for c in rng.integers(0, 12, (rng.integers(0, 6), 4)) / (1, 1, 12, 2)]) for f in np.cumsum(rng.integers(1, 5, 400)).tolist()]
    last, want = {}, []
    for f, found in frames_:
        chosen = []
        for half in (False, True):
            own = [(i, c) for i, c in enumerate(found) if (c[2] >= 0.5) == half]
            x, y, at = last.get(half, (0, 0, -9))
            if f - at <= 5:
                near = [(math.dist(c[:2], (x, y)), i) for i, c in own if math.dist(c[:2], (x, y)) <= 2 * (f - at)]
            else:
                near = [(-c[3], i) for i, c in own if c[3] >= 4]
            chosen.append(min(near)[1] if near else None)
            if near:
                last[half] = (*found[chosen[-1]][:2], f)
        want.append((f, *chosen))
    monkeypatch.setattr(np, "hypot", None)
    assert kernels.track_two(frames_, reach=2.0) == want
