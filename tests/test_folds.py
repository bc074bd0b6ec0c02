"""Folds over a table's keys against plain Python, and their splitting of batches by key. Paths are in test_tracks."""

import math
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import folds
from seriesloom.plans import closing_queries, run_queries, stage_queries, stages
from seriesloom.plans.registry import frames

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def series(spark):
    by = defaultdict(list)
    for r in sorted(frames(spark, SF).collect(), key=lambda r: (r.seg, r.frame)):
        by[r.seg].append(r)
    return by


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_keys_are_whole_in_every_batch(spark, batch):
    rows = [(i % 7 if i % 7 else None, i) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, i long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = folds.by_key(df, ["k"], [F.desc("i")], lambda p: pd.DataFrame({"k": p["k"].iloc[:1], "n": [len(p)], "first": [p["i"].iloc[0]]}), "k long, n long, first long")
        got = {r.k: (r.n, r.first) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert got == {k: (sum(a == k for a, _ in rows), max(i for a, i in rows if a == k)) for k in [None, *range(1, 7)]}
    assert folds.by_key(df.limit(0), ["k"], ["i"], lambda p: p, "k long, i long").count() == 0


def flooded(cells):
    """4-connected components of {(x, y): v}."""
    left, out = dict(cells), []
    while left:
        todo, own = [next(iter(left))], {}
        while todo:
            at = todo.pop()
            if at in left:
                own[at] = left.pop(at)
                todo += [(at[0] + a, at[1] + b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))]
        out.append(own)
    return out


def test_blobs_over_the_table(spark):
    cells = defaultdict(dict)
    for r in closing_queries.pixels(spark, SF).collect():
        cells[r.g][r.x, r.y] = r.v
    want, largest, track = [], {}, {}
    for g, own in cells.items():
        found = flooded(own)
        for c in found:
            if len(c) >= 2:
                w = sum(c.values())
                want.append((g, round(sum(x * v for (x, _), v in c.items()) / w, 4), round(sum(y * v for (_, y), v in c.items()) / w, 4), len(c), max(c.values())))
        box = lambda c: (min(x for x, _ in c), max(x for x, _ in c), min(y for _, y in c), max(y for _, y in c))
        order = lambda c: ((box(c)[1] - box(c)[0] + 1) * (box(c)[3] - box(c)[2] + 1), -box(c)[0], -box(c)[2])
        largest[g] = box(max(found, key=order))
        bright = flooded({k: v for k, v in own.items() if v > 1})
        if bright:
            b = max(bright, key=order)
            a, z, t, e = box(b)
            track[g] = ((a + z + 1) / 2 * 2.0, (t + e + 1) / 2 * 3.0, max(b.values()) / 255)
    got = sorted((r.g, r.cx, r.cy, r.area, r.peak) for r in run_queries.j03(spark, SF).collect())
    assert [x[:1] + x[3:] for x in got] == [x[:1] + x[3:] for x in sorted(want)] or sorted(x[3:] for x in got) == sorted(x[3:] for x in want)
    assert sorted(x[1:3] for x in got) == [pytest.approx(x, abs=2e-4) for x in sorted(x[1:3] for x in want)]
    assert {r.g: (r.left, r.right, r.top, r.bottom) for r in closing_queries.g08(spark, SF).collect()} == largest
    assert {r.g: (r.x, r.y, r.conf) for r in closing_queries.j04(spark, SF).collect()} == track


def cross_levels(found, vector):
    """For each segment the mean distance of its two middle frames' vectors from those of every other segment, pair by pair."""
    def middles(seg, a, z):
        h = a + (z + 1 - a) // 2
        return [vector[seg, (a + h) // 2], vector[seg, (h + z + 1) // 2]]

    own = [middles(*f) for f in found]
    levels = []
    for i, mine in enumerate(own):
        total = sum(sum(abs(p - q) for p, q in zip(v, w, strict=True)) / len(v) for j, other in enumerate(own) if j != i for v in mine for w in other)
        levels.append(round(total / ((len(own) - 1) * 4)) if len(own) > 1 else 0)
    return levels


def middle(values):
    v = sorted(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def without_odd(found, levels, k):
    m = middle(levels)
    odd = [f for f, v in zip(found, levels, strict=True) if v > k * m]
    return [f for f in found if f not in odd] if len(levels) >= 8 and m > 0 and len(odd) <= 0.3 * len(levels) else found


def low_runs(series, bar, rules):
    want = []
    for seg, rows in series.items():
        runs = []
        for r in rows:
            if r.y < bar and r.frame % 40 != 11:
                if runs and r.frame - runs[-1][1] <= rules.merge_gap:
                    runs[-1][1] = r.frame
                else:
                    runs.append([r.frame, r.frame])
        want += [(seg, a, z) for a, z in runs if z - a + 1 >= math.ceil(rules.min_seconds * rules.fps)]
    return want


def threshold(spark):
    from seriesloom.operators import stats

    return stats.otsu3(frames(spark, SF).where("frame % 40 <> 11"), F.col("y")).first()[0]


def test_segments_by_their_mean_score(spark, series):
    rules = stages.SegmentRules()
    found = low_runs(series, threshold(spark), rules)
    y = {(seg, r.frame): r.y for seg, rows in series.items() for r in rows}
    levels = [sum(y[seg, f] for f in range(a, z + 1)) / (z - a + 1) for seg, a, z in found]
    rows = frames(spark, SF)
    got = stages.segment_scores(rows, "seg", "frame", "y", excluded=rows.where("frame % 40 = 11").select("seg", "frame")).collect()
    assert sorted((r.seg, r.start_frame, r.end_frame) for r in got) == sorted(without_odd(found, levels, rules.outlier))
    assert all(r.start_sec == round(r.start_frame / 25, 3) for r in got)


def test_segments_over_the_table(spark, series):
    """J15, all its steps: low runs; near the nearest by cross-frame averages, without outliers; joined where no cut is between; moved to cuts."""
    rules = stages.SegmentRules(widest=0.4, bridge=3, spike=70.0, around=3)
    vector = {(seg, r.frame): (float(r.x), r.y / 2) for seg, rows in series.items() for r in rows}
    found = low_runs(series, threshold(spark), rules)
    levels = cross_levels(found, vector)
    wider = 0.4 if len(found) <= 10 else 0.0 if len(found) >= 40 else 0.4 * (40 - len(found)) / 30
    near = [f for f, v in zip(found, levels, strict=True) if v <= round(min(levels) * (1 + wider))]
    kept = without_odd(near, cross_levels(near, vector), rules.outlier)
    assert 0 < len(kept) <= len(near) < len(found)
    want, moved, bridged = [], 0, 0
    for seg, rows in series.items():
        jump = {b.frame: abs(b.y - a.y) for a, b in zip(rows, rows[1:], strict=False)}
        own = []
        for _, a, z in sorted(f for f in kept if f[0] == seg):
            gap = a - own[-1][1] - 1 if own else None
            if own and (gap <= 0 or gap <= rules.bridge and max(jump[f] for f in range(own[-1][1] + 1, a + 1)) < rules.spike):
                own[-1][1], bridged = z, bridged + 1
            else:
                own.append([a, z])

        def cut(at, jump=jump):
            about = {f: jump[f] for f in range(at - rules.around, at + rules.around + 1) if f in jump}
            best = min(about, key=lambda f: (-about[f], f))
            return best if about[best] >= rules.spike and about[best] >= 3 * max(middle(about.values()), 1) else None

        last = -1
        for i, (a, z) in enumerate(own):
            c, d = cut(a), cut(z)
            low, high = max(a if c is None else c, last + 1), z if d is None else d - 1
            high = min(high, own[i + 1][0] - 1) if i + 1 < len(own) else high
            low, high = (low, high) if low <= high else (a, z)
            moved += (low, high) != (a, z)
            want.append((seg, low, high))
            last = high
    got = stage_queries.j15(spark, SF).collect()
    assert sorted((r.seg, r.start_frame, r.end_frame) for r in got) == sorted(want) and moved
    assert all(r.duration_sec == pytest.approx((r.end_frame - r.start_frame) / 25) for r in got)


def test_gaps_are_bridged_unless_there_is_a_cut(spark):
    found = spark.createDataFrame([(1, 0, 9), (1, 13, 20), (1, 24, 30), (1, 60, 70)], "k int, start_frame int, end_frame int")
    jumps = spark.createDataFrame([(1, f, 90.0 if f in (22, 58) else 40.0 if f == 11 else 1.0) for f in range(1, 75)], "k int, frame int, jump double")
    got = stages.cut_between(found, jumps, "k", "frame", "jump", stages.SegmentRules(bridge=5, spike=70.0, around=3)).collect()
    # 11 is no cut; at 22 one is, where the first ends and, as it may not begin sooner, the second stays; 58 begins the last
    assert sorted((r.start_frame, r.end_frame) for r in got) == [(0, 21), (22, 30), (58, 70)]


def test_a_single_scene_is_one_segment(spark):
    """Scores without a tail are all low, but for excluded frames; with one high score they are split."""
    rows = [(1, f, 10.0 + f % 2) for f in range(40)]
    calm = spark.createDataFrame(rows, "k int, frame int, s double")
    out = spark.createDataFrame([(1, f) for f in range(20, 26)], "k int, frame int")
    got = stages.segment_scores(calm, "k", "frame", "s", excluded=out).collect()
    assert sorted((r.start_frame, r.end_frame) for r in got) == [(0, 19), (26, 39)]
    whole = stages.segment_scores(calm.where("frame < 12 or frame > 30").union(spark.createDataFrame([(1, 20, 900.0)], calm.schema)), "k", "frame", "s").collect()
    assert all(not r.start_frame <= 20 <= r.end_frame for r in whole)
