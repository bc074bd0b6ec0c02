"""Completion, pruning and selection of hits against plain Python over a whole table."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from seriesloom.operators import folds
from seriesloom.plans import hits, hits_by_key, stage_queries

SF = "/root/testdata/sf0.001"
C, P, S = stage_queries.COMPLETE, stage_queries.PRUNE, stage_queries.SELECT


def by_seg(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r.seg, r[1])):
        out[r.seg].append(r)
    return out


def plain_runs(rows, value, conf):
    """Runs of (frame, value, conf) on consecutive frames with one value that is not None and conf or more on each."""
    out = []
    for r in rows:
        v = value(r)
        if v is None or r.conf < conf:
            continue
        if out and out[-1][-1].frame == r.frame - 1 and value(out[-1][-1]) == v:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def known(r):
    return None if r.label is None else "any"


def plain_locks(rows, least, peak):
    return [r for r in plain_runs(rows, lambda r: r.label, -1) if len(r) >= least and max(x.conf for x in r) >= peak]


class Scene:
    """One key's evidence. Each rule says of every frame whether a hit may be added there, and how it ranks: the lowest rank is taken."""

    def __init__(self, base, aux, weak, dense, rise, rejected):
        self.base = {r.frame: r.side for r in base}
        self.pool = {r.frame: r.side for r in aux if not any(abs(r.frame - b) <= C.fuse for b in self.base)}
        self.weak, self.dense = {r.frame: r for r in weak}, {r.frame: r for r in dense}
        self.rise, self.rejected = rise, set(rejected)
        self.frames = range(1, max([0, *self.dense, *self.base, *self.pool]) + 1)

    def begins(self, least, conf, label):
        """Frames at which a run of `least` frames or more begins, all with one label, which is not None, and that confidence."""
        ok = lambda f, v: f in self.dense and v is not None and label(self.dense[f]) == v and self.dense[f].conf >= conf
        out = {}
        for f in self.frames:
            v = label(self.dense[f]) if f in self.dense else None
            if ok(f, v) and not ok(f - 1, v):
                end = next(e for e in range(f, self.frames[-1] + 2) if not ok(e, v)) - 1
                if end - f + 1 >= least:
                    out[f] = (end, v)
        return out

    def between(self, lo, hi, side):
        """R1 in the gap between two base hits of one side."""
        a, z, wanted = lo + C.alt_margin, hi - C.alt_margin, {"top": "bottom", "bottom": "top"}[side]
        runs = self.begins(C.alt_run, C.alt_conf, lambda r: r.side if r.label else None)
        for f in range(a, z + 1):
            if f in self.weak and self.weak[f].side == wanted:
                yield (0, -self.weak[f].strength, f), f, "sens"
            if f in self.pool and self.pool[f] != side:
                yield (1, abs(2 * f - lo - hi), f), f, "refine"
            if f in runs and runs[f][1] == wanted and a < f and runs[f][0] < z:
                conf = [self.dense[g].conf for g in range(f, runs[f][0] + 1)]
                centre = sum(g * c for g, c in zip(range(f, runs[f][0] + 1), conf, strict=True)) / sum(conf)
                yield (2, -len(conf), -sum(conf) / len(conf), f), round(centre), "dense"

    def region(self, first, last):
        """R2 in a lock region."""
        peaks = [f for f in self.frames if f in self.weak and self.weak[f].is_peak and first - C.lock_guard <= f <= last + C.lock_guard]
        for f in self.frames:
            off = abs(2 * f - first - last)
            if peaks and f in peaks and (off, f) == min((abs(2 * p - first - last), p) for p in peaks) and self.weak[f].swings:
                yield (0, off, f), f, "sens"
            if f in self.pool and first - C.lock_guard <= f <= last + C.lock_guard:
                yield (1, off, f), f, "refine"

    def conf_near(self, f, width):
        return max((self.dense[g].conf for g in range(f - width, f + width + 1) if g in self.dense and self.dense[g].label), default=0)

    def voted(self, f):
        total = {s: sum(self.dense[g].conf for g in range(f - 4, f + 5) if g in self.dense and self.dense[g].label and self.dense[g].side == s) for s in ("top", "bottom")}
        first = {s: min((g for g in range(f - 4, f + 5) if g in self.dense and self.dense[g].label and self.dense[g].side == s), default=999) for s in total}
        return min(total, key=lambda s: (-total[s], first[s])) if any(first[s] < 999 for s in total) else None

    def hits(self):
        out = {f: ("ball", "") for f in self.base}
        order = sorted(self.base)
        gaps = [(lo, hi) for lo, hi in zip(order, order[1:], strict=False) if hi - lo >= C.alt_gap and self.base[lo] is not None and self.base[lo] == self.base[hi]]
        for options in [list(self.between(lo, hi, self.base[lo])) for lo, hi in gaps]:
            if options:
                _, f, source = min(options)
                out[f] = (source, "alt_fill")
        for first, (last, _) in self.begins(C.lock_run, -1, lambda r: r.label).items():
            sure = max(self.dense[f].conf for f in range(first, last + 1)) >= C.lock_conf
            if sure and not any(first - C.lock_guard <= f <= last + C.lock_guard for f in out):
                for _, f, source in sorted(self.region(first, last))[:1]:
                    out[f] = (source, "lock_fill")
        onsets = self.begins(C.onset_run, C.onset_conf, lambda r: "any" if r.label else None)
        for f in self.frames:
            alone = not any(abs(f - h) <= C.rescue_near for h in out)
            followed = any(f < h <= f + C.rescue_tail for h in out)
            if f in self.pool and alone and followed and any(abs(f - o) <= C.rescue_onset for o in onsets) and self.conf_near(f, 3) >= C.rescue_conf:
                # a later hit that is the first of these may be added after it, so only those there before count as followers
                out[f] = ("refine", "rescue")
        if self.rise is not None and not any(abs(self.rise - h) <= C.serve_near for h in out) and self.conf_near(self.rise, 4) >= C.serve_conf and self.voted(self.rise) == C.serve_side:
            ranked = sorted((abs(f - self.rise), f) for f in self.rejected if abs(f - self.rise) <= C.serve_snap)
            out[ranked[0][1] if ranked else self.rise] = ("serve", "serve_fill")
        return out


def test_completion_over_the_table(spark):
    base, aux, weak, dense, rises, rejected = map(by_seg, stage_queries.evidence(spark, SF))
    want = set()
    for k in dense:
        scene = Scene(base[k], aux[k], weak[k], dense[k], next((r.rise for r in rises[k]), None), [r.frame for r in rejected[k]])
        want |= {(k, f, *x) for f, x in scene.hits().items()}
    got = [tuple(r) for r in stage_queries.j11(spark, SF).select("seg", "frame", "source", "tag").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {"", "alt_fill", "lock_fill", "rescue"} <= {t for *_, t in want}


def frame(f, label, side, conf):
    return Row(seg=0, frame=f, label=label, side=side, conf=conf)


def completed(spark, base=(), aux=(), weak=(), dense=(), rise=None, rejected=(), last=60):
    by = {f: frame(f, None, None, 0.0) for f in range(1, last)} | {r.frame: r for r in dense}
    make = lambda rows, schema: spark.createDataFrame([(0, *r) for r in rows], f"seg long, frame long{schema}")
    found = hits.complete_hits(
        make(base, ", side string"), make(aux, ", side string"), make(weak, ", side string, strength double, is_peak boolean, swings boolean"),
        spark.createDataFrame(list(by.values()), "seg long, frame long, label string, side string, conf double"),
        spark.createDataFrame([] if rise is None else [(0, rise)], "seg long, rise long"), make([(f,) for f in rejected], ""), "seg", "frame", "side", C,
    )
    return sorted((r.frame, r.tag) for r in found.collect())


def test_rules_one_by_one(spark):
    """Small scenes whose additions can be told by eye."""
    two = [(10, "top"), (30, "top")]
    assert completed(spark, two, [(21, "bottom"), (18, "top")]) == [(10, ""), (21, "alt_fill"), (30, "")]
    assert completed(spark, two, [(21, "bottom")], [(15, "bottom", 5.0, False, True), (25, "bottom", 9.0, False, True)]) == [(10, ""), (25, "alt_fill"), (30, "")]
    assert completed(spark, [(10, "top"), (30, "bottom")], [(21, "bottom")]) == [(10, ""), (30, "")]
    sure = [frame(f, "click", "top", 0.9) for f in range(40, 44)]
    assert completed(spark, two[:1], [(45, "top"), (41, None)], dense=sure) == [(10, ""), (41, "lock_fill")]
    assert completed(spark, [(10, "top"), (42, "top")], [], dense=sure) == [(10, ""), (42, "")]
    begin = [frame(20, "view", "bottom", 0.45)]
    assert completed(spark, [(33, "top")], [(21, "top")], dense=begin) == [(21, "rescue"), (33, "")]
    assert completed(spark, [(50, "top")], [(21, "top")], dense=begin) == [(50, "")]  # no hit soon after
    serve = [frame(5, "signup", "bottom", 0.3)]
    assert completed(spark, [(33, "top")], dense=serve, rise=6) == [(6, "serve_fill"), (33, "")]
    assert completed(spark, [(33, "top")], dense=serve, rise=6, rejected=[4, 7]) == [(7, "serve_fill"), (33, "")]
    assert completed(spark, [(8, "top")], dense=serve, rise=6) == [(8, "")]


def plain_swing(rows, f):
    own = [r for r in rows if r.x is not None and r.y is not None and abs(r.frame - f) <= S.around]
    return (max(r.y for r in own) - min(r.y for r in own), max(r.x for r in own) - min(r.x for r in own)) if len(own) >= 5 else None


def plain_prune(frames, rows, dense):
    kept = list(frames)
    locks = plain_locks(dense, P.span_run, P.span_conf)
    serves = [r[0].frame for r in locks if r[0].label == "signup"]
    if serves:
        kept = [f for f in kept if serves[0] - P.span_lead <= f <= max(r[-1].frame for r in locks) + P.span_tail]
    swing = {f: plain_swing(rows, f) for f in kept}
    tails = plain_locks(dense, P.tail_run, P.tail_conf)
    if tails:
        end = max(r[-1].frame for r in tails) + P.tail_margin
        kept = [f for f in kept if not (f > end and swing[f] and swing[f][0] < P.tail_y and swing[f][1] < P.tail_x)]
    onsets = [r[0].frame for r in plain_runs(dense, known, P.onset_conf) if len(r) >= P.onset_run]
    again = True
    while again:
        again = False
        for f in reversed(kept):
            far = min((abs(f - o) for o in onsets), default=999) >= P.gate_onset
            if not any(0 < g - f <= P.gate_tail for g in kept) and far and swing[f] and swing[f][0] < P.gate_y and swing[f][1] < P.gate_x:
                kept.remove(f)
                again = True
                break
    return kept


def test_pruning_over_the_table(spark):
    seen, _, dense = map(by_seg, stage_queries.tracks(spark, SF))
    given = by_seg(stage_queries.chosen(spark, SF)[1][0])
    want = {(k, f) for k in seen for f in plain_prune([r.frame for r in given[k]], seen[k], dense[k])}
    got = {(r.seg, r.frame) for r in stage_queries.j12(spark, SF).collect()}
    assert got == want and 0 < len(want) < sum(map(len, given.values()))


def plain_select(candidates, rows):
    side = {r.frame: r.side for r in rows}
    swing = {f: plain_swing(rows, f) for f in candidates}
    kept = []
    for f in candidates:
        if swing[f] and swing[f][0] < S.y_swing and swing[f][1] < S.x_swing:
            continue
        if kept and side[f] is not None and side[f] == side[kept[-1]] and f - kept[-1] < S.apart:
            a, b = (sum(swing[g]) if swing[g] else float("inf") for g in (f, kept[-1]))
            if a > b:
                kept[-1] = f
            continue
        kept.append(f)
    return [f for f in kept if side[f] is None or sum(side[g] not in (None, side[f]) and abs(g - f) <= S.context for g in kept) >= S.company]


def test_selection_over_the_table(spark):
    seen = stage_queries.tracks(spark, SF)[0]
    swing = hits.swings(seen, "seg", "frame", "x", "y", "side", S.around)
    got = {(r.seg, r.frame) for r in hits.select_hits(seen.where("frame % 2 = 1"), swing, "seg", "frame", "side", S).collect()}
    rows = by_seg(seen)
    assert got == {(k, f) for k in rows for f in plain_select([r.frame for r in rows[k] if r.frame % 2], rows[k])}


def test_dead_segments_come_before_the_serve(spark):
    scores = spark.createDataFrame([(0, i, a, b) for i, (a, b) in enumerate([(0, 0), (0, 0), (0, 0), (3, 1), (3, 1), (11, 4), (11, 4), (None, None)])], "match int, seg int, a int, b int")
    dense = spark.createDataFrame([(1, 5, "serve", 0.9), (4, 5, "serve", 0.9), (5, 2, "smash", 0.9)], "seg int, frame int, label string, conf double")
    dead = hits.dead_keys(scores, dense, "match", "seg", "frame", "a", "b", "label = 'serve'", P)
    assert [r.seg for r in dead.collect()] == [0]


def test_both_ways_find_the_same_hits(spark):
    """Joins over tables and the co-grouped pass are written apart; of the joins' phases each is held against plain versions above."""
    got = sorted(map(tuple, stage_queries.j14(spark, SF).collect()), key=str)
    assert got == sorted(map(tuple, stage_queries.detected(spark, SF, hits.detect_hits).collect()), key=str)
    assert len({x[:2] for x in got}) == len(got) and {"ball", "sens", "refine"} <= {x[3] for x in got}
    plan = stage_queries.j14(spark, SF)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_keys_without_labels_or_tracks(spark):
    series = spark.createDataFrame([(1, f, 50.0 + f, 100.0 + 80 * (f % 8 < 4), "top") for f in range(1, 60)], "k int, frame long, x double, y double, side string")
    dense = spark.createDataFrame([(2, 1, "click", "top", 0.9)], "k int, frame long, label string, side string, conf double")
    got = hits_by_key.detect_hits(series, series.limit(0), dense, "k", "frame", "x", "y", "side", "false", None, S, C, P, **stage_queries.SIGNALS)
    want = hits.detect_hits(series, series.limit(0), dense, "k", "frame", "x", "y", "side", "false", None, S, C, P, **stage_queries.SIGNALS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert hits_by_key.detect_hits(series.limit(0), series.limit(0), dense.limit(0), "k", "frame", "x", "y", "side", "false").count() == 0


@pytest.mark.parametrize("rows", [[], [(1, 2, 5), (1, 4, 6), (1, 6, 8), (1, 9, 9)]])
def test_first_come_holds_no_earlier_pick(spark, rows):
    got = folds.first_come(spark.createDataFrame(rows, "k int, low int, pick int"), "k", "low", "pick").collect()
    assert sorted(r.low for r in got) == [2, 6, 9][: len(rows)]


def test_completion_is_one_pass(spark):
    """Hits are completed where a key's tracks meet, so no step is computed again for each rule that reads it."""
    plan = stage_queries.j11(spark, SF)._jdf.queryExecution().toString()
    assert plan.split("== Optimized Logical Plan ==")[0].count("FlatMapCoGroupsInArrow") == 2  # in the parsed and the analyzed plan


@pytest.mark.parametrize("rows", [1, 100, 10**6])
def test_a_call_takes_many_keys(spark, monkeypatch, rows):
    """However many keys a call takes, of whatever type, each is on its own."""
    monkeypatch.setattr(hits_by_key, "ROWS", rows)
    seen, aux, dense = (d.where("seg < 6").withColumn("seg", F.concat(F.lit("k"), F.col("seg"))) for d in stage_queries.tracks(spark, SF))
    seen, dense = seen.where("seg <> 'k5'"), dense.where("seg <> 'k4'")
    calls = (seen, aux, dense, "seg", "frame", "x", "y", "side", stage_queries.SERVE, None, S, C, P)
    got = hits_by_key.detect_hits(*calls, **stage_queries.SIGNALS)
    if rows == 1:
        want = hits.detect_hits(*calls, **stage_queries.SIGNALS)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        return
    one = stage_queries.detected(spark, SF, lambda *a, **k: hits_by_key.detect_hits(*a[:9], None, *a[10:], **k)).where("seg < 4")
    assert sorted((r.seg, *r[1:]) for r in got.where("seg < 'k4'").collect()) == sorted((f"k{r.seg}", *r[1:]) for r in one.collect())


def test_signals_are_found_for_all_keys_at_once(monkeypatch):
    """A call's keys share the passes over arrays: sixty keys take no more of them than two."""
    calls = []
    find_peaks = hits_by_key.kernels.find_peaks
    monkeypatch.setattr(hits_by_key.kernels, "find_peaks", lambda *a, **b: calls.append(1) or find_peaks(*a, **b))
    took = []
    for keys in (2, 60):
        frame, of = np.tile(np.arange(50), 2 * keys), np.repeat(np.arange(2 * keys), 50)
        x, y = np.random.default_rng(keys).uniform(0, 100, (2, len(of)))
        t = hits_by_key.Tracks(frame, x, y, np.where(y > 50, "top", "bottom").astype(object), of, 2 * keys, S.around)
        found = list(hits_by_key.evidence(t, S, C.fuse, y > 80, {}, stage_queries.SIGNALS))
        assert len(found) == keys and all(weak for _, _, _, weak, *_ in found)
        took.append(len(calls))
        calls.clear()
    assert took[0] == took[1]


@pytest.mark.parametrize("query", [stage_queries.j14, stage_queries.j11])
def test_events_are_numbered_once(spark, query):
    """The two tracks, the labels and the dead segments read one table; the events' JSON is not taken apart again for each."""
    assert "get_json_object" not in query(spark, SF)._jdf.queryExecution().toString()
