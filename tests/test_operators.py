import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import geometry as geo
from seriesloom.functions import scalars
from seriesloom.operators import bands, folds, runs, stats


def rows(df):
    return sorted(map(tuple, df.collect()))


def mask(spark, text):
    return spark.createDataFrame([("k", i, c == "1") for i, c in enumerate(text)], "k string, f long, m boolean")


@pytest.mark.parametrize("text, want", [("1011101000011", [(0, 0), (2, 4), (6, 6), (11, 12)]), ("1111111", [(0, 6)]), ("", [])])
@pytest.mark.parametrize("chunk", [2, 3, 100])
def test_runs_cross_chunks(spark, text, want, chunk):
    out = runs.mask_runs(mask(spark, text), "k", "f", F.col("m"), chunk=chunk)
    assert rows(out.select("start_frame", "end_frame")) == want


def test_intervals_touch_and_complement(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 5, 8), ("k", 2, 3), ("k", 10, 12)], "k string, a long, z long")
    merged = runs.merge_intervals(df, "k", "a", "z")
    assert rows(merged) == [("k", 0, 8, 3), ("k", 10, 12, 1)]
    assert rows(runs.complement(merged, "k", "a", "z", F.lit(-1), F.lit(20))) == [("k", -1, 0), ("k", 8, 10), ("k", 12, 20)]


def test_merge_by_gap_zero_keeps_maximal_runs(spark):
    found = runs.mask_runs(mask(spark, "110110011"), "k", "f", F.col("m"))
    assert runs.merge_intervals(found, "k", "start_frame", "end_frame", 0).count() == 3
    assert runs.merge_intervals(found, "k", "start_frame", "end_frame", 2).count() == 2


def test_dead_rows(spark):
    data = [("m", i, s, v) for i, (s, v) in enumerate([("0:0", False), ("0:0", False), ("0:0", False), ("0:0", True), ("1:0", True)])]
    df = spark.createDataFrame(data, "k string, i long, s string, v boolean")
    assert [r[1] for r in rows(runs.dead_rows(df, "k", "i", F.col("s"), F.col("v"), F.col("s") == "0:0"))] == [0, 1, 2]


def test_band_aggregate_reaches_over_parts(spark):
    df = spark.createDataFrame([("k", i, 1.0) for i in range(50)], "k string, f long, v double")
    out = bands.band_aggregate(df, "k", "f", -3, 2, chunk=7, n=F.count("*"))
    assert [r[-1] for r in rows(out)] == [min(i, 3) + 1 + min(2, 49 - i) for i in range(50)]


def test_band_joins(spark):
    a = spark.createDataFrame([("k", f) for f in (0, 10, 20)], "k string, f long")
    b = spark.createDataFrame([("k", f) for f in (3, 8, 12, 40)], "k string, f long")
    assert rows(bands.band_join(a, b, "k", "f", 3).select("f", "r_f")) == [(0, 3), (10, 8), (10, 12)]
    assert rows(bands.band_join(a, b, "k", "f", 3, "left_anti")) == [("k", 20)]
    assert rows(bands.nearest(a, b, "k", "f", "n", 3, F.lit(999))) == [("k", 0, 3, 3), ("k", 10, 8, 2), ("k", 20, None, 999)]


def test_locate_is_inclusive(spark):
    iv = spark.createDataFrame([("k", 7, 1, 3), ("k", 9, 5, 5)], "k string, i long, s long, e long")
    p = spark.createDataFrame([("k", f) for f in range(7)], "k string, f long")
    assert rows(bands.locate(p, iv, "k", "f", "s", "e", "i"))[1:6] == [("k", 1, 7, 0), ("k", 2, 7, 1), ("k", 3, 7, 2), ("k", 4, None, None), ("k", 5, 9, 0)]


def test_greedy_dedup_compares_with_the_last_kept(spark):
    data = [("k", 0, "top", 5.0), ("k", 10, "top", 9.0), ("k", 25, "top", 1.0), ("k", 30, "bottom", 1.0), ("k", 31, "top", None), ("k", 33, "top", 99.0)]
    df = spark.createDataFrame(data, "k string, f long, side string, s double")
    assert [r[1] for r in rows(folds.greedy_dedup(df, "k", "f", "side", "s", 18))] == [10, 30, 31]


def test_otsu_guards(spark):
    one = spark.createDataFrame([(7.0,)] * 5, "v double")
    assert stats.otsu3(one, F.col("v")).first()[0] == 8.0
    assert stats.otsu3(one.limit(0), F.col("v")).first()[0] is None


def test_otsu_finds_the_first_valley(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    v = np.clip(np.concatenate([rng.normal(1, 0.3, 3500), rng.normal(6, 2, 5500), rng.normal(45, 12, 1000)]), 0, None)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    assert 1.5 < stats.otsu3(df, F.col("v")).first()[0] < 6


def test_outliers_have_guards(spark):
    def kept(values):
        df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
        return [r[0] for r in rows(stats.reject_outliers(df, "v"))]

    assert kept([100, 350, *range(95, 108), 290]) == [0, *range(2, 16)]
    assert kept([20, 21, 500, 19]) == [0, 1, 2, 3]  # too few to judge
    assert len(kept([*range(50, 58), *range(900, 907)])) == 15  # too many to drop


def test_cross_distances_match_pairs(spark):
    v = [[1.0, 5.0], [2.0, 5.0], [4.0, -1.0], [4.0, 0.0]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i long, v array<double>")
    want = [sum(abs(a - b) for y in v for a, b in zip(x, y, strict=True)) for x in v]
    assert [r[1] for r in rows(stats.absolute_differences(df, "i", "v", buckets=3))] == pytest.approx(want)


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"all_b": [2, 30, 17], "all_a": [14, 29, 6]}', (6, 17)),
        ('Read:\n```\n{"score_b": 0, "score_a": 12}\n```\n', (12, 0)),
        ('{"all_b": [5, 18, 7', (None, 7)),
        ("no digits seen", (None, None)),
    ],
)
def test_scores(spark, text, want):
    a, b = scalars.scores(F.lit(text))
    assert tuple(spark.range(1).select(a, b).first()) == want


def test_lenient_ints(spark):
    assert one(spark, scalars.lenient_int(F.lit("3.7"))) is None
    assert one(spark, scalars.lenient_int(F.lit(" 12 "))) == 12
    assert one(spark, scalars.truncated_int(F.lit(3.7))) == 3


def test_angles_are_cut_first(spark):
    assert one(spark, geo.angle_between(*map(F.lit, (1.0, 0.0, 0.0, 1.0)))) == 90
    assert one(spark, geo.angle_between(*map(F.lit, (-1.0, 0.1, -1.0, -0.1)))) == 12


def test_angles_next_to_a_whole_number_are_as_in_sql(spark):
    import duckdb

    for dy, dx in ((-5.0000000000000036, -5.0), (-17.769999999999996, 12.0), (0.0, -3.0), (30.000000000000004, 30.0)):
        want = abs(duckdb.sql(f"select cast(trunc(degrees(atan2({dy}::double, {dx}::double))) as int)").fetchall()[0][0])
        assert one(spark, geo.angle_between(*map(F.lit, (1.0, 0.0, dx, dy)))) == want
    assert one(spark, geo.angle_between(F.lit(1.0), F.lit(0.0), F.lit(None).cast("double"), F.lit(1.0))) is None


def test_two_ground_points_differ(spark):
    ankles = [(F.lit(0.0), F.lit(5.0), F.lit(0.1)), (F.lit(4.0), F.lit(6.0), F.lit(0.1))]
    box = [F.lit(v) for v in (0.0, 0.0, 10.0, 20.0)]
    assert one(spark, F.array(*geo.ground_point(ankles, box, 0.5))) == [5.0, 20.0]
    assert one(spark, F.array(*geo.ground_point_for_model([a[:2] for a in ankles]))) == [4.0, 6.0]


def test_homography_inverse_and_scale(spark):
    court = [[F.lit(v) for v in r] for r in ((100.0, 0.0, 200.0), (0.0, 100.0, 100.0), (0.0, 0.0, 1.0))]
    back = geo.inverse(court)
    assert one(spark, F.array(*geo.project(back, F.lit(300.0), F.lit(250.0)))) == pytest.approx([1.0, 1.5])
    assert one(spark, geo.ground_scale(court, back, F.lit(300.0), F.lit(250.0))) == pytest.approx(100)


def test_missing_joints_lie_off_the_centre(spark):
    joints = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)))
    got = one(spark, geo.normalize_joints(joints, F.array(*map(F.lit, (0.0, 0.0, 3.0, 4.0)))))
    assert got == [pytest.approx([-0.3, -0.4]), pytest.approx([0.3, 0.4])]


def test_gaps_and_lines(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate([1.0, None, None, 4.0, None])], "k string, f long, v double")
    assert [r[3] for r in rows(bands.fill_linear(df, "k", "f", "v"))] == [1, 2, 3, 4, None]
    assert rows(bands.null_gaps(df, "k", "f", "v")) == [("k", 1, 2, 2, 1.0, 4.0), ("k", 4, 4, 1, 4.0, None)]


@pytest.mark.parametrize("bins, most", [(1024, 10_000), (3, 2), (2, 1)])
def test_quantiles_are_those_of_a_sort(spark, bins, most):
    rng = np.random.default_rng(bins)
    values = [float(v) for v in [*rng.exponential(5, 300), *np.repeat(2.5, 200), -7, 1e9, 1e-300, 0]]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
    shares = [0.0, 0.01, 0.25, 0.5, 0.731, 0.99, 1.0]
    assert stats.quantiles(df, "v", shares, bins, most) == pytest.approx(np.quantile(values, shares).tolist())
    assert stats.quantiles(df.limit(0), "v", shares) == [] and stats.quantiles(df.where("v = 2.5"), "v", [0.3]) == [2.5]


def test_points_on_hits_are_in_both_gaps(spark):
    points = spark.createDataFrame([("k", f, f * 1.0) for f in range(0, 13)] + [("j", 4, 0.0)], "k string, f long, v double")
    hits = spark.createDataFrame([("k", 2), ("k", 5), ("k", 9), ("j", 4)], "k string, f long")
    got = rows(bands.contained(points, hits, "k", "f").select("k", "lo", "hi", "f"))
    assert got == sorted(("k", lo, hi, f) for lo, hi in ((2, 5), (5, 9)) for f in range(lo, hi + 1))
