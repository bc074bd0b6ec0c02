"""Streams whose state ends by timers, against the batch operators on the same rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from seriesloom.operators import folds, scans
from seriesloom.streaming import tracker

T0 = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def drained(df, name, checkpoint):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def states(spark, checkpoint, name):
    return spark.read.format("statestore").option("stateVarName", name).load(checkpoint).collect()


def candidates():
    rows = []
    for f in range(0, 40):
        for k in (1, 2):
            if f % 11 in (5, 6) and k == 1:
                continue
            rows.append((k, f, 100.0 + 7 * f, 50.0 + 3 * (f % 4), 0.2, 6.0 + k))
            rows.append((k, f, 400.0 - 5 * f, 300.0 + f, 0.8, 5.0))
            if f % 3 == 0:
                rows.append((k, f, 90.0 + 9 * f, 90.0, 0.3, 9.0))
    rows += [(1, f, 10.0, 10.0, 0.1, 8.0) for f in range(60, 64)]  # after a pause the track begins anew
    return rows


def test_players_are_followed_and_forgotten(rocks, tmp_path):
    rows = candidates()
    schema = "seg long, frame long, x double, y double, court double, size double"
    timed = [(*r, T0 + timedelta(seconds=r[1])) for r in rows]
    # three batches, the second of them with a frame that the first one began; the last, of another key, moves the watermark on
    late = [r for r in timed if r[1] == 20][:1]
    parts = [[r for r in timed if r[1] <= 20 and r not in late], late + [r for r in timed if r[1] > 20], [(99, 0, 1.0, 1.0, 0.1, 9.0, T0 + timedelta(seconds=5000))]]
    for i, part in enumerate(parts):
        rocks.createDataFrame(part, schema + ", time timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    stream = rocks.readStream.schema(schema + ", time timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
    check = str(tmp_path / "check")
    got = drained(tracker.follow_players(stream, "seg", "5 seconds", idle=60, reach=30.0), "followed", check)
    want = folds.two_player_tracks(rocks.createDataFrame(rows, schema), "seg", reach=30.0).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 100
    # the timers of the silent keys have fired: only the last key's state is there
    for name in ("waiting", "last", "end"):
        assert {r.key[0] for r in states(rocks, check, name)} <= {99}
    assert {r.key[0] for r in states(rocks, check, "end")} == {99}


def samples():
    out = []
    for k in range(3):
        v = 0
        for i in range(60):
            v += (i * (k + 3)) % 7 - 1  # falls at times: no sample
            out.append((k, T0 + timedelta(seconds=i * 3 + i % 3), float(v)))
    return out


def plain_rates(rows, share):
    out = {}
    for k in {r[0] for r in rows}:
        high = at = smooth = None
        for _, t, v in sorted(r for r in rows if r[0] == k):
            if high is None:
                high, at = v, t
            elif v > high:
                rate = (v - high) / (t - at).total_seconds()
                smooth = rate if smooth is None else share * rate + (1 - share) * smooth
                out[k, t] = (rate, smooth)
                high, at = v, t
    return out


@pytest.mark.parametrize("chunk", [5.0, 40.0, 1e12])
def test_rates_are_the_recurrence(spark, chunk):
    rows = samples()
    df = spark.createDataFrame(rows, "k long, time timestamp, value double").withColumn("t", F.col("time").cast("double"))
    df = df.union(df.limit(1).select("k", "time", F.lit(None), "t"))
    found = scans.weighted(scans.rates(df, "k", "t", "value", chunk), "k", "t", "rate", 0.3, chunk).collect()
    want = {(k, t.timestamp()): x for (k, t), x in plain_rates(rows, 0.3).items()}
    first = min(t for _, t, _ in rows)
    shift = spark.createDataFrame([(first,)], "t timestamp").select(F.col("t").cast("double")).first()[0] - first.timestamp()
    assert {(r.k, r.t): (r.rate, r.smoothed) for r in found} == {(k, t + shift): pytest.approx(x) for (k, t), x in want.items()}


def test_half_lives_follow_irregular_steps(spark):
    rows = [(1, float(t), float(v)) for t, v in [(0, 8), (1, 4), (3, 4), (10, 0), (100, 16)]]
    got = scans.weighted(spark.createDataFrame(rows, "k long, t double, v double"), "k", "t", "v", 0.0, 4.0, half=1.0).orderBy("t").collect()
    e, last, want = None, None, []
    for _, t, v in rows:
        w = 1.0 if e is None else 1 - 2.0 ** -(t - last)
        e, last = v if e is None else w * v + (1 - w) * e, t
        want.append(e)
    assert [r.smoothed for r in got] == pytest.approx(want)


def test_streamed_rates_are_those_of_the_batch(rocks, tmp_path):
    rows = samples()
    schema = "k long, time timestamp, value double"
    cuts = [T0, T0 + timedelta(seconds=60), T0 + timedelta(seconds=107), T0 + timedelta(days=2)]
    for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        rocks.createDataFrame([r for r in rows if a <= r[1] < z], schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    rocks.createDataFrame([(9, T0 + timedelta(days=9), 1.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in/p9"))
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    check = str(tmp_path / "check")
    got = {(r.k, r.time): (r.rate, r.smoothed) for r in drained(tracker.smoothed_rates(stream, "k", "10 seconds", 0.3), "rates_out", check)}
    assert got == {k: pytest.approx(x) for k, x in plain_rates(rows, 0.3).items()}
    assert {r.key[0] for r in states(rocks, check, "now")} == {9}
