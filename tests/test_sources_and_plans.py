import json

import pytest
from pyspark.sql import functions as F

from seriesloom import schemas
from seriesloom.plans import runner
from seriesloom.sources import cache, envelope
from seriesloom.streaming import sessions


def test_envelope_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 19, 0.033, 0.633, 0.6), (40, 88, 1.333, 2.933, 1.6)], schemas.SEGMENTS)
    path = str(tmp_path / "a" / "segments.json")
    envelope.write_records(df, path, "segments", ["start_frame"], fps=30.0, note="é")
    assert "é" in "".join(r.value for r in spark.read.text(path).collect())
    back = envelope.read_segments(spark, path, schemas.SEGMENTS)
    assert [(r.segment_index, r.start_frame, r.fps) for r in back.orderBy("segment_index").collect()] == [(0, 1, 30.0), (1, 40, 30.0)]


def test_envelope_errors(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({"fps": 25}))
    with pytest.raises(ValueError):
        envelope.read_records(spark, str(tmp_path / "x.json"), "segments", schemas.SEGMENTS)
    (tmp_path / "y.json").write_text(json.dumps({"segments": [], "fps": 25}))
    with pytest.raises(ValueError):
        envelope.read_segments(spark, str(tmp_path / "y.json"), schemas.SEGMENTS)


def test_parsed_segments_skip_what_is_broken(spark):
    df = spark.createDataFrame([(0, "1.5", "2.0", None), (1, "x", "2", "1"), (2, "3", "3", None), (3, "1", "4", "2.5")], "segment_index long, start_sec string, end_sec string, duration_sec string")
    assert [tuple(r) for r in envelope.parsed_segments(df).orderBy("segment_index").collect()] == [(0, 1.5, 2.0, 0.5), (3, 1.0, 4.0, 2.5)]


def test_cache_resumes_by_partition(spark, tmp_path):
    keys = spark.createDataFrame([(0,), (1,)], "segment_index long")
    c = cache.Cache(spark, str(tmp_path), "segment_index", model="a")
    assert c.missing(keys).count() == 2
    one = keys.where("segment_index = 0").withColumn("v", F.lit(1.0))
    c.add(one)
    c.add(one)
    assert [r[0] for r in c.missing(keys).collect()] == [1] and c.read().count() == 1
    assert cache.Cache(spark, str(tmp_path), "segment_index", model="b").missing(keys).count() == 2


def test_dense_csv(spark, tmp_path):
    spine = spark.createDataFrame([(0, f, p) for f in range(2) for p in ("top", "bottom")], "segment_index long, frame long, player string")
    df = spark.createDataFrame([(0, 1, "top", 1.234)], "segment_index long, frame long, player string, x double")
    envelope.write_dense_csv(df, spine, ["segment_index", "frame", "player"], "segment_index", str(tmp_path / "csv"), {"x": "%.2f"})
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 4 and [r.x for r in back.where("x is not null").collect()] == ["1.23"]


def test_runner_orders_resumes_and_stops(tmp_path):
    done = []

    def make(name, fail=False, **kw):
        def body():
            if fail:
                raise RuntimeError("no")
            done.append(name)
            return name

        return runner.Stage(name, body, **kw)

    stages = [make("c", needs=("a",)), make("b", after=("c",)), make("a"), make("d", fail=True, needs=("b",)), make("e", needs=("d",))]
    assert [s.name for s in runner.ordered(stages)] == ["a", "c", "b", "d", "e"]
    states = runner.States(tmp_path / "status.json")
    assert not runner.run(stages, states)
    assert done == ["a", "c", "b"] and states.of("d") == "failed" and states.of("e") == "pending"
    again = runner.States(tmp_path / "status.json")
    assert not runner.run(stages, again) and done == ["a", "c", "b"]
    with pytest.raises(ValueError):
        runner.ordered([make("x", needs=("y",)), make("y", after=("x",))])


def _stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_session_stream_matches_runs(spark, tmp_path):
    rows = [("u", f"2024-01-01 00:00:{s:02d}") for s in (0, 3, 5, 30, 31)] + [("v", "2024-01-01 01:00:00")]
    src = spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("ts"))
    src.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "s"))
    got = _drain(sessions.session_runs(stream, "k", "ts", "10 seconds", "1 second"), "sessions_out")
    assert sorted((r.k, r.n) for r in got) == [("u", 2), ("u", 3)]


def test_tracker_stream(spark, tmp_path):
    rows = [("k", 0, 10.0), ("k", 1, 14.0), ("k", 1, 300.0), ("k", 2, 400.0), ("k", 9, 400.0)]
    stream = _stream(spark, str(tmp_path / "t"), rows, "k string, f long, x double")
    got = _drain(sessions.nearest_track(stream, "k", "f", "x"), "track_out")
    assert sorted(map(tuple, got)) == [("k", 0, 10.0), ("k", 1, 14.0), ("k", 9, 400.0)]
