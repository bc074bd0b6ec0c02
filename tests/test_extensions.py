"""Spark's extension points: table functions, the data source and batch prediction."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.functions import tables
from seriesloom.operators import runs
from seriesloom.plans import band_queries, extension_queries, run_queries, stage_queries, stages
from seriesloom.plans.registry import frames
from seriesloom.sources import segment_files

SF = "/root/testdata/sf0.001"


def same(a, b):
    return sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_functions_give_the_rows_of_the_operators(spark):
    assert same(extension_queries.m01(spark, SF), run_queries.f02(spark, SF))
    assert same(extension_queries.m02(spark, SF), band_queries.f17(spark, SF))


def test_functions_take_the_types_they_are_given(spark):
    tables.register(spark)
    rows = [("a", 1, "x", 2.0), ("a", 2, "x", None), ("a", 4, "x", 4.0), ("a", 5, None, 1.0), ("a", 6, "y", 0.0), ("b", 1, "y", 1.0), (None, 3, "y", 1.0)]
    df = spark.createDataFrame(rows, "k string, at int, name string, w double").repartition(3)
    found = spark.sql("select * from label_runs(table({df}) partition by (k) order by (at), 'k', 'at', 'name', 'w', 1)", df=df)
    assert dict(found.dtypes) == {"key": "string", "label": "string", "f0": "int", "f1": "int", "n": "bigint", "mean_conf": "double", "peak": "double", "center": "double"}
    want = runs.label_runs(df.where("k is not null"), "k", "at", "name", 1, "w")
    got = {(r.key, r.f0): r for r in found.collect()}
    assert got[None, 3].n == 1
    for r in want.collect():
        g = got[r.k, r.f0]
        assert (g.label, g.f1, g.n, g.mean_conf, g.peak, g.center) == (r.name, r.f1, r.n, r.mean_conf, r.peak, r.center)
    assert len(got) == want.count() + 1
    assert spark.sql("select * from label_runs(table({df}) partition by (k) order by (at), 'k', 'at', 'name', 'w', 1)", df=df.limit(0)).count() == 0
    with pytest.raises(Exception, match="no column"):
        spark.sql("select * from label_runs(table({df}) partition by (k) order by (at), 'k', 'at', 'nothing', 'w', 1)", df=df).collect()


def test_table_functions_take_rows_as_they_come(spark):
    """Rows are not made into a table for each call, and numbers of other types come out as their columns' types."""
    tables.register(spark)
    df = spark.createDataFrame([("a", 1.0, "p", 2), ("a", 2.0, "p", 5), ("a", 9.5, "q", None)], "k string, at double, name string, w int").withColumn("hit", F.col("at") < 3)
    found = spark.sql("select * from label_runs(table({df}) partition by (k) order by (at), 'k', 'at', 'name', 'w', 1)", df=df)
    assert sorted(map(tuple, found.collect())) == [("a", "p", 1.0, 2.0, 2, 3.5, 5.0, 12 / 7), ("a", "q", 9.5, 9.5, 1, None, None, None)]
    windows = spark.sql("select * from hit_windows(table({df}) partition by (k) order by (at), 'k', 'at', 'hit', 5, 15, 2)", df=df)
    assert sorted(map(tuple, windows.collect())) == [("a", 1.0, 1.0, 4.0), ("a", 2.0, 1.0, 7.0)]
    for d in (found, windows):
        assert "ArrowEvalPythonUDTF" not in spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(d._jdf.queryExecution(), "simple")


SCHEMA = "segment_index long, frame long, x double, note string"


def test_a_filter_opens_only_its_segments(spark, tmp_path):
    segment_files.register(spark)
    path = str(tmp_path / "s")
    rows = [(i % 5, f, f / 2, None if f == 3 else f"é{f}") for i in range(5) for f in range(i, 30)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.repartition(3).write.format("segment_envelopes").mode("append").option("fps", "25").save(path)
    back = segment_files.read(spark, path, SCHEMA)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert sorted(map(tuple, back.select("note", "segment_index").where("segment_index in (1, 2) and frame > 20").collect()), key=str) == sorted(((r[3], r[0]) for r in rows if r[0] in (1, 2) and r[1] > 20), key=str)
    one = next(f for f in sorted(os.listdir(path)) if f.startswith("seg-000003"))
    assert json.loads((tmp_path / "s" / one).read_text())["fps"] == "25"
    assert back.where("segment_index = 1").count() == 29 and back.count() == len(rows)  # a filter holds for its own query
    # a broken file of another segment is not opened
    for f in os.listdir(path):
        if f.startswith("seg-000003"):
            (tmp_path / "s" / f).write_text("{")
    assert back.where("segment_index < 3").count() == sum(r[0] < 3 for r in rows)
    assert back.where("segment_index = 4 and x >= 10").count() == sum(r[0] == 4 and r[2] >= 10 for r in rows)
    with pytest.raises(Exception):  # noqa: B017
        back.count()
    told = back.where("segment_index < 3 and x > 1")._jdf.queryExecution()
    assert "LessThan(segment_index,3)" in spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(told, "formatted").split("PushedFilters")[1].split("\n")[0]


def test_many_segments_are_few_partitions(spark, tmp_path, monkeypatch):
    segment_files.register(spark)
    path = str(tmp_path / "s")
    df = spark.range(600).selectExpr("id segment_index", "1L frame", "id / 2 x", "cast(null as string) note")
    df.write.format("segment_envelopes").mode("overwrite").save(path)
    back = segment_files.read(spark, path, SCHEMA)
    assert back.count() == 600 and len(os.listdir(path)) == 600
    reader = segment_files.Reader(path, back.schema)
    monkeypatch.setattr(segment_files, "BYTES", 1000)
    by_bytes = reader.partitions()
    monkeypatch.setattr(segment_files, "BYTES", 1 << 30)
    assert len(reader.partitions()) == 3 < len(by_bytes) and sum(len(p.files) for p in by_bytes) == 600
    monkeypatch.setattr(segment_files, "HELD", 3)
    writer = segment_files.Writer(path, back.schema, True, {})
    writer.commit([writer.write(iter(df.where("segment_index < 2").unionByName(df.where("segment_index < 3")).collect()))])
    assert len(os.listdir(path)) == 4 and sorted(r.segment_index for r in back.collect()) == [0, 0, 1, 1, 2]


def test_writes_replace_or_leave_all(spark, tmp_path):
    segment_files.register(spark)
    path = str(tmp_path / "s")
    df = spark.createDataFrame([(1, 1, 1.0, "a"), (2, 1, 1.0, "b")], SCHEMA)
    df.write.format("segment_envelopes").mode("overwrite").save(path)
    bad = df.withColumn("x", F.when(F.col("segment_index") == 2, F.raise_error(F.lit("stop")).cast("double")).otherwise(3.0))
    with pytest.raises(Exception, match="stop"):
        bad.repartition(2, "segment_index").write.format("segment_envelopes").mode("overwrite").save(path)
    back = segment_files.read(spark, path, SCHEMA)
    assert sorted(map(tuple, back.collect())) == [(1, 1, 1.0, "a"), (2, 1, 1.0, "b")] and all(f.startswith("seg-") for f in os.listdir(path))
    df.where("segment_index = 2").write.format("segment_envelopes").mode("overwrite").save(path)
    assert [r.note for r in segment_files.read(spark, path, SCHEMA).collect()] == ["b"]
    assert segment_files.read(spark, str(tmp_path / "nothing"), SCHEMA).count() == 0


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_labels_do_not_depend_on_the_batch(spark, batch):
    """Against numpy, window by window."""
    rows = frames(spark, SF)
    by = {(r.seg, r.frame): (r.y, r.label) for r in rows.collect()}
    hits = rows.where("label = 'click'").select("seg", "frame")
    got = {(r.seg, r.frame): (r.label, r.confidence) for r in stages.classify_hits(hits, rows, "seg", "frame", "y", batch=batch).collect()}
    names = ["unknown", *stages.CLASSES]
    want = {}
    for (seg, f), (_, label) in by.items():
        if label == "click":
            window = np.array([by.get((seg, f + d), (0.0, ""))[0] for d in range(-5, 6)])
            z = np.array([sum(window[i] * np.cos(i * (j + 1)) for i in range(11)) / 11 for j in range(len(names))])
            p = np.exp(z - z.max())
            p /= p.sum()
            best = int(p.argmax())
            want[seg, f] = (None if best == 0 else names[best], pytest.approx(p[best]))
    assert got == want
    if batch == 1000:
        assert got.keys() == {(r.seg, r.frame) for r in stage_queries.k07(spark, SF).collect()}
