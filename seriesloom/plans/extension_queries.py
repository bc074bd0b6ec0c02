"""Queries through Spark's extension points: table functions in SQL, a data source of our own, and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import scans
from ..sources import segment_files
from ..sources.shared import shared_path
from .registry import FRAMES, SQL, frames, query, r4, table


@query("M01_label_runs_by_sql", SQL["F02_label_runs"])
def m01(spark, sf):
    tables.register(spark)
    rows = frames(spark, sf).select("seg", "frame", "y", F.when(F.col("label") != "error", F.col("label")).alias("label"))
    found = spark.sql("select * from label_runs(table({rows}) partition by (seg) order by (frame), 'seg', 'frame', 'label', 'y', 1) where n >= 2 and peak >= 20", rows=rows)
    return found.withColumnRenamed("key", "seg").withColumns({c: r4(c) for c in ("mean_conf", "center")})


@query("M02_hit_windows_by_sql", SQL["F17_between_hits_windows"])
def m02(spark, sf):
    tables.register(spark)
    rows = frames(spark, sf).where("label = 'click'").select("seg", "frame", F.lit(True).alias("hit"))
    found = spark.sql("select * from hit_windows(table({rows}) partition by (seg) order by (frame), 'seg', 'frame', 'hit', 5, 15, 2)", rows=rows)
    return found.withColumnRenamed("key", "seg")


@query("M03_segment_source", f"with {FRAMES} select seg segment_index, frame, x, y, label, case when seg < 75 then 'first' else 'second' end part from fr where y > 20")
def m03(spark, sf):
    segment_files.register(spark)
    path = shared_path(spark, "segments")
    rows = frames(spark, sf).select(F.col("seg").alias("segment_index"), "frame", "x", "y", "label")
    rows.repartition("segment_index").sortWithinPartitions("segment_index").write.format("segment_envelopes").mode("overwrite").option("fps", "25").save(path)
    # each half opens its own segments' files alone
    half = lambda condition, name: segment_files.read(spark, path, rows.schema).where(f"segment_index {condition} 75 and y > 20").withColumn("part", F.lit(name))
    return half("<", "first").unionByName(half(">=", "second"))


@query(
    "S01_weighted_rates",
    """with recursive e as (select user_id k, epoch_us(ts) / 1e6 t, max(cast(json_extract_string(props, '$.k') as double) + value) v from events group by all),
h as (select *, max(v) over (partition by k order by t rows between unbounded preceding and 1 preceding) high from e),
s as (select *, row_number() over (partition by k order by t) i from (select k, t, v, high, lag(t) over (partition by k order by t) p from h where high is null or v > high) where high is not null),
w as (select k, i, t, (v - high) / (t - p) rate, (v - high) / (t - p) smoothed from s where i = 1
union all select s.k, s.i, s.t, (v - high) / (s.t - p), 0.4 * (v - high) / (s.t - p) + 0.6 * smoothed from w join s on s.k = w.k and s.i = w.i + 1)
select k seg, round(t, 3) t, round(rate * 3600, 6) per_hour, round(smoothed * 3600, 6) smoothed from w""",
)
def s01(spark, sf):
    value = F.get_json_object("props", "$.k").cast("double") + F.col("value")
    rows = table(spark, sf, "events").select(F.col("user_id").alias("seg"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), value.alias("v"))
    found = scans.weighted(scans.rates(rows, "seg", "t", "v", 86_400.0), "seg", "t", "rate", 0.4, 86_400.0 * 3)
    hour = lambda c: F.round(F.col(c) * 3600, 6)
    return found.select("seg", F.round("t", 3).alias("t"), hour("rate").alias("per_hour"), hour("smoothed").alias("smoothed"))
