"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The events of a user as one series: seg, frame (from 1), y, x and label; labels stand for sides.
FRAMES = """fr as (select user_id seg, row_number() over (partition by user_id order by ts, event_id) frame, event_id, ts,
  value y, cast(json_extract_string(props, '$.k') as double) x, event_type label,
  case when event_type in ('click', 'view') then 'top' when event_type in ('purchase', 'signup') then 'bottom' end side from events)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    label = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seg"), F.row_number().over(w).cast("long").alias("frame"), "event_id", "ts", F.col("value").alias("y"),
        F.get_json_object("props", "$.k").cast("double").alias("x"), label.alias("label"),
        F.when(label.isin("click", "view"), "top").when(label.isin("purchase", "signup"), "bottom").alias("side"),
    )


def r4(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4)
