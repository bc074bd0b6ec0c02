"""Tables written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place below spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own; on a cluster this raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="seriesloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/seriesloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written and read again: it is computed once, however often it is used, and survives lost executors."""
    path = shared_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def few(df: DataFrame, most: int = 64 << 20) -> DataFrame:
    """df, a table that was written, marked for broadcast if a row's width times its rows is at most so many bytes; else it is joined by a shuffle."""
    width = sum(8 if t in ("bigint", "double", "int", "boolean") else 128 for _, t in df.dtypes)
    return F.broadcast(df) if df.limit(most // width + 1).count() <= most // width else df
