"""Reading tables, cutting lineage and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, a local master gets a folder of its own; on a cluster this raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="seriesloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def sweep(spark: SparkSession) -> None:
    """Deletes all tables that cut() wrote below spark.checkpoint.dir; results that were not read or written yet are lost with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/seriesloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables written in the scratch() that is open, if one is.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def cut(df: DataFrame, keep: bool = False) -> DataFrame:
    """Writes df to the shared folder and rereads it, so that what follows survives lost executors
    and is not computed twice. Within scratch() the table goes at its end, unless it is to be kept."""
    path = f"{shared_dir(df.sparkSession)}/seriesloom/{uuid.uuid4().hex}"
    if not keep and (open_ := _scratch.get()) is not None:
        open_.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the tables that cut() wrote meanwhile. What is used later must be written with keep before that."""
    token = _scratch.set([])
    try:
        yield
    finally:
        paths = _scratch.get()
        _scratch.reset(token)
        for p in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most that many rows; df is best a table that was cut."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_crc(col: Column) -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))
