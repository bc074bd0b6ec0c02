"""Parquet caches with a fingerprint: kept while the settings they were made with are the same, and resumed by segment."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def fingerprint(**settings: object) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Cache:
    """A table under a folder that names its fingerprint, partitioned by a column. Other fingerprints' folders are not read."""

    def __init__(self, spark: SparkSession, root: str, partition: str, **settings: object) -> None:
        self.spark, self.partition = spark, partition
        self.path = f"{root}/{fingerprint(**settings)}"

    def read(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def missing(self, keys: DataFrame) -> DataFrame:
        """The keys that are not cached yet."""
        found = self.read()
        return keys if found is None else keys.join(found.select(self.partition).distinct(), self.partition, "left_anti")

    def add(self, df: DataFrame) -> None:
        """Writes partitions, each replaced as a whole, so that a repeated run leaves one copy."""
        writer = df.write.mode("overwrite").partitionBy(self.partition)
        writer.option("partitionOverwriteMode", "dynamic").parquet(self.path)


def two_phases(cache: Cache, rows: DataFrame, scan: Callable[[DataFrame], DataFrame], decide: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """decide() on the cache, after scan() of those partitions' rows that are not cached yet. Other decisions need no new scan."""
    missing = cache.missing(rows.select(cache.partition).distinct())
    if not missing.isEmpty():
        cache.add(scan(rows.join(missing, cache.partition, "left_semi")))
    return decide(cache.read())


def sparse_pixels(df: DataFrame, value: str = "v", least: int = 10) -> DataFrame:
    """Drops pixels too dark to count."""
    return df.where(F.col(value) >= least)
