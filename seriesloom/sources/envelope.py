"""JSON envelopes: one object with a list of records under a key, and metadata beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo


def read_records(spark: SparkSession, path: str, key: str, schema: T.StructType, index: str | None = None, meta: dict[str, T.DataType] | None = None) -> DataFrame:
    """Records of envelopes (a file, folder or glob), with their place in the list as column `index` and metadata columns.

    Raises ValueError if an envelope has no such list; a file that isn't JSON fails the read.
    """
    extra = [T.StructField(k, v) for k, v in (meta or {}).items()]
    whole = T.StructType([T.StructField(key, T.ArrayType(schema)), *extra])
    rows = spark.read.schema(whole).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if not rows.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{path}: no list of records under {key!r}")
    out = rows.select(*(meta or {}), F.posexplode(key).alias("_i", "_r"))
    return out.select(*([F.col("_i").cast("long").alias(index)] if index else []), "_r.*", *(meta or {}))


def read_segments(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Segments with segment_index and fps; raises ValueError if there are none or fps is missing."""
    rows = read_records(spark, path, "segments", schema, "segment_index", {"fps": T.DoubleType()})
    one = rows.select("fps").first()
    if one is None or one["fps"] is None:
        raise ValueError(f"{path}: no segments, or no fps")
    return rows


def write_records(df: DataFrame, path: str, key: str, order: list[str], most: int = 1_000_000, **meta: object) -> None:
    """Writes a small table as one envelope, in a folder of one file; raises ValueError beyond `most` rows, which belong in Parquet.

    A task writes it, so any store that Spark knows can hold it.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"over {most} records")
    rest = [c for c in df.columns if c not in order]
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(F.lit(0).alias("_"), *rest).alias("_r")))).alias("_a"))
    fields = [F.col(f"_a.{c}") for c in order], [F.col(f"_a._r.{c}") for c in rest]
    records = F.arrays_zip(*(f.alias(c) for f, c in zip([*fields[0], *fields[1]], [*order, *rest], strict=True)))
    rows.select(records.alias(key), *(F.lit(v).alias(k) for k, v in meta.items())).coalesce(1).write.mode("overwrite").json(path)


def read_court(spark: SparkSession, path: str) -> DataFrame:
    """One row with the first court's homography (court to image) and its inverse, image_to_court; raises ValueError if there is no court or it is singular."""
    rows = read_records(spark, path, "courts", T.StructType.fromDDL("homography array<array<double>>"), "_i").where("_i = 0")
    back = geo.inverse(geo.matrix(F.col("homography")))
    rows = rows.select("homography", F.array(*(F.array(*r) for r in back)).alias("image_to_court"))
    one = rows.first()
    if one is None or any(v is None for r in one["image_to_court"] for v in r):
        raise ValueError(f"{path}: no court, or one without an inverse")
    return rows


def parsed_segments(df: DataFrame) -> DataFrame:
    """Segments given as texts (start_sec, end_sec, duration_sec): those that can be read and end after they start; a missing duration is the difference."""
    a, z = F.col("start_sec").try_cast("double"), F.col("end_sec").try_cast("double")
    rows = df.select("segment_index", a.alias("start_sec"), z.alias("end_sec"), F.col("duration_sec").try_cast("double").alias("duration_sec"))
    rows = rows.where("start_sec is not null and end_sec > start_sec")
    return rows.withColumn("duration_sec", F.coalesce("duration_sec", F.col("end_sec") - F.col("start_sec")))


def known_scores(rallies: DataFrame | None) -> DataFrame | None:
    """segment_index and score (a struct, null unless both are known); None where there is no table, which skips rules that need it."""
    if rallies is None or rallies.isEmpty():
        return None
    both = F.col("score_a").isNotNull() & F.col("score_b").isNotNull()
    return rallies.select("segment_index", F.when(both, F.struct(F.col("score_a").alias("a"), F.col("score_b").alias("b"))).alias("score"))


def write_dense_csv(df: DataFrame, spine: DataFrame, on: list[str], partition: str, path: str, formats: dict[str, str]) -> None:
    """One folder of CSV for each value of `partition`, with a row for every row of the spine; missing values are empty cells."""
    rows = spine.join(df, on, "left")
    cells = [F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c))).alias(c) for c, f in formats.items()]
    rows = rows.select(*on, *cells).repartition(partition).sortWithinPartitions(*on)
    rows.write.mode("overwrite").partitionBy(partition).option("header", True).option("emptyValue", "").csv(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points x;y."""
    return spark.read.schema("x double, y double").option("sep", ";").csv(path)
