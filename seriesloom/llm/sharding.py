"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bytes that each document takes besides its text.
OVERHEAD = 16


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's number and first byte within its partition."""
    rows = size = 0
    for b in batches:
        own = b.column("size").to_numpy()
        ends = np.cumsum(own)
        yield b.append_column("row_in", pa.array(rows + np.arange(b.num_rows, dtype=np.int64))).append_column(
            "byte_in", pa.array(size + ends - own)
        )
        rows, size = rows + b.num_rows, size + int(ends[-1]) if b.num_rows else size


def shard_by_bytes(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Puts documents, in the order of their ids, into contiguous shards of near-equal bytes.

    Only (id, size, crc32) is sorted, by range; the texts are not moved. A range's rows are numbered
    and summed where they lie, the ranges' totals give each its first byte, and a document goes to
    the shard in whose equal share of all bytes its middle lies.

    Null text: 0 bytes, crc32 of nothing. Repeated rows and null ids are rows of their own, nulls
    first; ties in id go by crc32 and size. An empty table gives no rows. Other columns of docs are
    ignored, whatever their names.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(data).cast("long") + OVERHEAD).alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    order = ["doc_id", "text_crc32", "size"]
    ranged = sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = f"doc_id {dict(sized.dtypes)['doc_id']}, size long, text_crc32 long, part int, row_in long, byte_in long"
    rows = cut(ranged.mapInArrow(_running, schema))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    parts = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.count("*").alias("part_rows"))
    parts = parts.select(
        "part",
        F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("first_byte"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("first_row"),
        F.sum("part_size").over(Window.partitionBy()).alias("total"),
    )
    middle = F.expr(f"(2 * (first_byte + byte_in) + size) * {shards} div (2 * total)")
    placed = rows.join(F.broadcast(parts), "part").select(
        "doc_id", "size", "text_crc32",
        F.least(middle, F.lit(shards - 1)).cast("int").alias("shard"),
        (F.col("first_row") + F.col("row_in")).alias("row"),
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("shard_row"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("shard_row")).alias("slot")
    )
