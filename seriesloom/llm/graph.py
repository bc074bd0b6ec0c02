"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """id and component (its least id) of every id in edges (a, b); raises if they don't settle in so many rounds.

    Each round's edges are written to the shared folder. Neighbours are never gathered: a star takes a minimum by id, with
    partial minima first, and a join that splits hot ids. Of at most BROADCAST_ROWS edges the minima are broadcast, as there
    are no more of them, so that the edges are not dealt anew to meet them.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen, edges_now = None, e.count()
    for _ in range(rounds):
        held = F.broadcast if edges_now <= BROADCAST_ROWS // 2 else (lambda df: df)
        # large star: neighbours above go to the least of all
        both = e.union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(held(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: an id and its neighbours below go to the least of these
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(held(low), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        seen, edges_now = now, now[0]
    raise RuntimeError("components did not settle")
