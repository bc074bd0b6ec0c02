"""Mixing sources to target weights: each source's budget is met by a subset sum over its histogram of lengths.

A source takes whole copies of all its documents as often as its budget allows. What is left is shared out over the
lengths in proportion, and what that leaves is met by a bounded knapsack over the documents still free, by length.
Which documents of a length are taken is a matter of a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Weights of sources in their order, repeating; most times that a source may be taken; the seed of the choice.
WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, 11
#: Words that the program over sums leaves to itself; it works on twice as many sums at most.
BUDGET = 1 << 17
#: Of products of sums.
WIDE = "decimal(38,0)"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def weights(sizes: DataFrame, pattern: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sizes (source, total, ...) with weight, by the place of each source in code point order, null last.

    Sources are dealt by ranges of that order and numbered where they lie; the ranges' counts, a row for each, give the rest.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = cut(sizes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + inside - 1
    placed = ranged.join(F.broadcast(before), "part").withColumn("weight", F.element_at(F.array(*map(F.lit, pattern)), (place % len(pattern) + 1).cast("int")).cast("long"))
    return placed.drop("part", "before")


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """sizes (source, total, weight) with target: shares of all words by weight, none above `repeats` times its source's.

    What a source can't take is shared out by weight among the others until none is above. Only sums come to the driver.
    """
    everything = sizes.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    rest, weight, full = everything, None, 0
    while True:
        # a source is full if weight * rest / sum of weights is above its limit
        above = F.lit(False) if weight is None else F.col("weight").cast(WIDE) * F.lit(rest).cast(WIDE) > F.lit(repeats * weight).cast(WIDE) * F.col("total").cast(WIDE)
        one = sizes.select("weight", "total", above.alias("above")).agg(
            F.coalesce(F.sum(F.when(F.col("above"), F.col("total"))), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~F.col("above"), F.col("weight"))), F.lit(0)).alias("weight"),
            F.count_if("above").alias("full"),
        ).first()
        if weight is not None and one["full"] == full:
            break
        rest, weight, full = everything - repeats * one["taken"], one["weight"], one["full"]
    share = F.col("weight").cast("double") * F.lit(float(rest)) / F.lit(float(max(1, weight)))
    return sizes.withColumn("target", F.when(above, (F.col("total") * repeats).cast("double")).otherwise(share))


def nearest_sum(lengths: np.ndarray, counts: np.ndarray, goal: int) -> np.ndarray:
    """How many of each length to take, within counts, so that their sum is as near to goal as any; of two as near, the lower.

    Sums up to twice the goal are enough, as none is as near as 0 beyond it. Counts are cut into powers of two; each sum
    remembers the piece by which it was first reached, so that pieces are followed back without repetition.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    if goal <= 0:
        return take
    reached, by, pieces = np.zeros(2 * goal + 1, dtype=bool), np.full(2 * goal + 1, -1, dtype=np.int64), []
    reached[0] = True
    for i in np.argsort(-lengths, kind="stable"):
        length, k = int(lengths[i]), 1
        left = min(int(counts[i]), 2 * goal // length) if length else 0
        while left and not reached[goal]:
            k = min(k, left)
            step = k * length
            new = np.nonzero(reached[:-step] & ~reached[step:])[0] + step
            reached[new], by[new] = True, len(pieces)
            pieces.append((i, k, step))
            left, k = left - k, 2 * k
        if reached[goal]:
            break
    sums = np.nonzero(reached)[0]
    at = int(sums[np.argmin(np.abs(sums - goal))])
    while at:
        i, k, step = pieces[by[at]]
        take[i] += k
        at -= step
    return take


def shares(lengths: np.ndarray, counts: np.ndarray, goal: int, budget: int = BUDGET) -> np.ndarray:
    """How many documents of each length to take for a sum near goal.

    A goal within the budget is met by nearest_sum() alone. Of a larger one, what is beyond the budget is shared out over
    the lengths in proportion to their counts, rounded down; what that leaves beyond the budget is filled up from the
    longest on; the rest is met by nearest_sum() over the documents still free.
    """
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), dtype=np.int64)
    if goal > budget:
        take = np.array([int(c) * (goal - budget) // total for c in counts], dtype=np.int64)
    rest = goal - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= budget:
            break
        length = int(lengths[i])
        more = min(int(counts[i] - take[i]), -(-(rest - budget) // length), rest // length) if length else 0
        take[i] += more
        rest -= more * length
    free = counts - take
    if rest > budget:  # what is free is longer than the rest: the shortest, if nearer than none
        over = np.nonzero((free > 0) & (lengths > rest) & (lengths < 2 * rest))[0]
        if len(over):
            take[over[np.argmin(lengths[over])]] += 1
        return take
    return take + nearest_sum(lengths, free, rest)


def _planned(lengths: DataFrame) -> DataFrame:
    """lengths (source, size, n, goal) with take. One source's histogram is one group.

    Of a source of w words it has at most sqrt(2 w) rows, as so many different lengths add up to w.
    """

    def plan(own: pd.DataFrame) -> pd.DataFrame:
        return own.assign(take=shares(own["size"].to_numpy(), own["n"].to_numpy(), int(own["goal"].iloc[0])))

    return lengths.groupBy("source").applyInPandas(plan, f"source {dict(lengths.dtypes)['source']}, size long, n long, goal long, take long")


def mix(docs: DataFrame, pattern: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies times size) of every row of docs.

    A document's size is its number of words. Its source's target is met by whole copies of the source and a subset of it
    that is chosen by length: `take` documents of each, those of least seeded hash of the id.

    Only (id, source, size, hash) is moved. Documents of one source and length are dealt by ranges of their hash, about
    as many as each holds, so the last one to be taken is found by counts and by ranking one range.

    Null texts, and those of white space, have size 0 and take 0. Null sources are one source. Null ids count as an
    empty text, and rows repeated with an id are documents of their own: of those with equal hashes as many are taken as
    the count asks, and it shows in no value which. An empty table gives no rows. Other columns are ignored, whatever
    their names.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("h"),
    )
    rows = cut(rows)
    lengths = cut(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    total = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("total"))
    plans = targets(cut(weights(total, pattern)), repeats)
    copies = F.when(F.col("total") == 0, 0).otherwise(F.least(F.floor(F.col("target") / F.col("total")), F.lit(repeats))).cast("long")
    plans = plans.withColumn("whole", copies).withColumn("goal", F.round(F.col("target") - F.col("whole") * F.col("total")).cast("long"))
    plans = cut(plans.select("source", "total", "target", "whole", "goal"))
    take = _planned(_with(lengths, plans.select("source", "goal")))
    # ranges of the hash: about the square root of a group's documents
    fine = F.ceil(F.log2("n") / 2).cast("int")
    take = cut(take.withColumn("fine", fine))
    split = _with(rows, take, ["source", "size"]).withColumn("range", F.when(F.col("fine") > 0, F.expr("shiftrightunsigned(h, 64 - fine)")).otherwise(F.lit(0).cast("long")))
    asked = split.where("take > 0 and take < n").groupBy("source", "size", "range").agg(F.count("*").alias("m"), F.first("take").alias("take"))
    upto = F.sum("m").over(Window.partitionBy("source", "size").orderBy("range"))
    last = cut(asked.withColumn("upto", upto).where("upto >= take and upto - m < take").select("source", "size", F.col("range").alias("last"), (F.col("take") - F.col("upto") + F.col("m")).alias("still")))
    found = _with(split, last, ["source", "size"], "left")
    sure = found.where("last is null or range <> last").withColumn("extra", F.when(F.col("last").isNull(), F.col("take") >= F.col("n")).otherwise(F.col("range") < F.col("last")) & (F.col("take") > 0))
    rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("h", "doc_id"))
    edge = found.where("range = last").withColumn("extra", rank <= F.col("still"))
    names = ["doc_id", "source", "size", "extra"]
    both = _with(sure.select(names).unionByName(edge.select(names)), plans)
    times = F.when(F.col("size") > 0, F.col("whole") + F.col("extra").cast("long")).otherwise(0)
    return both.select("doc_id", "source", "size", F.col("total").alias("source_size"), "target", times.alias("copies"), (times * F.col("size")).alias("taken"))


def _with(rows: DataFrame, facts: DataFrame, keys: list[str] | None = None, how: str = "inner") -> DataFrame:
    """rows with the columns of facts by keys, where nulls are equal; facts are broadcast only if they are few."""
    keys = keys or ["source"]
    renamed = facts.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [rows[k].eqNullSafe(renamed[f"_{k}"]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return rows.join(small(renamed), condition, how).drop(*(f"_{k}" for k in keys))
