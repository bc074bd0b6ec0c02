"""Benchmark decontamination with n-gram windows, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

WINDOW = 13
#: A word character: a digit, a small letter or anything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, n: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The distinct windows of all items: their words, hash, length and the ids of the items that have them."""
    split = benchmark.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")
    )
    at = split.where(F.size("w") > 0).select(
        "item", "w", F.least(F.size("w"), F.lit(n)).alias("len"),
        F.explode(F.expr(f"sequence(1, greatest(size(w) - {n} + 1, 1))")).alias("i"),
    )
    return (
        at.select("item", "len", F.expr("slice(w, i, len)").alias("win"))
        .groupBy("win", "len")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("h", F.xxhash64("win"))
    )


#: Item windows that may be broadcast; more are joined by a shuffle of places and hashes.
BROADCAST_WINDOWS = 200_000


def contamination(
    docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of docs: rid, id, n_words, spans [(pos, len)] of hit windows, items.

    The windows of a document are hashed one by one as they are generated and looked up in the set of
    item windows, which is broadcast if it is small by count; equal hashes are verified word for word. Documents pass
    through one shuffle, of hits only. A larger set is joined by a shuffle of hashes and places alone, and only documents
    with equal hashes meet their words again.

    Null or empty text: no words and no hits. Items with null ids or no words have no windows. Repeated
    documents each get a row; repeated items count once. Other columns are ignored.
    """
    wins = cut(item_windows(benchmark, n))
    lengths = sorted(r["len"] for r in wins.select("len").distinct().collect()) or [n]  # at most n of them
    few = wins.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    wins = wins.select("h", F.col("len").alias("win_len"), "win", "items")
    told = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # a row is found again by rid: with a shuffle between, its number must not be counted twice
    told = told if few else cut(told)
    split = told.select("rid", "doc_id", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    # pos -1 keeps a row for every document; sequences may not run downwards
    at = split.select("*", F.explode(F.expr(f"sequence(-1, greatest(n_words - {lengths[0]}, -1))")).alias("pos"))
    if len(lengths) == 1:
        at = at.withColumn("len", F.lit(lengths[0]))
    else:
        at = at.withColumn("len", F.explode(F.array(*map(F.lit, lengths))))
        at = at.where(f"(pos < 0 and len = {lengths[0]}) or (pos >= 0 and pos + len <= n_words)")
    window = F.expr("slice(w, cast(greatest(pos, 0) as int) + 1, len)")
    if not few:
        return _found_again(told, at.where("pos >= 0").select("rid", "pos", "len", F.xxhash64(window).alias("h")), wins)
    hashed = at.withColumn("h", F.when(F.col("pos") >= 0, F.xxhash64(window)))
    wins = F.broadcast(wins)
    same = (hashed["h"] == wins["h"]) & (window == F.col("win"))
    hits = hashed.join(wins, same, "left").where("pos < 0 or win is not null")
    found = F.when(F.col("win").isNotNull(), F.struct(F.col("pos").cast("long").alias("pos"), F.col("win_len").cast("long").alias("len")))
    return hits.groupBy("rid", "doc_id", "n_words").agg(
        F.array_sort(F.collect_list(found)).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def _found_again(told: DataFrame, places: DataFrame, wins: DataFrame) -> DataFrame:
    """contamination() by a shuffle of places (rid, pos, len, h): those with an item's hash meet their document's words."""
    maybe = places.join(wins, (places["h"] == wins["h"]) & (places["len"] == wins["win_len"]))
    maybe = maybe.groupBy("rid").agg(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("len").cast("long").alias("len"), "win", "items")).alias("maybe"))

    def judged(w: Column) -> Column:
        hit = F.filter("maybe", lambda x: F.slice(w, (x["pos"] + 1).cast("int"), x["len"].cast("int")) == x["win"])
        return F.struct(F.size(w).cast("long").alias("n_words"), F.coalesce(hit, F.array().cast(dict(maybe.dtypes)["maybe"])).alias("hit"))

    # the words are made once for a row, as the variable of a lambda
    one = told.join(maybe, "rid", "left").select("rid", "doc_id", F.element_at(F.transform(F.array(words(F.col("text"))), judged), 1).alias("x"))
    return one.select(
        "rid", "doc_id", "x.n_words", F.array_sort(F.transform("x.hit", lambda x: F.struct(x["pos"].alias("pos"), x["len"].alias("len")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("x.hit", lambda x: x["items"])))).alias("items"),
    )


def verdicts(found: DataFrame, share: int = 20) -> DataFrame:
    """Counts the words that lie in hit windows; contaminated: a word in `share` at least is hit."""
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["pos"] + s["len"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["pos"] + s["len"] - F.greatest(a["end"], s["pos"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    return found.withColumn("n_hit", covered).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    )
