"""Ranked lexical search with hashed max-sketches.

A document's sketch has a number of coordinates; a term's hash names one, and a coordinate holds the largest impact of
the document's terms there. So a query's terms, looked up in the sketch and weighted, add up to no less than the
document's score. Documents are scored by their terms from the highest of these bounds on, until the next bound is under
the least score of those found so far.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import word_hashes, word_table

#: Documents returned for an item; coordinates of a sketch, a power of two; documents scored before the threshold is looked at again.
TOP, COORDINATES, STEP = 50, 4096, 64
#: Bytes of item texts that one pass over the documents serves; bytes of text hashed at a time; documents of a block.
BATCH_BYTES, PIECE, BLOCK = 256 << 10, 1 << 20, 512
#: Parts that an item's documents are dealt over before they are ranked together.
SALTS = 32
# Bytes that separate terms, all ASCII but digits and letters.
WORDS = word_table([*range(48), *range(58, 65), *range(91, 97), *range(123, 128)])
SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _pieces(data: bytes) -> Iterator[bytes]:
    """data, cut at separators into pieces of PIECE bytes or as much longer as a term is."""
    a = 0
    while len(data) - a > PIECE:
        m = SEPARATOR.search(data, a + PIECE)
        z = m.start() if m else len(data)
        yield data[a:z]
        a = z
    yield data[a:]


def _distinct(owner: np.ndarray, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (owner, term) with their summed times."""
    order = np.lexsort((term, owner))
    owner, term, times = owner[order], term[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])])) if len(owner) else np.zeros(0, dtype=np.int64)
    return owner[new], term[new], np.add.reduceat(times, new) if len(new) else times


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of each text: its place, the term's 64-bit hash and how often it occurs; sorted by place and hash."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        data = np.frombuffer(b"\n".join([*(x for _, x in held), b""]), dtype=np.uint8)
        start = np.cumsum([0] + [len(x) + 1 for _, x in held])
        term, of, _, _ = word_hashes(data, start, WORDS)
        found.append(_distinct(np.array([i for i, _ in held], dtype=np.int64)[of], term, np.ones(len(term), dtype=np.int64)))
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        for piece in _pieces((t or "").encode()):
            held.append((i, piece))
            size += len(piece)
            if size >= PIECE:
                flush()
                size = 0
    if held:
        flush()
    if len(found) == 1:
        return found[0]
    return _distinct(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


@dataclass
class Batch:
    """ids of items; terms, the sorted hashes of their terms; of each item (first and count) the places of its terms."""

    ids: list
    terms: np.ndarray
    first: np.ndarray
    count: np.ndarray
    places: np.ndarray


def batch(ids: list, texts: list[str]) -> Batch:
    owner, term, _ = counted(texts)
    terms = np.unique(term)
    count = np.bincount(owner, minlength=len(ids))
    return Batch(ids, terms, np.cumsum(count) - count, count, np.searchsorted(terms, term))


def _places(terms: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each term in the sorted asked ones, -1 if it isn't there."""
    if not len(asked):
        return np.full(len(terms), -1)
    at = np.minimum(np.searchsorted(asked, terms), len(asked) - 1)
    return np.where(asked[at] == terms, at, -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """ids and texts of some documents: BLOCK at most, and texts of about PIECE bytes."""
    for b in batches:
        ends = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy())
        a = 0
        while a < b.num_rows:
            z = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, side="right"))
            z = min(max(z, a + 1), a + BLOCK)
            yield b.column("doc_id")[a:z], b.column("text")[a:z].to_pylist()
            a = z


@dataclass
class Statistics:
    """docs, with a term at least; terms in all of them; for each asked term how many documents hold it."""

    docs: int
    terms: int
    holding: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.docs + 2) / (2 * int(d) + 1))) for d in self.holding], dtype=np.int64)


def statistics(docs: DataFrame, asked: np.ndarray) -> Statistics:
    """Counts over all documents (text). Each task counts for itself; a row for each asked term comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, holding = 0, 0, np.zeros(len(asked), dtype=np.int64)
        for _, texts in _blocks(batches):
            owner, term, times = counted(texts)
            n, total = n + len(np.unique(owner)), total + int(times.sum())
            at = _places(term, asked)
            holding += np.bincount(at[at >= 0], minlength=len(asked))
        some = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], some])), pa.array(np.concatenate([[n, total], holding[some]]).astype(np.int64))], ["place", "n"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    got = {r["place"]: r["n"] for r in rows}
    return Statistics(got.get(-2, 0), got.get(-1, 0), np.array([got.get(i, 0) for i in range(len(asked))], dtype=np.int64))


def impacts(owner: np.ndarray, times: np.ndarray, known: Statistics, rows: int) -> np.ndarray:
    """What each term adds to a score, for a weight of 1: more for more occurrences, less in a long document."""
    n = np.bincount(owner, times, minlength=rows).astype(np.int64)
    m = np.array([50 + 50 * int(x) * known.docs // max(1, known.terms) for x in n], dtype=np.int64)
    return 1_000_000_000 * times // (1000 * times + 20 * m[owner])


def sketches(owner: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int) -> np.ndarray:
    """The largest impact at each coordinate of each of so many documents."""
    out = np.zeros(rows * COORDINATES)
    at = owner * COORDINATES + (term >> np.uint64(64 - COORDINATES.bit_length() + 1)).astype(np.int64)
    if len(at):
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[new]] = np.maximum.reduceat(impact, new)
    return out.reshape(rows, COORDINATES)


def lookups(items: Batch, weights: np.ndarray) -> np.ndarray:
    """For each coordinate and item, the weights of the item's terms there. All sums with it are whole numbers below 2 ** 53."""
    out = np.zeros((COORDINATES, len(items.ids)))
    of = np.repeat(np.arange(len(items.ids)), items.count)
    at = (items.terms >> np.uint64(64 - COORDINATES.bit_length() + 1)).astype(np.int64)
    np.add.at(out, (at[items.places], of), weights[items.places])
    return out


class _Best:
    """The k best documents of an item so far, equal scores by id with null last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows, self.least = k, None, 1

    def add(self, ids: pa.Array, scores: np.ndarray) -> None:
        own = pa.table({"doc_id": ids, "score": pa.array(scores)})
        own = own if self.rows is None else pa.concat_tables([self.rows, own])
        self.rows = own.sort_by([("score", "descending"), ("doc_id", "ascending")]).slice(0, self.k).combine_chunks()
        if self.rows.num_rows == self.k:
            self.least = max(1, self.rows.column("score")[-1].as_py())


def _scored(docs: DataFrame, items: Batch, known: Statistics, top: int) -> DataFrame:
    """item (its place in the batch), doc_id and score: of each task the best documents of each item."""
    weight = known.weights()
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, table, width = [_Best(top) for _ in items.ids], lookups(items, weight), max(1, len(items.terms))
        for ids, texts in _blocks(batches):
            owner, term, times = counted(texts)
            impact = impacts(owner, times, known, len(texts))
            upper = sketches(owner, term, impact, len(texts)) @ table
            at = _places(term, items.terms)
            key, own = owner[at >= 0] * width + at[at >= 0], impact[at >= 0]  # sorted, as terms are
            least = np.array([b.least for b in best], dtype=float)
            for i in np.flatnonzero((upper >= least).any(axis=0)):
                places = items.places[items.first[i] : items.first[i] + items.count[i]]
                maybe = np.flatnonzero(upper[:, i] >= best[i].least)
                maybe = maybe[np.argsort(-upper[maybe, i], kind="stable")]
                for a in range(0, len(maybe), STEP):
                    rows = maybe[a : a + STEP]
                    rows = rows[upper[rows, i] >= best[i].least]
                    if not len(rows):
                        break
                    score = _exact(key, own, rows, places, weight[places], width)
                    good = np.flatnonzero(score >= best[i].least)
                    if len(good):
                        best[i].add(ids.take(pa.array(rows[good])), score[good])
        for i, b in enumerate(best):
            if b.rows is not None:
                n = b.rows.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i)), *(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in b.rows.columns)], ["item", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"item long, doc_id {kind}, score long")


def _exact(key: np.ndarray, impact: np.ndarray, rows: np.ndarray, places: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
    """The scores of documents for the terms at some places."""
    if not len(key):
        return np.zeros(len(rows), dtype=np.int64)
    want = rows[:, None] * width + places
    at = np.minimum(np.searchsorted(key, want), len(key) - 1)
    return (np.where(key[at] == want, impact[at], 0) * weight).sum(axis=1)


def _best_of(found: DataFrame, by: list[str], top: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the `top` documents of each item with the highest scores above 0.

    Items are served in batches of about BATCH_BYTES of text, dealt by a hash of their ids: a batch's terms go to all
    tasks, whatever the number of items, and cost two passes over the documents, one that counts and one that scores. A task
    sends its best documents of each item; these are ranked within SALTS parts of an item, then together.

    Null and empty texts, and those without a term, are in no count and no result. Rows with a null id are ranked after
    others of equal score; rows repeated with an id are documents each. Items with a null id are left out, items that
    share an id are one, items without terms have no rows. Empty tables give none. Terms are told apart by 64-bit hashes.
    Other columns are ignored, whatever their names.
    """
    told = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // BATCH_BYTES))
    kind = dict(asked.dtypes)["item_id"]
    out = None
    for p in range(passes):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).groupBy("item_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list("text"))).alias("text"))
        rows = own.orderBy("item_id").collect()  # a batch
        if not rows:
            continue
        queries = batch([r["item_id"] for r in rows], [r["text"] for r in rows])
        found = _scored(told, queries, statistics(told, queries.terms), top)
        found = _best_of(found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), ["item", "salt"], top).drop("rank")
        found = _best_of(found, ["item"], top)
        names = docs.sparkSession.createDataFrame(list(enumerate(queries.ids)), f"item long, item_id {kind}")
        found = found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id {dict(told.dtypes)['doc_id']}, score long")
    return out
