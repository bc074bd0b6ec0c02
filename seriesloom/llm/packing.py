"""Packing of tokenised documents by a configuration linear program over the length histogram."""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SEQUENCE, END = 1024, 2
#: Words whose ids a Python worker remembers, and bytes of text whose pieces it holds at a time.
REMEMBERED, SLICE = 100_000, 1 << 19
END_OF_TEXT = "<|endoftext|>"


class _Words(dict):
    """Token ids, as little-endian 32-bit numbers, of pieces that a single space begins."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.encode(" " + piece), dtype="<u4").tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        self[piece] = ids
        return ids


class ByteBpe:
    """The ids that the tokenizers library gives for byte_bpe_50k.json without special tokens added.

    The same vocabulary, as ranks, is run by tiktoken. A token never spans a space between two characters that are
    not white space, so the pieces between such spaces are encoded, and remembered, one by one.
    """

    def __init__(self, ranks_path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {END_OF_TEXT: len(ranks)}
        self.bpe = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.words = _Words(self.bpe.encode_ordinary)
        self.uneven = re.compile(r" \s|\s |^ | $")

    def encode(self, text: str) -> bytes:
        if END_OF_TEXT in text:
            return np.array(self.bpe.encode(text, allowed_special="all"), dtype="<u4").tobytes()
        if self.uneven.search(text):
            return np.array(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.bpe.encode_ordinary(first), dtype="<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(path: str | None = None) -> ByteBpe:
    """The worker's tokenizer; path: of the ranks, by default the public package's."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE bytes of text, a row at least."""
    ends, a = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64) + 1), 0
    while a < batch.num_rows:
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SLICE, side="right")))
        yield batch.slice(a, z - a)
        a = z


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32, ids, part and rank.

    A document is its ids and then END. One of more than `size` ids is cut so that every piece but the first has
    `size`. rank numbers the pieces of one length within their partition, part.
    """
    told = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen, end = tokenizer(path), np.zeros(size + 1, dtype=np.int64), np.array([END], dtype="<u4").tobytes()
        for b in (part for whole in batches for part in _parts(whole)):
            rows: list[tuple] = []
            for i, text in enumerate(b.column("text").to_pylist()):
                ids = bpe.encode(text or "") + end
                n = len(ids) // 4
                a, k = 0, 0
                while a < n:
                    z = a + ((n - a) % size or size)
                    own = ids[4 * a : 4 * z]
                    rows.append((i, k, a, z - a, zlib.crc32(own), own, seen[z - a]))
                    seen[z - a] += 1
                    a, k = z, k + 1
            at, k, a, n, crc, ids, rank = zip(*rows, strict=True) if rows else ([],) * 7
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), pa.array(k, pa.int32()), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary()), b.column("part").take(at), pa.array(rank, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "part", "rank"])

    schema = f"doc_id {dict(told.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long, ids binary, part int, rank long"
    return told.mapInArrow(run, schema)


def _values(worth: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each filled length, the most worth that fits in it; a piece of such a configuration, or 0; and the longest length up to it that has a piece."""
    lengths = np.nonzero(worth > 0)[0]
    own = worth[lengths]
    upto = np.searchsorted(lengths, np.arange(size + 1), side="right")
    value, taken = np.zeros(size + 1), np.zeros(size + 1, dtype=np.int64)
    for c in range(1, size + 1):
        value[c], k = value[c - 1], upto[c]
        if k:
            got = value[c - lengths[:k]] + own[:k]
            j = int(got.argmax())
            if got[j] > value[c] + 1e-15:
                value[c], taken[c] = got[j], lengths[j]
    return value, taken, np.maximum.accumulate(np.where(taken > 0, np.arange(size + 1), 0))


def _held(taken: list[int], last: list[int], c: int) -> Counter:
    held = Counter()
    c = last[c]
    while c > 0:
        held[taken[c]] += 1
        c = last[c - taken[c]]
    return held


def price(worth: np.ndarray, size: int = SEQUENCE) -> tuple[float, Counter]:
    """The most valuable configuration: a knapsack by dynamic programming over filled length; worth[l] is a piece's of length l."""
    value, taken, last = _values(worth, size)
    return float(value[size]), _held(taken.tolist(), last.tolist(), size)


def solve(histogram: np.ndarray, size: int = SEQUENCE, rounds: int = 100, step: float = 0.3) -> list[tuple[Counter, float]]:
    """The covering configuration program, nearly: configurations and how often each is used, which covers every length.

    Multiplicative weights: every length has a weight, which falls as configurations cover it. One knapsack a round
    prices, for every length, the best configuration that holds it; from the least covered length on, those that share no
    length are used as often as they can be without covering a length twice over its share. A length without cover is served
    first, so each has some after as many rounds as there are lengths at most, and rounds go on until then.
    """
    need = histogram.astype(float)
    lengths = np.nonzero(need)[0]
    used: dict[tuple, float] = {}
    cover, weight = np.zeros(size + 1), np.zeros(size + 1)
    # begins with a piece's length as its worth
    weight[lengths] = need[lengths] * lengths / size
    low = 0.0
    for i in range(max(rounds, len(lengths)) if len(lengths) else 0):
        if i >= rounds and low:
            break
        worth = np.zeros(size + 1)
        worth[lengths] = weight[lengths] / need[lengths]
        _, *found = _values(worth, size)
        taken, last = (x.tolist() for x in found)
        added, seen = np.zeros(size + 1), np.zeros(size + 1, dtype=bool)
        for m in lengths[np.argsort(cover[lengths] / need[lengths], kind="stable")].tolist():
            if seen[m]:
                continue
            held = _held(taken, last, size - m) + Counter([m])
            if any(seen[n] for n in held):
                continue
            times = min(need[n] / k for n, k in held.items())
            key = tuple(sorted(held.items()))
            used[key] = used.get(key, 0.0) + times
            for n, k in held.items():
                seen[n], added[n] = True, times * k
        cover += added
        weight[lengths] *= np.exp(-step * added[lengths] / need[lengths])
        weight /= weight.max()
        weight[lengths] = np.maximum(weight[lengths], 1e-12)
        low = float((cover[lengths] / need[lengths]).min())
    assert low > 0 or not len(lengths), "a length is without cover"
    return [(Counter(dict(k)), t / low) for k, t in used.items()]


def best_fit(histogram: np.ndarray, size: int = SEQUENCE, begun: Iterable[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest lengths first, a length at a time: bins of equal content are kept as one, with their number; begun: bins that hold pieces already."""
    left = histogram.astype(np.int64)
    bins: dict[tuple[int, ...], int] = {}
    room: dict[int, list[tuple[int, ...]]] = {}

    def add(content: tuple[int, ...], n: int) -> None:
        if content not in bins:
            room.setdefault(size - sum(content), []).append(content)
        bins[content] = bins.get(content, 0) + n

    for content, n in begun:
        add(content, n)
    for m in range(size, 0, -1):
        n = int(left[m])
        while n:
            gap = min((g for g in room if g >= m), default=None)
            if gap is None:
                k = size // m
                if n >= k:
                    add((m,) * k, n // k)
                    n %= k
                else:
                    add((m,) * n, 1)
                    n = 0
                continue
            content = room[gap][-1]
            k = min(gap // m, n)  # into one bin
            into = min(bins[content], n // k)
            bins[content] -= into
            if not bins[content]:
                del bins[content]
                room[gap].pop()
                if not room[gap]:
                    del room[gap]
            add(content + (m,) * k, into)
            n -= k * into
    return [(tuple(sorted(c, reverse=True)), n) for c, n in bins.items()]


def rounded(histogram: np.ndarray, size: int = SEQUENCE, times: int = 2) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Whole numbers of the program's configurations, and the histogram of the pieces that they leave.

    The program's numbers are rounded down, the fullest configurations first and never beyond what is left, so that
    where lengths are covered more than once over it is the emptier ones that go. What they leave is a program again, as often
    as `times` in all, while the last one placed a tenth or more.
    """
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    left[size], full = 0, int(left[size])
    if full:
        out.append(((size,), full))
    for _ in range(times):
        before = int(left.sum())
        if not before:
            break
        for held, share in sorted(solve(left, size), key=lambda x: (-sum(m * k for m, k in x[0].items()), -x[1])):
            n = min(int(share), *(int(left[m]) // k for m, k in held.items()))
            if n > 0:
                out.append((tuple(sorted(held.elements(), reverse=True)), n))
                for m, k in held.items():
                    left[m] -= n * k
        if int(left.sum()) > 0.9 * before:
            break
    return out, left


def plan(histogram: np.ndarray, size: int = SEQUENCE) -> list[tuple[tuple[int, ...], int]]:
    """Configurations (the lengths in a sequence, longest first) and whole numbers of sequences, for exactly the pieces of the histogram.

    What rounding leaves of the program is packed best-fit, into the program's sequences first. The work and the plan grow
    with the number of lengths, not of pieces.
    """
    out, left = rounded(histogram, size)
    return best_fit(left, size, out)


def _slots(planned: list[tuple[tuple[int, ...], int]], size: int) -> list[tuple[int, ...]]:
    """Runs of slots for pieces of a length: m, the length; ranks from first to before stop; the sequence of the first, slots in a sequence, first offset."""
    out: list[tuple[int, ...]] = []
    taken, sequence = [0] * (size + 1), 0
    for content, n in planned:
        at = 0
        for m, k in sorted(Counter(content).items(), reverse=True):
            out.append((m, taken[m], taken[m] + k * n, sequence, k, at))
            taken[m] += k * n
            at += k * m
        sequence += n
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = SEQUENCE, keep_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id and offset.

    Pieces are written once to the shared folder. Their histogram, of `size` rows at most, is what the driver plans
    on. A piece's rank among all of its length is its rank in its partition after the totals of those before, and
    the rank alone tells its sequence and offset, so no pieces are gathered.

    Null text: like the empty one, a piece of one id. Repeated rows are packed each. An empty table gives no rows.
    Other columns are ignored.
    """
    made = pieces(docs, id_col, text_col, path, size)
    rows = cut(made if keep_ids else made.drop("ids"))
    counts = rows.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    histogram = np.zeros(size + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():  # size rows at most
        histogram[r["length"]] = r["count"]
    # a few rows for each configuration, whose number the lengths bound
    slots = rows.sparkSession.createDataFrame(_slots(plan(histogram, size), size), "m long, first_rank long, stop long, number long, k long, at long")
    bound = 250_000  # rows of (part, length)
    counts = F.broadcast(counts) if counts.count() <= bound else counts
    ranked = rows.join(counts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("first")).drop("part", "first")
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("m")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("stop")))
    within = F.col("rank") - F.col("first_rank")
    kept = [c for c in ranked.columns if c != "rank"]
    ordered = ["doc_id", "piece", "start", "length"]
    return placed.select(
        *ordered, *(c for c in kept if c not in ordered),
        (F.col("number") + (within - within % F.col("k")) / F.col("k")).cast("long").alias("sequence_id"), (F.col("at") + within % F.col("k") * F.col("length")).alias("offset"),
    )
