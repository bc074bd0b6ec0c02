"""Removal of repeated byte strings: names by prefix doubling within tasks, anchors and stretches grouped by Spark.

This is not the distributed prefix doubling of all positions, which would shuffle many times the input (see README). A
position's name at length k is a 64-bit hash of its next k bytes, doubled locally (1, 2, 4, ... bytes, each from the
pair at p and p + k); equal names count as equal bytes. Spark groups by them what is left of the positions at three lengths:

1. Every 200-byte string has one anchor, the position in it whose 64-byte rank is least, so equal strings have theirs at
   the same place. Only anchors, about one position in 70, are ranked; an anchor unique at 64 bytes is done with.
2. The strings of one anchor lie side by side in a stretch of up to 336 bytes. Stretches are ranked by pairs of
   128-byte names; all strings in a stretch that occurs again are repeated.
3. Where stretches of one anchor differ, their 200-byte strings are ranked one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .hashing import mix

LENGTH, ANCHOR = 200, 64
#: Positions at which a string's anchor may be, and bytes ranked at a time.
PLACES, CHUNK = LENGTH - ANCHOR + 1, 2 << 20
#: Rows that may be broadcast; stretches of one anchor that a task compares by itself.
BROADCAST, LOCAL = 1_000_000, 1024

_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of all strings of 64 and of 128 bytes."""
    h, k, at64 = _BYTE[data], 1, np.zeros(0, dtype=np.uint64)
    for step in _STEP:
        if k == ANCHOR:
            at64 = h
        if k == 2 * ANCHOR:
            break
        if len(h) <= k:
            return (h if k == ANCHOR else at64), h[:0]
        x = h[:-k]
        h = (x ^ (x >> np.uint64(31))) * step + h[k:]
        k *= 2
    return at64, h


def anchors(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """The anchors of all strings in joined texts: text, 64-byte name, place p, and first and last string (lo, hi); and the 128-byte names."""
    none = np.zeros(0, dtype=np.int64)
    h64, h128 = names(data)
    n = len(data) - LENGTH + 1
    if n < 1:
        return none, none.astype(np.uint64), none, none, none, h128
    bits = np.uint64(max(24, len(data).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = (mix(h64) & ~low) | np.arange(len(h64), dtype=np.uint64)
    k = 1
    while 2 * k <= PLACES:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    least = np.minimum(least[: n], least[PLACES - k : PLACES - k + n])  # of PLACES positions
    place = (least & low).astype(np.int64)
    of = np.repeat(np.arange(len(start)), length)[:n]
    valid = np.arange(n) <= (start + length)[of] - LENGTH
    s = np.nonzero(valid)[0]
    if not len(s):
        return none, none.astype(np.uint64), none, none, none, h128
    new = np.concatenate([[True], (place[s[1:]] != place[s[:-1]]) | (of[s[1:]] != of[s[:-1]])])
    lo = s[new]
    hi = s[np.append(np.nonzero(new)[0][1:] - 1, len(s) - 1)]
    p = place[lo]
    return of[lo], mix(h64[p]), p, lo, hi, h128


def stretch_names(h128: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The name of each stretch, of its bytes and where its anchor is: three overlapping strings of 128 bytes cover it."""
    last = hi + LENGTH - 2 * ANCHOR
    x = mix(h128[lo] + np.uint64(1))
    x = mix(x + h128[np.minimum(lo + 104, last)])
    x = mix(x + h128[last])
    return mix(x + ((p - lo) << 16 | (hi - lo)).astype(np.uint64))


def window_names(data: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two names of each of the `count` 200-byte strings that begin at `first` and after."""
    _, h128 = names(data)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - first, count)
    a, b = h128[at], h128[at + LENGTH - 2 * ANCHOR]
    return mix(mix(a + np.uint64(11)) + b), mix(mix(a + np.uint64(12)) + b)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends, a = np.cumsum(sizes + 1), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")))
        yield a, z
        a = z


def _texts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a column of texts: first and last row, joined bytes, each text's first byte and length."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy().astype(np.int64)
    for a, z in _slices(sizes):
        own = [(t or "").encode() for t in column[a:z].to_pylist()]
        length = sizes[a:z]
        yield a, z, np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum(length) - length, length


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, data, start, length in _texts(b.column("text")):
            _, h, *_ = anchors(data, start, length)
            found, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([_long(found), _long(n)], ["h", "n"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a, z, data, start, length in _texts(b.column("text")):
            of, h, p, lo, hi, h128 = anchors(data, start, length)
            x = stretch_names(h128, p, lo, hi) if len(p) else h
            where = pa.array(of + a)
            yield pa.RecordBatch.from_arrays(
                [_long(h), _long(x), b.column("k").take(where), b.column("size").take(where), pa.array((lo - start[of]).astype(np.int32)), pa.array((hi - lo + 1).astype(np.int32))],
                ["h", "x", "k", "size", "lo", "strings"],
            )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, wanted in zip(b.column("text"), b.column("wanted"), strict=True):
            data, rows = (text.as_py() or "").encode(), wanted.as_py()
            cols = [pa.array([r[k] for r in rows], pa.int64()) for k in ("h", "x", "strings", "kinds")]
            bytes_ = pa.array([data[r["lo"] : r["lo"] + r["strings"] + LENGTH - 1] for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, bytes_], ["h", "x", "strings", "kinds", "data"])


def _merged(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[pa.Table]:
    """Tables that end where h changes, of about so many bytes of data."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.column("data").nbytes
        if size >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            h = t.column("h").to_numpy()
            at = int(np.searchsorted(h, h[-1]))
            if at:
                yield t.slice(0, at)
            held = t.slice(at).combine_chunks().to_batches()
            size = sum(x.column("data").nbytes for x in held) if at else 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _repeated_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated strings of stretches, all of an anchor's in one table: h, x and runs [first, last] of strings."""
    for t in _merged(batches):
        cols = [t.column(k).to_numpy() for k in ("h", "x")]
        once = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)])
        t = t.filter(pa.array(once))
        cols = [t.column(k).to_numpy() for k in ("h", "x")]
        parts = t.column("data").to_pylist()
        strings = t.column("strings").to_numpy()
        sizes = np.array([len(x) for x in parts], dtype=np.int64)
        w1, w2 = window_names(np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(sizes) - sizes, strings)
        order = np.lexsort((w2, w1))
        same = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])
        again = np.zeros(len(w1), dtype=bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        of = np.repeat(np.arange(len(parts)), strings)
        within = np.arange(len(of)) - np.repeat(np.cumsum(strings) - strings, strings)
        hit = np.nonzero(again)[0]
        if not len(hit):
            continue
        new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (of[hit[1:]] != of[hit[:-1]])])
        a, z = hit[new], hit[np.append(np.nonzero(new)[0][1:] - 1, len(hit) - 1)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c[of[a]]) for c in cols), _long(within[a]), _long(within[z])], ["h", "x", "a", "z"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch's strings, one by one: h, x, at, w1, w2."""
    for b in batches:
        parts, strings = b.column("data").to_pylist(), b.column("strings").to_numpy()
        for a in range(0, len(parts), 4096):
            own, n = parts[a : a + 4096], strings[a : a + 4096]
            sizes = np.array([len(x) for x in own], dtype=np.int64)
            w1, w2 = window_names(np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum(sizes) - sizes, n)
            of = pa.array(np.repeat(np.arange(len(own)), n) + a)
            within = np.arange(len(w1)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(of) for k in ("h", "x")), _long(within), _long(w1), _long(w2)], ["h", "x", "at", "w1", "w2"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs, those that touch or overlap made one."""
    for b in batches:
        out = []
        for runs in b.column("runs").to_pylist():
            own: list[dict] = []
            for r in runs:
                if own and r["a"] <= own[-1]["z"]:
                    own[-1]["z"] = max(own[-1]["z"], r["z"])
                else:
                    own.append(r)
            out.append(own)
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("size"), pa.array(out, b.column("runs").type)], ["k", "size", "runs"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        removed, spans, digest, kept = [], [], [], []
        sizes = []
        for text, runs in zip(b.column("text"), b.column("runs"), strict=True):
            data = (text.as_py() or "").encode()
            sizes.append(len(data))
            out, at, n, m = [], 0, 0, 0
            for r in runs.as_py() or ():
                out.append(data[at : r["a"]])
                at = r["z"]
                m += 1
                n += at - r["a"]
            out.append(data[at:])
            removed.append(n)
            spans.append(m)
            kept.append(b"".join(out))
            digest.append(hashlib.sha256(kept[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _near(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST else df


def repeated_runs(docs: DataFrame) -> DataFrame:
    """k, size, runs: the disjoint byte ranges (a, z), in order, of docs (k, size, text) that repeated strings cover."""
    # written first: joined as an aggregate, its side could not be dealt anew, and a frequent anchor would stay in one task
    again = cut(docs.select("text").mapInArrow(_ranked, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    found = docs.mapInArrow(_stretches, "h long, x long, k long, size int, lo int, strings int")
    found = cut(found.join(again, "h", "left_semi"))
    key = ["h", "x"]
    kinds = cut(found.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("k", "size", "lo", "strings")).alias("one")))
    mixed = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(mixed, "h").select(*key, "one.*", "kinds")
    wanted = cut(wanted.groupBy("k", "size").agg(F.collect_list(F.struct(*key, "lo", "strings", "kinds")).alias("wanted"), F.count("*").alias("n")))
    rows = wanted.agg(F.sum("n")).first()[0] or 0
    told = docs.join(_near(wanted.drop("n"), rows), ["k", "size"]).select("text", "wanted")
    told = cut(told.mapInArrow(_contexts, "h long, x long, strings long, kinds long, data binary"))
    few = told.where(F.col("kinds") <= LOCAL).repartition("h").sortWithinPartitions(*key)
    some = few.mapInArrow(_repeated_here, "h long, x long, a long, z long")
    # anchors with very many stretches: their strings are counted by name, so no task has them all
    many = told.where(F.col("kinds") > LOCAL).dropDuplicates(key)
    strings = many.mapInArrow(_strings, "h long, x long, at long, w1 long, w2 long")
    counts = strings.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    single = strings.join(counts, ["w1", "w2"], "left_semi").select(*key, F.col("at").alias("a"), F.col("at").alias("z"))
    whole = kinds.where("n > 1").select(*key, F.lit(0).cast("long").alias("a"), F.lit(1 << 20).cast("long").alias("z"))
    runs = found.join(some.union(single).union(whole), key)
    last = F.least("z", F.col("strings") - 1)
    runs = runs.select("k", "size", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + last + LENGTH).alias("z"))
    return runs.groupBy("k", "size").agg(F.array_sort(F.collect_list(F.struct("a", "z"))).alias("runs")).mapInArrow(_joined, "k long, size int, runs array<struct<a:long,z:long>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept, the remaining bytes.

    A byte is removed if a 200-byte string that covers it begins anywhere else too, in any document or in the same one.
    Copies of a document lose all strings but keep what is shorter. Equal names count as equal
    strings. Where few strings, or ranges, are wanted of the texts, by count, they are broadcast; else texts are joined by a shuffle.

    Null text: empty. Texts under 200 bytes lose nothing. Repeated rows are copies of each other. An empty table
    gives none. Other columns are ignored.
    """
    id_, text = F.col(id_col), F.col(text_col)
    base = docs.select(id_.alias("doc_id"), text.alias("text"), F.xxhash64(id_, text).alias("k"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("size"))
    runs = cut(repeated_runs(base.select("k", "size", "text")))
    rows = runs.agg(F.sum(F.size("runs"))).first()[0] or 0
    kind = dict(base.dtypes)["doc_id"]
    told = base.join(_near(runs, rows), ["k", "size"], "left").select("doc_id", "text", "runs")
    return told.mapInArrow(_kept, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
