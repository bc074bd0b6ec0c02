"""N-gram Jaccard self-join by chosen paths.

A document is the set of its hashed 5-word shingles. A run of chosen paths sends each set to the nodes of a random
tree: from a node a set follows those of its tokens whose hash at that node is below 1 / (similarity * set size),
so that two similar sets share a path in expectation. Nodes that hold many sets split again by another token; small
ones compare all their members. Runs are repeated until a pair at the threshold is missed with the wanted rarity.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small
from .graph import components
from .hashing import joined, mix, word_hashes, word_table

SHINGLE = 5
#: Similarity as a fraction, so that pairs are judged in whole numbers.
SIMILAR = (4, 5)
#: Chance that a pair at the threshold is lost; levels before nodes are counted; members that a node may compare; last level.
MISS, LEVELS, BUCKET, DEEPEST = 1e-4, 2, 256, 6
#: Shares of that chance: of sharing no node at LEVELS, of parting in nodes that are split, and of sketches that seem unlike.
SHARES = (0.8, 0.15, 0.05)
#: Least tokens of a sketch; estimated similarity under which a pair can't be one, five standard errors below the threshold.
SKETCH, LIKELY = 64, 0.55
#: Members of a block, and bytes of text or tokens that a worker holds in arrays at a time.
BLOCK, SLICE = 512, 1 << 19
# Bytes that separate words, all ASCII but digits and letters.
WORDS = word_table([*range(48), *range(58, 65), *range(91, 97), *range(123, 128)])


def apart(levels: int) -> float:
    """The chance that a pair at the threshold shares no node of one run at that level: a branching process of mean 1."""
    alive = 1.0
    for _ in range(levels):
        alive = 1 - math.exp(-alive)
    return 1 - alive


def runs(miss: float = MISS, levels: int = LEVELS) -> int:
    """How many runs leave a pair at the threshold apart with that chance."""
    return math.ceil(math.log(miss) / math.log(apart(levels)))


def unlike() -> float:
    """The chance that the sketches of a pair at the threshold seem unlike."""
    p, least = SIMILAR[0] / SIMILAR[1], math.ceil(LIKELY * SKETCH)
    return sum(math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k) for k in range(least))


def all_runs(miss: float = MISS) -> tuple[int, int]:
    """The runs of all sets, and those, with them, of sets that had a node split, whose pairs must stay together to the last level."""
    every = runs(miss * SHARES[0])
    return every, max(every, runs(miss * SHARES[1], DEEPEST))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct 32-bit shingle hashes, sorted by text, and how many each has. A text of fewer than SHINGLE words has one, of all of them."""
    data, start = joined(texts)
    word, of, _, _ = word_hashes(data, start, WORDS)
    count = np.bincount(of, minlength=len(texts))
    first = np.cumsum(count) - count
    m = max(0, len(word) - SHINGLE + 1)
    h = np.zeros(m, dtype=np.uint64)
    for j in range(SHINGLE):
        h = mix(h + word[j : j + m] + np.uint64(j + 1))
    ok = of[:m] == of[SHINGLE - 1 : SHINGLE - 1 + m]
    tokens, owner = [h[ok]], [of[:m][ok]]
    for i in np.nonzero((count > 0) & (count < SHINGLE))[0]:
        x = np.zeros(1, dtype=np.uint64)
        for j, w in enumerate(word[first[i] : first[i] + count[i]]):
            x = mix(x + w + np.uint64(100 + j))
        tokens.append(x)
        owner.append(np.array([i]))
    key = np.concatenate(owner).astype(np.uint64) << np.uint64(32) | np.concatenate(tokens) >> np.uint64(32)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key.astype(np.uint32), np.bincount((key >> np.uint64(32)).astype(np.int64), minlength=len(texts))


def _below(n: np.ndarray) -> np.ndarray:
    """The hash under which a set of n tokens follows one."""
    share = SIMILAR[1] / (SIMILAR[0] * np.maximum(n, 2).astype(float))
    return np.minimum(share * 2.0**64, 2.0**64 - 2048).astype(np.uint64)


def extend(tokens: np.ndarray, first: np.ndarray, n: np.ndarray, owner: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes (of sets `owner`) that their sets follow: owners and nodes."""
    limit = _below(n)
    out_owner, out_node = [owner[:0]], [node[:0]]
    ends = np.cumsum(n[owner])
    a = 0
    while a < len(owner):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 18), side="right")))
        own, size = owner[a:z], n[owner[a:z]]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first[own], size)
        h = mix(np.repeat(mix(node[a:z]), size) ^ (tokens[at].astype(np.uint64) << np.uint64(17)))
        hit = np.nonzero(h < np.repeat(limit[own], size))[0]
        out_owner.append(np.repeat(own, size)[hit])
        out_node.append(mix(h[hit] + np.uint64(1)))
        a = z
    return np.concatenate(out_owner), np.concatenate(out_node)


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, z
        a = z


def _lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(values, kind))


def _described(docs: DataFrame, id_col: str, text_col: str, times: int) -> DataFrame:
    """doc_id, k1 and k2 (of the set, or of the text where it has no words), n, nodes after LEVELS levels of all runs, sketch."""
    told = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(1, times + 1, dtype=np.uint64))
        for b in batches:
            sizes = pc.binary_length(b.column("text")).fill_null(0).to_numpy()
            for a, z in _slices(sizes + 1, SLICE):
                tokens, n = shingle_sets(b.column("text")[a:z].to_pylist())
                first, wide = np.cumsum(n) - n, tokens.astype(np.uint64)
                owner = np.tile(np.nonzero(n)[0], times)
                node = np.repeat(seeds, (n > 0).sum())
                for _ in range(LEVELS):
                    owner, node = extend(tokens, first, n, owner, node)
                order = np.argsort(owner, kind="stable")
                keys = []
                for salt in (3, 5):
                    s = np.concatenate([[np.uint64(0)], np.cumsum(mix(wide + np.uint64(salt << 40)))])
                    keys.append(mix(s[first + n] - s[first] + n.astype(np.uint64)))
                bare = n == 0
                keys[0][bare], keys[1][bare] = b.column("h")[a:z].to_numpy().view(np.uint64)[bare], 0
                least = np.minimum(n, SKETCH)
                at = np.arange(int(least.sum())) - np.repeat(np.cumsum(least) - least - first, least)
                sketch = tokens[at].tobytes()
                ends = np.concatenate([[0], np.cumsum(least)]) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id")[a:z], *(pa.array(k.view(np.int64)) for k in keys), pa.array(n.astype(np.int64)),
                        _lists(node[order].view(np.int64), np.bincount(owner, minlength=len(n)), pa.int64()),
                        pa.array([sketch[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
                    ],
                    ["doc_id", "k1", "k2", "n", "nodes", "sketch"],
                )

    return told.mapInArrow(run, f"doc_id {dict(told.dtypes)['doc_id']}, k1 long, k2 long, n long, nodes array<long>, sketch binary")


def _tokens(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rep, n and tokens (32-bit numbers) of the documents in ids (rep)."""
    told = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(ids, "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column("text")).fill_null(0).to_numpy()
            for a, z in _slices(sizes + 1, SLICE):
                tokens, n = shingle_sets(b.column("text")[a:z].to_pylist())
                data, ends = tokens.tobytes(), np.concatenate([[0], np.cumsum(n)]) * 4
                yield pa.RecordBatch.from_arrays([b.column("rep")[a:z], pa.array(n.astype(np.int64)), pa.array([data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["rep", "n", "tokens"])

    return told.mapInArrow(run, f"rep {dict(told.dtypes)['rep']}, n long, tokens binary")


def _by_key(keys: list[str], work: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable:
    """work() on the rows of each key of sorted batches; a key's rows may lie in several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ready: list[pa.RecordBatch] = []

        def done(parts: list[pa.RecordBatch], last: bool = False) -> Iterator[pa.RecordBatch]:
            """The results of many keys leave together."""
            if parts:
                own = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                if (out := work(own)) is not None:
                    ready.append(out)
            if ready and (last or len(ready) >= 1024):
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready.clear()

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(k).to_numpy() for k in keys]
            change = np.zeros(b.num_rows, dtype=bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.nonzero(change)[0].tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(c[a] for c in cols)
                if held and key != last:
                    yield from done(held)
                    held = []
                held.append(b.slice(a, z - a))
                last = key
        yield from done(held, True)

    return run


def _roots(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the least row that it is connected to."""
    root = np.arange(len(near))
    near = near | np.eye(len(near), dtype=bool)
    while True:
        low = np.where(near, root, len(root)).min(axis=1)
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _incidence(tokens: np.ndarray, owner: np.ndarray, rows: int) -> Iterator[np.ndarray]:
    """0/1 matrices, rows by shared tokens, a few thousand tokens at a time."""
    order = np.argsort(tokens, kind="stable")
    t, o = tokens[order], owner[order]
    new = np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, dtype=bool)
    number = np.cumsum(new) - 1
    shared = np.bincount(number, minlength=1)[number] > 1 if len(t) else new
    o, number = o[shared], number[shared]
    _, number = np.unique(number, return_inverse=True)
    width = 4096
    for a in range(0, int(number.max(initial=-1)) + 1, width):
        lo, hi = np.searchsorted(number, [a, a + width])
        x = np.zeros((rows, min(width, int(number[hi - 1]) - a + 1)), dtype=np.float32)
        x[o[lo:hi], number[lo:hi] - a] = 1
        yield x


def _likely(rows: pa.RecordBatch) -> pa.RecordBatch | None:
    """Links within a node by sketches: the least tokens of two sets' union, of those in both."""
    data = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in rows.column("sketch")]
    n, ids = rows.column("n").to_numpy(), rows.column("rep")
    m = len(data)
    near = np.zeros((m, m), dtype=bool)
    if m > 1:
        pad = np.full((m, SKETCH), 1 << 32, dtype=np.uint64)
        for i, x in enumerate(data):
            pad[i, : len(x)] = x
        for i in range(m - 1):
            both = np.sort(np.concatenate([np.broadcast_to(pad[i], (m - 1 - i, SKETCH)), pad[i + 1 :]], axis=1), axis=1)
            new = np.concatenate([np.ones((len(both), 1), dtype=bool), both[:, 1:] != both[:, :-1]], axis=1) & (both < 1 << 32)
            of = np.cumsum(new, axis=1) <= SKETCH
            shared = (~new & of & (both < 1 << 32)).sum(axis=1)
            union = np.minimum(new.sum(axis=1), SKETCH)
            near[i, i + 1 :] = shared >= LIKELY * union
            near[i, i + 1 :] &= np.minimum(n[i], n[i + 1 :]) * SIMILAR[1] >= np.maximum(n[i], n[i + 1 :]) * SIMILAR[0]
        near |= near.T
    root = _roots(near)
    own = np.nonzero(root != np.arange(m))[0]
    if not len(own):
        return None
    return pa.RecordBatch.from_arrays([ids.take(pa.array(own)), ids.take(pa.array(root[own]))], ["a", "b"])


def _verified(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Exact links within a block, or between two: for each member how many it has here and the first member it hangs together with."""
    n, part, ids = rows.column("n").to_numpy(), rows.column("part").to_numpy(), rows.column("rep")
    m = len(n)
    tokens = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), dtype=np.uint32)
    both = np.zeros((m, m), dtype=np.float32)
    for x in _incidence(tokens, np.repeat(np.arange(m), n), m):
        both += x @ x.T
    both = both.astype(np.int64)
    near = both * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (n[:, None] + n)
    np.fill_diagonal(near, False)
    if len(np.unique(part)) > 1:
        near &= part[:, None] != part
    return pa.RecordBatch.from_arrays([ids, pa.array(near.sum(axis=1)), ids.take(pa.array(_roots(near)))], ["rep", "links", "root"])


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_links and set_id.

    set_id is the least id of the documents with the same set of shingles; n_links how many other sets are similar to
    it (Jaccard at least 0.8, verified on whole sets); class_id the least id of all that hang together by links.
    Copies are joined once, by their set. Sets that may be linked are found by chosen paths and sketches, with at most
    `miss` chance to lose a pair at the threshold (its sketch part does not fall under unlike()): sets in a node that is
    split get further runs, as their pairs may part on the way down; groups of them are then compared exactly, in pairs of blocks, so
    that counts miss nothing within a group. Only counts and a forest leave a block, never all pairs.

    Texts without words are alike only if equal; null text counts as empty. Rows with the same id are one document;
    rows with a null id keep null classes and no links. An empty table gives no rows. Other columns are ignored.
    """
    every, deep = all_runs(miss)
    all_docs = cut(_described(docs, id_col, text_col, every))
    kind = dict(all_docs.dtypes)["doc_id"]
    sets = all_docs.where("doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("nodes").alias("nodes"), F.any_value("sketch").alias("sketch"))
    sets = cut(sets)
    members = sets.where("n > 0").select("rep", F.explode(F.array_distinct("nodes")).alias("node"))
    few, deepest, tokens, level = [], None, None, LEVELS
    while True:
        held, many = _shared(members)
        few.append(held)
        if level == LEVELS:
            ids = cut(held.select("rep").union(many.select("rep")).distinct())
            tokens = cut(_tokens(docs, small(ids), id_col, text_col).dropDuplicates(["rep"]))
        if many.isEmpty():
            break
        if level == DEEPEST:
            deepest = many.select(F.col("rep").alias("a"), F.col("first").alias("b"))
            break
        if level == LEVELS and deep > every:
            split = cut(many.select("rep").distinct())
            held, more = _shared(cut(_further(tokens.join(small(split), "rep", "left_semi"), kind, every, deep)))
            few.append(held)
            many = many.unionByName(more)
        level += 1
        members = cut(_deeper(many.groupBy("rep").agg(F.collect_list("node").alias("nodes")).join(tokens, "rep"), kind))
    found = _likely_links(few, sets, kind)
    if deepest is not None:
        found = found.union(deepest)
    groups = cut(components(found))
    blocks = groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = groups.withColumnRenamed("id", "rep").join(blocks, "component").join(tokens, "rep")
    placed = placed.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["component", "lo", "hi"]
    placed = placed.select("component", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "rep", "n", "tokens")
    placed = placed.repartition(*keys).sortWithinPartitions(*keys, "rep")
    exact = cut(placed.mapInArrow(_by_key(keys, _verified), f"rep {kind}, links long, root {kind}"))
    classes = components(exact.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = exact.groupBy("rep").agg(F.sum("links").alias("links"))
    told = sets.select("k1", "k2", "rep").join(links, "rep", "left").join(classes.withColumnRenamed("id", "rep"), "rep", "left")
    told = told.select("k1", "k2", F.col("rep").alias("set_id"), F.coalesce("component", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
    known = F.col("doc_id").isNotNull()
    return all_docs.select("doc_id", "k1", "k2").join(told, ["k1", "k2"], "left").select(
        "doc_id", F.when(known, F.col("class_id")).alias("class_id"), F.when(known, F.col("n_links")).otherwise(0).alias("n_links"), F.when(known, F.col("set_id")).alias("set_id")
    )


def _shared(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members (rep, node) of nodes that several sets share: those of BUCKET sets at most, and those of more, with the first of them.

    The large nodes are found by counts with partial counts first, and are few: a BUCKETth of the members at most. Their members
    are told by the node, where they lie, so no task gathers a large node. The others are dealt by node to leave out single
    ones; no more than a node's members are held.
    """
    kind = dict(members.dtypes)["rep"]
    large = members.groupBy("node").agg(F.count("*").alias("m"), F.min("rep").alias("first")).where(F.col("m") > BUCKET)
    told = members.join(small(cut(large.select("node", "first"))), "node", "left")
    many = cut(told.where("first is not null").select("rep", "node", "first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def shared(b: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
            """The rows of nodes with several, but for the last node, which may go on in the next batch."""
            node = b.column("node").to_numpy()
            cuts = np.concatenate([[0], np.nonzero(node[1:] != node[:-1])[0] + 1, [len(node)]])
            keep = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
            if not last:
                keep[cuts[-2] :] = False
            return b.take(pa.array(np.nonzero(keep)[0])), None if last else b.slice(int(cuts[-2]))

        for b in batches:
            if b.num_rows:
                own = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
                out, held = shared(own, False)
                yield out
        if held is not None:
            yield shared(held, True)[0]

    rows = told.where("first is null").select("rep", "node").repartition("node").sortWithinPartitions("node", "rep")
    return cut(rows.mapInArrow(run, f"rep {kind}, node long")), many


def _likely_links(few: list[DataFrame], sets: DataFrame, kind: str) -> DataFrame:
    """Links by sketches within the nodes of all levels, each of BUCKET sets at most: a, b. A node is of one level, so all are dealt at once.

    A set's nodes are gathered before it meets its sketch, so that the join has a row for each set.
    """
    held = reduce(DataFrame.union, [f.select("rep", "node") for f in few]).groupBy("rep").agg(F.collect_list("node").alias("nodes"))
    held = held.join(sets.select("rep", "n", "sketch"), "rep").select("rep", "n", "sketch", F.explode("nodes").alias("node"))
    held = held.repartition("node").sortWithinPartitions("node", "rep")
    return held.mapInArrow(_by_key(["node"], _likely), f"a {kind}, b {kind}")


def _further(rows: DataFrame, kind: str, start: int, end: int) -> DataFrame:
    """The nodes after LEVELS levels of the runs from start to before end: rep, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(start + 1, end + 1, dtype=np.uint64))
        for b in batches:
            sizes = pc.binary_length(b.column("tokens")).to_numpy()
            for a, z in _slices(sizes, SLICE):
                tokens = np.frombuffer(b"".join(b.column("tokens")[a:z].to_pylist()), dtype=np.uint32)
                n = b.column("n")[a:z].to_numpy()
                owner, node = np.tile(np.arange(len(n)), len(seeds)), np.repeat(seeds, len(n))
                for _ in range(LEVELS):
                    owner, node = extend(tokens, np.cumsum(n) - n, n, owner, node)
                yield pa.RecordBatch.from_arrays([b.column("rep")[a:z].take(pa.array(owner)), pa.array(node.view(np.int64))], ["rep", "node"])

    return rows.select("rep", "n", "tokens").mapInArrow(run, f"rep {kind}, node long").distinct()


def _deeper(rows: DataFrame, kind: str) -> DataFrame:
    """The children of rows' nodes: rep, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column("tokens")).to_numpy()
            for a, z in _slices(sizes, SLICE):
                tokens = np.frombuffer(b"".join(b.column("tokens")[a:z].to_pylist()), dtype=np.uint32)
                n = b.column("n")[a:z].to_numpy()
                nodes = b.column("nodes")[a:z]
                count = pc.list_value_length(nodes).to_numpy()
                node = nodes.flatten().to_numpy().view(np.uint64)
                owner, child = extend(tokens, np.cumsum(n) - n, n, np.repeat(np.arange(len(n)), count), node)
                yield pa.RecordBatch.from_arrays([b.column("rep")[a:z].take(pa.array(owner)), pa.array(child.view(np.int64))], ["rep", "node"])

    return rows.select("rep", "n", "tokens", "nodes").mapInArrow(run, f"rep {kind}, node long").distinct()
