"""Centroid clustering in whole numbers, with centroids filtered by bounds of an n-simplex projection.

A few vectors are pivots. From its distances to n pivots a vector gets n apex coordinates: its place in the space that
the pivots span, and its height over it. For two apexes the distance of the true vectors lies between that of the
apexes and that of one apex and the other mirrored below the base. The coordinates are made once and kept; a round
compares those, and whole vectors only with the centroids whose bounds leave them possible.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Components of a vector, whole numbers in a unit, clusters, rounds.
SIZE, UNIT, CLUSTERS, ROUNDS = 64, 1024, 8, 10
#: Pivots at most; a pivot's least height over those before it, as a share of the longest edge; what bounds may be off by, as a share of the distances.
PIVOTS, STEEP, SLACK = 16, 0.05, 1e-6
#: Largest whole number of a component, so that squared distances fit 64 bits.
LARGEST = 1 << 27


@dataclass
class Simplex:
    """pivots (n, size); inverse of the triangle of their coordinates; squared lengths of these."""

    pivots: np.ndarray
    inverse: np.ndarray
    squares: np.ndarray

    def apex(self, vectors: np.ndarray) -> np.ndarray:
        """The apex coordinates of vectors by their distances to the pivots; the last is the height."""
        d = squared(vectors, self.pivots).astype(float)
        out = np.zeros((len(vectors), max(1, len(self.pivots))))
        if d.shape[1]:
            out[:, :-1] = (d[:, :1] - d[:, 1:] + self.squares) / 2 @ self.inverse.T
            out[:, -1] = np.sqrt(np.maximum(d[:, 0] - (out[:, :-1] ** 2).sum(axis=1), 0))
        return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to the few of b, in whole numbers."""
    out = np.empty((len(a), len(b)), dtype=np.int64)
    for j, row in enumerate(b):
        d = a - row
        out[:, j] = (d * d).sum(axis=1)
    return out


def simplex(candidates: np.ndarray, most: int = PIVOTS) -> Simplex:
    """The base of the first candidates that stand well above the space of those before them."""
    found, rows = [], []
    for x in candidates:
        base = _base(found, rows)
        at = base.apex(x[None])[0]
        edge = np.sqrt(squared(np.array(found), x[None]).max()) if found else 0.0
        if found and (at[-1] == 0 or at[-1] < STEEP * edge):
            continue
        if found:
            rows.append(at)
        found.append(x)
        if len(found) == most:
            break
    return _base(found, rows)


def _base(found: list[np.ndarray], rows: list[np.ndarray]) -> Simplex:
    n = len(rows)
    triangle = np.zeros((n, n))
    for i, r in enumerate(rows):
        triangle[i, : len(r)] = r
    pivots = np.array(found, dtype=np.int64) if found else np.zeros((0, SIZE), dtype=np.int64)
    return Simplex(pivots, np.linalg.inv(triangle) if n else triangle, (triangle**2).sum(axis=1))


def bounds(apex: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of vectors to centroids, both given by apex coordinates."""
    low, high = np.empty((len(apex), len(of))), np.empty((len(apex), len(of)))
    for j, c in enumerate(of):
        base = ((apex[:, :-1] - c[:-1]) ** 2).sum(axis=1)
        low[:, j] = np.sqrt(base + (apex[:, -1] - c[-1]) ** 2)
        high[:, j] = np.sqrt(base + (apex[:, -1] + c[-1]) ** 2)
    return low, high


def assign(vectors: np.ndarray, apex: np.ndarray, centroids: np.ndarray, base: Simplex) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest centroid of each vector (of equally near ones the first), its squared distance, and how many distances were taken."""
    of = base.apex(centroids)
    low, high = bounds(apex, of)
    slack = SLACK * (1 + np.abs(apex).sum(axis=1, keepdims=True) + np.abs(of).sum(axis=1))
    maybe = low - slack <= (high + slack).min(axis=1, keepdims=True)
    best, least = np.full(len(vectors), -1), np.full(len(vectors), np.iinfo(np.int64).max)
    for j in range(len(centroids)):
        rows = np.nonzero(maybe[:, j])[0]
        d = vectors[rows] - centroids[j]
        d = (d * d).sum(axis=1)
        nearer = d < least[rows]
        best[rows[nearer]], least[rows[nearer]] = j, d[nearer]
    return best, least, int(maybe.sum())


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, the components as whole numbers, of the vectors of SIZE finite components."""
    v = F.col(vector_col)
    plain = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(v.isNotNull() & (F.size(v) == SIZE) & plain)
    return rows.select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(UNIT) * x.cast("double")).cast("long")).alias("v"))


def _order(seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, SIZE)


def _projected(rows: DataFrame, base: Simplex) -> DataFrame:
    """rows with their apex coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"))
            if len(v) and np.abs(v).max() > LARGEST:
                raise OverflowError(f"a component is larger than {LARGEST // UNIT}: squared distances would not fit 64 bits")
            apex = base.apex(v)
            ends = pa.array(np.arange(len(v) + 1, dtype=np.int32) * apex.shape[1])
            yield b.append_column("apex", pa.ListArray.from_arrays(ends, pa.array(apex.ravel())))

    return rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, v array<long>, apex array<double>")


def _apexes(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(rows, -1)


def _sums(rows: DataFrame, centroids: np.ndarray, base: Simplex) -> DataFrame:
    """For each task and cluster: the number of vectors and the sums of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), SIZE), dtype=np.int64)
        for b in batches:
            v = _matrix(b.column("v"))
            best, _, _ = assign(v, _apexes(b.column("apex"), len(v)), centroids, base)
            for j in range(len(centroids)):
                own = v[best == j]
                n[j] += len(own)
                total[j] += own.sum(axis=0)
        some = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return rows.mapInArrow(run, "cluster int, n long, total array<long>")


def _assigned(rows: DataFrame, centroids: np.ndarray, base: Simplex) -> DataFrame:
    """vec_id, cluster and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column("v"))
            best, distance, _ = assign(v, _apexes(b.column("apex"), len(v)), centroids, base)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, cluster int, distance long")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Vectors are kept if they have SIZE components, none null or non-finite. The first centroids are the vectors of least
    hash of id, the pivots those after them that stand apart. A round is one pass over the written vectors and apex
    coordinates: each task adds up its clusters, the tasks' sums are added by Spark, and a row for each cluster comes to
    the driver, whatever the table's size.

    Rows with equal ids are each a vector (equal hashes go by components); a null id counts as an empty text. Of fewer
    vectors than clusters there are as many clusters as vectors; an empty table, or one without a kept vector, gives no
    rows. Components beyond LARGEST / UNIT raise OverflowError. Other columns are ignored, whatever their names.
    """
    whole = kept(vectors, id_col, vector_col)
    first = whole.orderBy(_order("3:"), "v").limit(clusters + 4 * PIVOTS).collect()  # a bounded head, by partial heads
    start = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, SIZE)
    if len(start) and np.abs(start).max() > LARGEST:
        raise OverflowError(f"a component is larger than {LARGEST // UNIT}: squared distances would not fit 64 bits")
    centroids = start[:clusters]
    base = simplex(start[clusters:] if len(start) > clusters else start)
    rows = cut(_projected(whole, base))
    for _ in range(rounds if len(start) else 0):
        sums = _sums(rows, centroids, base).groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(SIZE))).alias("total"))
        moved = centroids.copy()
        for r in sums.collect():  # a row for each cluster
            moved[r["cluster"]] = [t // r["n"] for t in r["total"]]
        if (moved == centroids).all():
            break  # later rounds would change nothing
        centroids = moved
    found = cut(_assigned(rows, centroids, base))
    digests = [(j, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    told = vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    own = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = own.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = F.broadcast(own.join(told, "cluster").crossJoin(total))  # a row for each cluster and one row
    return found.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
