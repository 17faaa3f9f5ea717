"""Exact k-means on whole-number vectors with Hamerly's bounds.

Every component x becomes floor(256 * x). Each vector keeps its centroid, an upper bound of the distance to it and one lower bound of the distance to the
second nearest, in a stored table. When centroids have moved, the upper bound grows by the own centroid's drift and the lower one
shrinks by the largest drift of the others. While the upper bound is under the lower one, or under half the way from the own centroid
to its nearest neighbour, nothing can have changed and no distance is computed. Otherwise the upper bound is made exact, and where
that does not settle it, all centroids are scanned in whole numbers. Bounds are rounded outward, so ties are always scanned.

Of a round, only the vectors that changed centroids are added up: each task gives, for each centroid, the difference of its vectors' sum and
count. Sums and means are exact whole numbers of any size. The driver holds the centroids and these sums, k rows of numbers.

Cases: a vector is kept if it is neither NULL nor of another length than asked for, and all of its components are there and finite; other rows are not
in the result; rows that repeat an id are vectors of their own; a NULL id is clustered, but never starts a centroid; starting vectors that tie, as they
repeat an id, come in order of their components; with fewer kept vectors than centroids there are as many centroids as vectors with an id, and none at all is an error
only if vectors without an id are there; an empty table gives an empty result. A component beyond 2^19 in size is an error, as squared distances would
leave 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from grovewise.llm.common import discard, mapped, one_of, stored

SCALE = 256
#: Components this large in size keep a squared distance of 64 of them within 63 bits.
LARGEST = 1 << 27
#: Products of components up to this are exact in doubles: 64 * 4 * 2^44 is under 2^53.
EXACT = 1 << 22
#: Vectors of which one scan holds all distances.
STEP = 8192
_OUT, _IN = 1 + 1e-12, 1 - 1e-12
_ROW = "vec_id {}, q binary, a int, u double, l double, n bigint, d array<bigint>"


@dataclass(frozen=True)
class Centroids:
    """points: (k, dim) whole numbers; drift: how far each moved since the bounds were made; half: half the distance to the nearest other one."""

    points: np.ndarray
    drift: np.ndarray
    half: np.ndarray

    @staticmethod
    def of(points: np.ndarray, before: np.ndarray | None = None) -> Centroids:
        d = scan(points, points).astype(float)
        np.fill_diagonal(d, np.inf)
        drift = np.zeros(len(points)) if before is None else np.sqrt(np.array([own(points[i : i + 1], before[i : i + 1])[0] for i in range(len(points))], float)) * _OUT
        return Centroids(points, drift, np.sqrt(d.min(1)) / 2 * _IN)


def own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, row by row."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def scan(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all rows of c: in doubles while every sum is a whole number they hold, else in 64-bit numbers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT and x.shape[1] <= 64:
        x, c = x.astype(float), c.astype(float)
    return (np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)).astype(np.int64)


def assign(x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New centroids and bounds, and how many vectors were scanned. a < 0: not assigned before."""
    a, u, low = a.copy(), u.copy(), low.copy()
    new = a < 0
    if len(c.points) > 1:
        first, second = np.argsort(c.drift)[::-1][:2]
        most = np.where(a == first, c.drift[second], c.drift[first])
    else:
        most = np.zeros(len(a))
    u = (u + c.drift[a]) * _OUT
    low = low - most * _OUT
    low -= np.abs(low) * 1e-12
    bound = np.maximum(low, c.half[a])
    todo = np.flatnonzero(new | ~(u < bound))
    known = todo[~new[todo]]
    u[known] = np.sqrt(own(x[known], c.points[a[known]]).astype(float)) * _OUT
    todo = todo[new[todo] | ~(u[todo] < bound[todo])]
    for i in range(0, len(todo), STEP):
        t = todo[i : i + STEP]
        d = scan(x[t], c.points)
        rows, best = np.arange(len(t)), d.argmin(1)  # the smaller number of equals
        a[t], u[t] = best, np.sqrt(d[rows, best].astype(float)) * _OUT
        d[rows, best] = np.iinfo(np.int64).max
        low[t] = np.sqrt(d.min(1).astype(float)) * _IN if d.shape[1] > 1 else 1e300
    return a, u, low, len(todo)


def kept(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, e): vectors of `dim` finite components, as doubles."""
    one_of(vectors, "vec_id", "embedding")
    e = F.transform("embedding", lambda x: x.cast("double"))
    ok = (F.size("embedding") == dim) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select("vec_id", e.alias("e"))


def whole(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, q): kept vectors as `dim` little-endian 64-bit whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            e = b.column("e")
            x = np.floor(SCALE * e.flatten().to_numpy(zero_copy_only=False).reshape(len(e), dim))
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST // SCALE} in size, distances do not fit 64 bits")
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())], names=["vec_id", "q"])

    return mapped(kept(vectors, dim), run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, q binary")


def _rows(q: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(q.to_pylist()), "<i8").reshape(-1, dim)


def starts(vectors: DataFrame, k: int, dim: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes."""
    h = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    q = F.transform("e", lambda x: F.floor(SCALE * x))
    least = kept(vectors, dim).where("vec_id IS NOT NULL").select(h.alias("h"), q.alias("q")).orderBy("h", "q").limit(k).collect()
    return np.array([r.q for r in least], np.int64).reshape(-1, dim)


def _round(state: DataFrame, c: Centroids, dim: int, name: str) -> tuple[DataFrame, dict[int, tuple[int, list[int]]], int]:
    """The stored state after one assignment; by centroid, by how much count and sum changed; and how many vectors were scanned."""
    shared = state.sparkSession.sparkContext.broadcast(c)  # k rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        k = len(c.points)
        n, total, scanned = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), 0
        for b in batches:
            x, a, u, low = _rows(b.column("q"), dim), *(b.column(z).to_numpy(zero_copy_only=False) for z in ("a", "u", "l"))
            new, u, low, s = assign(x, a, u, low, c)
            moved, scanned = np.flatnonzero(new != a), scanned + s
            for at, sign in ((new[moved], 1), (a[moved], -1)):
                there = at >= 0
                np.add.at(n, at[there], sign)
                np.add.at(total, at[there], sign * x[moved[there]])
            none = pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("q"), pa.array(new, pa.int32()), pa.array(u), pa.array(low), *none], names=["vec_id", "q", "a", "u", "l", "n", "d"])
        js = np.flatnonzero(n.astype(bool) | total.any(1))
        if len(js) or scanned:
            js = [-1, *js.tolist()]  # the first row counts scans
            sums = [[scanned], *(total[j].tolist() for j in js[1:])]
            rows = [pa.nulls(len(js), schema_id), pa.nulls(len(js), pa.binary()), pa.array(js, pa.int32()), pa.nulls(len(js), pa.float64()), pa.nulls(len(js), pa.float64()), pa.array([0, *n[js[1:]].tolist()], pa.int64()), pa.array(sums, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(rows, names=["vec_id", "q", "a", "u", "l", "n", "d"])

    kind = state.schema["vec_id"].dataType
    schema_id = to_arrow_type(kind)
    out = stored(mapped(state, run, _ROW.format(kind.simpleString())), name)
    each = out.where("d IS NOT NULL").select("a", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("d").alias("i", "x"))
    sums = each.groupBy("a", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # k * dim rows
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sums:
        found.setdefault(r.a, (int(r.n), [0] * dim))[1][r.i] = int(r.x)
    scanned = found.pop(-1, (0, [0]))[1][0]
    return out, found, scanned


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every kept vector.

    `scans` of the result lists how many vectors each assignment scanned in full."""
    q = stored(whole(vectors, dim), "whole")
    points = starts(vectors, k, dim)
    if not len(points):
        if not q.isEmpty():
            raise ValueError("no vector has an id to start a centroid with")
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return q.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    state = q.withColumns({"a": F.lit(-1), "u": F.lit(0.0), "l": F.lit(0.0)})
    counts, sums, c, last, scans = [0] * len(points), [[0] * dim for _ in points], Centroids.of(points), q, []
    for r in range(rounds + 1):
        table, found, scanned = _round(state.select("vec_id", "q", "a", "u", "l"), c, dim, f"round-{r}")
        discard(last)
        last, state = table, table.where("d IS NULL")
        scans.append(scanned)
        for j, (n, x) in found.items():
            counts[j] += n
            sums[j] = [s + y for s, y in zip(sums[j], x)]
        if r < rounds:
            moved = np.array([[s // n for s in x] if n else p.tolist() for x, n, p in zip(sums, counts, c.points)], np.int64)
            c = Centroids.of(moved, c.points)
    shared = state.sparkSession.sparkContext.broadcast(c.points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = own(_rows(b.column("q"), dim), shared.value[b.column("a").to_numpy()])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("a"), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    out = stored(mapped(state.select("vec_id", "q", "a"), run, f"vec_id {kind}, cluster int, distance bigint"), "assigned", narrow=True)
    discard(last)
    inertia = {r.cluster: int(r.s) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    about = [(j, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, c.points[j].tolist())).encode()).hexdigest()) for j, s in inertia.items()]
    table = state.sparkSession.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    result = out.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    result.scans = scans
    return result
