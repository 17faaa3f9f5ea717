"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample: the sample's principal axes, turned until signs along the new axes lose as little as possible.
A vector's code is the signs of its coordinates under some such rotations, each from another start. The code is cut into substrings; every
substring is a table, and vectors with equal substrings share a bucket. Inside buckets original vectors are compared by cosine in double
precision, and a pair counts in the first table whose bucket it shares, so that links are counted without ever being listed.

The number of tables comes from the sample: its vectors are turned by exactly the angle of the least cosine in random directions, and
there are as many tables as find all but MISS of these pairs. Substrings grow with the number of vectors, so buckets stay small. A
bucket of more than BLOCK vectors is cut into blocks that meet two at a time in tasks of their own, all of them. A task gives each vector's count,
and connects what is linked to its least member, instead of the links.

Equal vectors are one class with their number, and are linked with each other whatever their codes.

Cases: vectors that are NULL, empty or zero, or hold a NULL or non-finite component, stand alone and are kept; vectors of different lengths
are never linked; rows that repeat an id are vectors of their own, which no link joins for their id's sake; a NULL id is a vector like others, but names no
component, so that one of NULL ids only has a NULL component_id and is kept; vectors with tied cosines are all linked; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.llm.common import BROADCAST_KEYS, join_on_hot, mapped, one_of, stored
from grovewise.llm.neardup import components

#: Vectors of the sample, and numbers in them: both bound what the driver holds.
SAMPLE, SAMPLE_NUMBERS = 20_000, 8_000_000
#: Bits of one rotation at most, rotations at most, and steps of learning each.
BITS, ROTATIONS, STEPS = 64, 16, 30
#: The share of pairs at the least cosine that tables may miss, on the sample.
MISS = 0.01
#: Vectors that share a substring by chance, about, and vectors that are compared as one block.
BUCKET, BLOCK = 256, 2048
#: A class with so many rows is broadcast to them.
HOT = 1000


@dataclass(frozen=True)
class Codes:
    """mean: subtracted first; axes: (rotations, dim, bits); bits of a table's substring, and tables."""

    mean: np.ndarray
    axes: np.ndarray
    width: int
    tables: int

    def signs(self, x: np.ndarray) -> np.ndarray:
        y = np.zeros((len(x), len(self.mean)))
        y[:, : x.shape[1]] = x[:, : len(self.mean)]
        return np.concatenate([(y - self.mean) @ r > 0 for r in self.axes], axis=1)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables): each table's substring as a number."""
        s = self.signs(x)[:, : self.tables * self.width].reshape(len(x), self.tables, self.width)
        return s @ (1 << np.arange(self.width, dtype=np.int64))


def rotation(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """An orthogonal matrix under which rows of v are near the corners of the cube: signs and rotation are fitted in turn."""
    r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
    for _ in range(STEPS):
        z = v @ r
        u, _, w = np.linalg.svd(np.where(z > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


def learn(x: np.ndarray, n: int, cosine: float, seed: int = 0) -> Codes:
    """Codes for n vectors from the unit vectors x of a sample."""
    rng = np.random.default_rng(seed)
    mean = x.mean(0)
    centred = x - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, : min(BITS, x.shape[1])]
    v = centred @ axes
    turned = rng.normal(size=x.shape)
    turned -= np.einsum("ij,ij->i", turned, x)[:, None] * x
    turned /= np.maximum(np.linalg.norm(turned, axis=1), 1e-300)[:, None]
    near = cosine * x + math.sqrt(1 - cosine * cosine) * turned
    width = max(0, round(math.log2(max(1, n) / BUCKET)))
    if not width or x.shape[1] < 2:  # all vectors share the one bucket of a table without bits
        return Codes(mean, np.zeros((0, len(mean), 0)), 0, 1)
    found: list[np.ndarray] = []
    while True:
        while len(found) < ROTATIONS and len(found) * v.shape[1] < 64 * width:
            found.append(axes @ rotation(v, rng))
        all_ = Codes(mean, np.array(found), width, len(found) * v.shape[1] // width)
        if all_.tables:
            met = np.logical_or.accumulate(all_.keys(x) == all_.keys(near), axis=1).mean(0)
            if met[-1] >= 1 - MISS:
                tables = int(np.argmax(met >= 1 - MISS)) + 1
                return Codes(mean, np.array(found[: -(-tables * width // v.shape[1])]), width, tables)
        if width == 1:
            return Codes(mean, np.zeros((0, len(mean), 0)), 0, 1)
        width -= 1  # what all bits cannot find calls for larger buckets


def _valid(e: Column) -> Column:
    return F.coalesce((F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))


def unit(e: pa.ListArray, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of any lengths as unit rows padded with zeros, to `width` at least, and their lengths."""
    n = np.diff(e.offsets.to_numpy())
    x = np.zeros((len(e), n.max(initial=width)))
    x[np.arange(x.shape[1]) < n[:, None]] = e.flatten().to_numpy(zero_copy_only=False)
    x /= np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None], n


def bucket_links(v: np.ndarray, n: np.ndarray, x: np.ndarray, keys: np.ndarray, t: int, side: np.ndarray, alone: bool, cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """For the members of one bucket of table t: how many vectors each is linked to, and pairs of places that connect what the links do.

    alone: one block meets itself; else the members of side 0 meet those of side 1. Pairs that share an earlier table's bucket are left out."""
    total, root = np.zeros(len(v), np.int64), np.arange(len(v))
    left, right = (np.arange(len(v)),) * 2 if alone else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    for s in range(0, len(left), 512):
        rows = left[s : s + 512]
        i, j = np.nonzero(x[rows] @ x[right].T >= cosine)
        i, j = rows[i], right[j]
        keep = i < j if alone else slice(None)
        i, j = i[keep], j[keep]
        if t and len(i):
            new = np.concatenate([~(keys[i[a : a + 100_000], :t] == keys[j[a : a + 100_000], :t]).any(1) for a in range(0, len(i), 100_000)])
            i, j = i[new], j[new]
        np.add.at(total, i, n[j])
        np.add.at(total, j, n[i])
        root = united(root, i, j)
    inner = np.flatnonzero(root != np.arange(len(v)))
    return total, list(zip(inner.tolist(), root[inner].tolist()))


def united(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each component, when i and j are linked as well."""
    root = root.copy()
    while True:
        a, b = root[i], root[j]
        open_ = a != b
        if not open_.any():
            return root
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _members(vectors: DataFrame, codes: Codes) -> DataFrame:
    """(v, n, dim, x, keys): classes with their unit vectors as doubles and their tables' keys."""
    shared = vectors.sparkSession.sparkContext.broadcast(codes)  # at most ROTATIONS * BITS axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, n = unit(b.column("e"))
            keys = shared.value.keys(x) if shared.value.width else np.zeros((len(x), 1), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("v"), b.column("n"), pa.array(n, pa.int32()), pa.array([r[:k].tobytes() for r, k in zip(x, n)], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["v", "n", "dim", "x", "keys"])

    return mapped(vectors.select("v", "n", "e"), run, "v long, n long, dim int, x binary, keys array<long>")


def _compared(buckets: DataFrame, cosine: float) -> DataFrame:
    """(v, links, y): how many links each member of a bucket has there, or with y a member that links connect it with; `buckets` in order."""

    def group(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        v, n, side = (rows.column(c).to_numpy() for c in ("v", "n", "side"))
        dim, t = rows.column("dim")[0].as_py(), rows.column("t")[0].as_py()
        x = np.frombuffer(b"".join(rows.column("x").to_pylist())).reshape(-1, dim)
        keys = np.array(rows.column("keys").to_pylist(), np.int64)
        total, forest = bucket_links(v, n, x, keys, t, side, rows.column("i")[0].as_py() == rows.column("j")[0].as_py(), cosine)
        return v, total, forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = ("t", "dim", "key", "i", "j")

        def out(table: pa.Table, starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
            ids: list[np.ndarray] = []
            links: list[np.ndarray] = []
            edges: list[tuple[int, int]] = []
            for a, b in zip(starts, [*starts[1:], end]):
                if b - a > 1:
                    v, total, forest = group(table.slice(a, b - a))
                    some = np.flatnonzero(total)
                    ids.append(v[some])
                    links.append(total[some])
                    edges += [(int(v[i]), int(v[j])) for i, j in forest]
            if ids:
                v = np.concatenate([*ids, np.array([e[0] for e in edges], np.int64)])
                n = np.concatenate([*links, np.zeros(len(edges), np.int64)])
                y = pa.array([None] * (len(v) - len(edges)) + [e[1] for e in edges], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(n, pa.int64()), y], names=["v", "links", "y"])

        rest: list[pa.RecordBatch] = []  # at most one group that is not complete
        for b in batches:
            table = pa.Table.from_batches([*rest, b])
            if not len(table):
                continue
            k = np.stack([table.column(c).to_numpy().astype(np.int64) for c in head])
            starts = np.flatnonzero(np.append(True, (k[:, 1:] != k[:, :-1]).any(0)))
            yield from out(table, starts[:-1], starts[-1])
            rest = table.slice(starts[-1]).combine_chunks().to_batches()
        if rest:
            yield from out(pa.Table.from_batches(rest), np.array([0]), sum(map(len, rest)))

    return mapped(buckets, run, "v long, links long, y long")


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding); `codes` of the result are what was learned."""
    one_of(vectors, "vec_id", "embedding")
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("e"))  # no negative zeros
    hash_ = F.struct(F.xxhash64(F.lit(1), "e").alias("hi"), F.xxhash64(F.lit(2), "e").alias("lo"))
    some = rows.where(_valid(F.col("e"))).withColumn("set", hash_)
    classes = some.groupBy("set").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep"), F.first("e").alias("e"))
    classes = stored(classes.withColumn("v", F.monotonically_increasing_id()), "classes")
    about = classes.agg(F.count("*").alias("n"), F.max(F.size("e")).alias("dim")).first()
    codes = None
    if about.n:
        take = max(2, min(SAMPLE, SAMPLE_NUMBERS // about.dim))
        sample = classes.select("e", F.xxhash64(F.lit(3), "set").alias("h")).orderBy("h").limit(take).select("e").toArrow().column("e").combine_chunks()
        codes = learn(unit(sample, about.dim)[0], about.n, cosine)
        table = stored(_members(classes, codes), "codes")
        each = table.select("v", "n", "dim", "x", "keys", F.posexplode("keys").alias("t", "key"))
        at = ["t", "dim", "key"]
        large = stored(table.select("dim", F.posexplode("keys").alias("t", "key")).groupBy(*at).agg(F.count("*").alias("m")).where(F.col("m") > BLOCK), "large", narrow=True)
        count = large.count()  # at most tables * vectors / BLOCK
        large = F.broadcast(large) if count <= BROADCAST_KEYS else large
        each = each.join(large, at, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("m") / BLOCK), F.lit(1)).cast("int")).withColumn("own", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
        meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), (F.col("own") > o).cast("int").alias("side"))))
        buckets = each.select("v", "n", "x", "keys", *at, meets.alias("p")).select("v", "n", "x", "keys", *at, "p.*")
        met = stored(_compared(buckets.repartition("t", "dim", "key", "i", "j").sortWithinPartitions("t", "dim", "key", "i", "j"), cosine), "links", narrow=True)
        links = met.where("y IS NOT NULL").select(F.least("v", "y").alias("x"), F.greatest("v", "y").alias("y")).distinct()
        counts = met.where("y IS NULL").groupBy("v").agg(F.sum("links").alias("links"))
        c = components(links)
        reps = classes.select("v", "rep")
        named = c.join(reps, "v").groupBy("c").agg(F.min("rep").alias("component"))
        label = classes.select("set", "n", "v", "rep").join(counts, "v", "left").join(c.join(named, "c").select("v", "component", F.lit(True).alias("in")), "v", "left")
        label = label.select("set", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("in"), F.col("component")).otherwise(F.col("rep")).alias("component_id"))
        found = join_on_hot(some.select("vec_id", "set"), stored(label, "label", narrow=True), "set", "n", HOT).select("vec_id", "n_links", "component_id")
    else:
        found = some.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    alone = rows.where(~_valid(F.col("e"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = found.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
    out.codes = codes
    return out
