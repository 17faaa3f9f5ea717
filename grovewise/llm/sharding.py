"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows of input partition p go to shard s is drawn before any row moves: the counts of a uniform
shuffle are multivariate hypergeometric, and drawing them one partition after another from what
each shard still takes keeps every shard's size exact. Then rows are permuted inside their partition, the
first so many go to the first shard and so on, and are permuted again where they arrive. Only
the partitions' row counts meet on the driver, and the matrix goes back as a table, some of its rows at a time.

Inside a shard, rows are ordered by a second hash; its leading bits cut the shard into blocks of about BLOCK_ROWS rows, whose
exact sizes are counted, so that no task orders a whole shard.

Cases: NULLs in any column are hashed like values; repeated rows are told apart only by their place; rows that tie in both hashes
have equal keys, and take whatever order; very long texts are read but not moved, unless the caller keeps them; an
empty table gives an empty result; all columns pass through, whatever their names, and where one is named shard or slot already, the
new one, always among the last two, gets a trailing _.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovewise.llm.common import broadcast_if, fresh, name_of, stored

#: From so many rows on, numpy does not draw hypergeometric numbers.
LARGE = 1_000_000_000
#: Rows that one task orders after the exchange, about.
BLOCK_ROWS = 200_000
#: The matrix is broadcast up to so many numbers (8 bytes each), and written in pieces of so many.
BROADCAST_NUMBERS, PIECE = 1_000_000, 2_000_000


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Counts at most one apart, the larger ones first."""
    return np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)


def _log_rise(x: int, d: int) -> float:
    """log((x + d)! / x!) less d log(x + 1): exact to rounding also where factorials are too large to subtract."""
    z = x + 1
    if min(z, z + d) < 1 << 20:
        return math.lgamma(z + d) - math.lgamma(z) - d * math.log(z)
    return (z + d - 0.5) * math.log1p(d / z) - d + 1 / (12 * (z + d)) - 1 / (12 * z)


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good, at any size.

    Below LARGE this is numpy's; beyond, rejection from a flat top with exponential tails, which lies above every log-concave distribution
    (Devroye's method), by the probability's ratio to that of the mode."""
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), low), high)
    # (places, sign): what is divided by, as factorials, at the mode
    terms = ((mode, 1), (good - mode, -1), (n - mode, -1), (bad - n + mode, 1))
    ratio = math.log(((mode + 1) * (bad - n + mode + 1)) / ((good - mode + 1) * (n - mode + 1)))
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    top = 0.98 * min(1.0, math.exp(min(0.0, choose(good, mode) + choose(bad, n - mode) - choose(good + bad, n))))
    w = 1 + top / 2
    while True:
        y = rng.random() * w / top if rng.random() <= w / (1 + w) else (w + rng.standard_exponential()) / top
        x = round(y) * (1 if rng.random() < 0.5 else -1)
        k = mode + x
        if low <= k <= high:
            h = -x * ratio - sum(_log_rise(at, sign * x) for at, sign in terms)
            if math.log(1 - rng.random()) + min(0.0, w - top * y) <= h:
                return k


def split(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """n rows drawn without replacement from `left` of each kind: halves of the kinds take their shares, down to what numpy draws at once."""
    total = int(left.sum())
    if total < LARGE:
        return rng.multivariate_hypergeometric(left, n, method="marginals") if n else np.zeros_like(left)
    if len(left) == 1:
        return np.array([n], np.int64)
    half = len(left) // 2
    good = int(left[:half].sum())
    k = hypergeometric(rng, good, total - good, n)
    return np.concatenate([split(rng, left[:half], k), split(rng, left[half:], n - k)])


def draw(counts: list[int], sizes: np.ndarray, seed: int) -> Iterator[np.ndarray]:
    """For each partition, the rows it gives to each shard: they sum to the partition's count, and over partitions to the shards' sizes."""
    rng, left = np.random.default_rng(seed), sizes.astype(np.int64)
    for n in counts:
        out = split(rng, left, n)
        left = left - out
        yield out


def matrix(df: DataFrame, found: dict[int, int], shards: int, seed: int, partition: str, ends: str) -> DataFrame:
    """(partition, ends): where each shard's rows end among a partition's, in a stored table."""
    parts, spark = sorted(found), df.sparkSession
    rows = zip(parts, draw([found[p] for p in parts], shard_sizes(sum(found.values()), shards), seed))
    some, tables = [], []
    schema = f"{name_of(partition)} int, {name_of(ends)} array<bigint>"
    for p, n in rows:
        some.append((p, np.cumsum(n).tolist()))
        if len(some) * shards >= PIECE:
            tables.append(stored(spark.createDataFrame(some, schema), "matrix", narrow=True))
            some = []
    out = stored(spark.createDataFrame(some, schema), "matrix", narrow=True)
    for t in tables:
        out = out.unionByName(t)
    return out


def assign(df: DataFrame, shards: int, key: list[Column], seed: int = 0) -> DataFrame:
    """`df` with shard (int) and slot (long, from 0 without gaps in each shard).

    `key` are columns whose hash orders rows at random; ties keep whatever order, as they hold equal
    keys. The input must deal its rows to partitions alike whenever it is read (files, or an explicit
    repartition by number); a partition that has more or fewer rows than were counted fails the job."""
    shard, slot, part, one, two, place, ends, block, first, n = fresh(df, "shard", "slot", "_p", "_a", "_b", "_j", "_ends", "_block", "_first", "_n")
    hashes = (F.xxhash64(F.lit(f"{seed}/{i}"), *key) for i in (1, 2))
    placed = df.withColumn(part, F.spark_partition_id()).withColumns(dict(zip((one, two), hashes)))
    found = {r[0]: r[1] for r in placed.groupBy(part).agg(F.count("*").alias(n)).collect()}
    total = sum(found.values())
    bits = max(0, int(np.ceil(np.log2(max(1, total // shards) / BLOCK_ROWS))))
    table = broadcast_if(matrix(df, found, shards, seed, part, ends), len(found) * shards, BROADCAST_NUMBERS)

    # the hashes are computed where rows are read, and the count of a partition's rows is that of its places
    local = placed.sortWithinPartitions(one, two).withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    x = local.join(table, part)
    at = F.size(F.filter(F.col(ends), lambda e: e <= F.col(place)))
    x = x.withColumn(shard, F.when(at < shards, at).otherwise(F.raise_error(F.lit("a partition has more rows than were counted"))).cast("int"))
    x = x.withColumn(block, F.call_function("shiftrightunsigned", F.col(two), F.lit(64 - bits)) if bits else F.lit(0).cast("long"))
    order = F.row_number().over(W.partitionBy(shard, block).orderBy(F.col(two), F.col(one)))
    wrong = F.raise_error(F.lit("a partition has fewer rows than were counted"))
    rows = F.count("*").over(W.partitionBy(shard, block))
    if not bits:
        right = rows == total // shards + (F.col(shard) < total % shards).cast("long")
        return x.withColumn(slot, F.when(right, order - 1).otherwise(wrong).cast("long")).select(*map(name_of, df.columns), shard, slot)
    counts = stored(x.groupBy(shard, block).agg(F.count("*").alias(n)), "blocks", narrow=True)  # shards * rows / BLOCK_ROWS rows
    before = F.coalesce(F.sum(n).over(W.partitionBy(shard).orderBy(block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = counts.groupBy(shard).agg(F.sum(n).alias(n)).where(F.col(n) != total // shards + (F.col(shard) < total % shards).cast("long"))
    if not sums.isEmpty():
        raise ValueError("a partition has fewer rows than were counted")
    offsets = broadcast_if(counts.select(shard, block, before.alias(first), n), counts.count(), BROADCAST_NUMBERS)
    x = x.withColumns({slot: order, place: rows}).join(offsets, [shard, block])
    x = x.withColumn(slot, F.when(F.col(place) == F.col(n), F.col(slot) + F.col(first) - 1).otherwise(wrong).cast("long"))
    return x.select(*map(name_of, df.columns), shard, slot)


def write_shards(df: DataFrame, path: str, shards: int, key: list[Column], seed: int = 0) -> None:
    """The shards as folders shard=<k>, rows with their slots."""
    out = assign(df, shards, key, seed)
    shard, slot = out.columns[-2:]
    out.repartition(F.col(shard), F.floor(F.col(slot) / BLOCK_ROWS)).write.partitionBy(shard).parquet(path)
