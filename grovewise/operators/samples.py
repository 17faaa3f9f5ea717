"""Sample sets, and the number of each set's samples below every node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.operators.contract import fold_up


#: Sets whose complements are listed at once.
MANY_SETS = 1000


def sample_sets(samples: DataFrame, rule: Column) -> DataFrame:
    """(set_id, sample_id): each sample in the set that `rule` over sample_id names; NULL: in none."""
    return samples.select(rule.cast("string").alias("set_id"), "sample_id").where("set_id IS NOT NULL")


def round_robin(k: int) -> Column:
    return F.col("sample_id") % k


def every_nth(n: int) -> Column:
    return F.when(F.col("sample_id") % n == 0, F.lit(0))


def random_pairs(samples: DataFrame, n: int, seed: int) -> DataFrame:
    """(pair, u, v): n pairs of different samples, uniformly and alike for a seed. Sample ids are 0, 1, 2, ...; fewer than two have no pairs."""
    size = samples.agg(F.count("*").alias("_n"))
    draw = samples.sparkSession.range(n, numPartitions=1).select(F.col("id").alias("pair"), F.rand(seed).alias("_a"), F.rand(seed + 1).alias("_b"))
    u = F.floor(F.col("_a") * F.col("_n"))
    v = (u + 1 + F.floor(F.col("_b") * (F.col("_n") - 1))) % F.col("_n")
    return draw.join(F.broadcast(size), F.lit(True)).where("_n > 1").select("pair", u.alias("u"), v.alias("v"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def remove(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["set_id", "sample_id"], "left_anti")


def inverse(sets: DataFrame, samples: DataFrame) -> DataFrame:
    """Each set's complement in `samples`: as many rows as sets times samples, less the members. More than MANY_SETS sets are an error."""
    ids = sets.select("set_id").distinct()
    if (n := ids.limit(MANY_SETS + 1).count()) > MANY_SETS:
        raise ValueError(f"complements of more than {MANY_SETS} sets are not listed")
    every = samples.select("sample_id", F.explode(F.array(*(F.lit(r.set_id) for r in ids.collect()))).alias("set_id")) if n else samples.select("sample_id", F.lit(None).cast("string").alias("set_id")).where("false")
    return every.join(sets, ["set_id", "sample_id"], "left_anti").select("set_id", "sample_id")


def popcount(sets: DataFrame) -> DataFrame:
    return sets.groupBy("set_id").agg(F.count_distinct("sample_id").alias("num_samples"))


def lanes(samples: DataFrame, rules: list[Column]) -> DataFrame:
    """(sample_id, n_0, n_1, ...): 1 where the rule (a boolean over sample_id) puts the sample into that set."""
    return samples.select("sample_id", *(F.coalesce(r.cast("long"), F.lit(0).cast("long")).alias(f"n_{i}") for i, r in enumerate(rules)))


def samples_below(edges: DataFrame, lanes: DataFrame, by: tuple[str, ...] = ("tree_id",)) -> DataFrame:
    """(by..., node, n_0, ..., height): samples of each set in the subtree of each node; all sets in one pass.

    `edges` has `by`, parent, child: the edges of trees, or with by=() those of a DAG, where an edge
    that occurs twice counts twice, and samples without edges are nodes as well. Counts move up by tree contraction: rounds are logarithmic in
    the nodes, and an edge is shuffled only while it is open."""
    n = [c for c in lanes.columns if c != "sample_id"]
    return fold_up(edges, lanes.withColumnRenamed("sample_id", "node"), n, by, all_leaves=not by)
