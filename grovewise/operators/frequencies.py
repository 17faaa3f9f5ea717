"""Per-site allele counts of one or more sample sets.

A mutation moves the samples below its node from the parent state to the derived state, and every
site starts with all samples in the ancestral state. So counts are sums of signed rows, silent
mutations cancel, and sites without mutations keep their one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.plans.lineage import dealt


def _lanes(df: DataFrame) -> list[str]:
    return sorted((c for c in df.columns if c.startswith("n_") and c[2:].isdigit()), key=lambda c: int(c[2:]))


def moves(seq: DataFrame, below: DataFrame, lanes: DataFrame, by: tuple[str, ...] = ("tree_id", "node")) -> DataFrame:
    """(site_id, state, n_0, ...): what mutations add to a state's counts and take from another's, added up.

    `seq` has the mutations with `by`, the key of `below`. A node without edges counts as its own
    sample, or as nothing."""
    n = _lanes(below)
    m = seq.where("derived_state <> parent_state")
    if by == ("forest_node",):  # one table of both, and no NULL is a key: what has no forest node is its own sample
        own = lanes.select((-1 - F.col("sample_id")).alias("_key"), *n)
        m = m.withColumn("_key", F.coalesce("forest_node", -1 - F.col("node")))
        rows, known = m.count(), below.select(F.col("forest_node").alias("_key"), *n).unionByName(own)
        m = dealt(m, rows, "_key").join(dealt(known, rows, "_key"), "_key", "left")
        m = m.select("site_id", "parent_state", "derived_state", *(F.coalesce(F.col(c), F.lit(0)).alias(c) for c in n))
    else:
        m = m.join(below.select(*by, *n), list(by), "left").join(lanes.select(F.col("sample_id").alias("node"), *(F.col(c).alias(f"_own{c}") for c in n)), "node", "left")
        m = m.select("site_id", "parent_state", "derived_state", *(F.coalesce(F.col(c), F.col(f"_own{c}"), F.lit(0)).alias(c) for c in n))
    m = m.groupBy("site_id", "parent_state", "derived_state").agg(*(F.sum(c).alias(c) for c in n))  # before a row becomes two
    signed = F.explode(F.array(*(F.struct(F.col(s).alias("state"), *((k * F.col(c)).alias(c) for c in n)) for s, k in (("derived_state", 1), ("parent_state", -1))))).alias("r")
    return m.select("site_id", signed).select("site_id", "r.*").groupBy("site_id", "state").agg(*(F.sum(c).alias(c) for c in n))


def counted(sites: DataFrame, moves: DataFrame, lanes: DataFrame) -> DataFrame:
    """(site_id, state, is_ancestral, n_0, ...): rows where some set has the state, from the moves of any number of batches."""
    n = _lanes(moves)
    total = lanes.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in n))
    start = sites.select("site_id", F.col("ancestral_state").alias("state")).join(F.broadcast(total), F.lit(True))  # one row
    counts = moves.select("site_id", "state", *n).unionByName(start).groupBy("site_id", "state").agg(*(F.sum(c).alias(c) for c in n))
    counts = counts.where(" OR ".join(f"{c} > 0" for c in n))
    return counts.join(sites.select("site_id", "ancestral_state"), "site_id").select("site_id", "state", (F.col("state") == F.col("ancestral_state")).alias("is_ancestral"), *n)


def allele_counts(sites: DataFrame, seq: DataFrame, below: DataFrame, lanes: DataFrame, by: tuple[str, ...] = ("tree_id", "node")) -> DataFrame:
    """(site_id, state, is_ancestral, n_0, ...): rows where some set has the state."""
    return counted(sites, moves(seq, below, lanes, by), lanes)


def site_kind(sites: DataFrame, seq: DataFrame, below: DataFrame, column: str = "n_0", by: tuple[str, ...] = ("tree_id", "node")) -> DataFrame:
    """(site_id, is_multiallelic): a site leaves the biallelic form when a mutation to a third state has samples
    of the set below it, even if that state vanishes later. The second state is the first one that a
    mutation brings which is not ancestral."""
    m = seq.select(*by, "site_id", "mutation_id", F.col("derived_state").alias("state"))
    rows = m.count()
    m = dealt(m.where(f"{by[-1]} IS NOT NULL"), rows, *by).join(dealt(below.select(*by, F.col(column).alias("_b")), rows, *by), list(by), "left").unionByName(m.where(f"{by[-1]} IS NULL"), allowMissingColumns=True)
    # a site's states, each with its first mutation and whether any has samples: numbers, so that no site's mutations are sorted
    states = m.groupBy("site_id", "state").agg(F.min("mutation_id").alias("_id"), F.max((F.coalesce("_b", F.lit(0)) > 0).cast("int")).alias("_any"))
    states = states.join(sites.select("site_id", "ancestral_state"), "site_id").where("state <> ancestral_state")
    third = states.groupBy("site_id").agg((F.sum("_any") > F.min_by("_any", "_id")).alias("is_multiallelic"))
    return sites.select("site_id").join(third, "site_id", "left").select("site_id", F.coalesce("is_multiallelic", F.lit(False)).alias("is_multiallelic"))


def allele_frequencies(counts: DataFrame, kind: DataFrame, column: str = "n_0") -> DataFrame:
    """(site_id, kind, num_ancestral, counts): the presentation form; counts by state for multiallelic sites only."""
    per = counts.where(F.col(column) > 0).groupBy("site_id").agg(
        F.coalesce(F.sum(F.when(F.col("is_ancestral"), F.col(column))), F.lit(0)).alias("num_ancestral"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", F.col(column).alias("n"))))).alias("counts"),
    )
    multi = F.col("is_multiallelic")
    return kind.join(per, "site_id", "left").select("site_id", F.when(multi, "multiallelic").otherwise("biallelic").alias("kind"), F.coalesce("num_ancestral", F.lit(0)).alias("num_ancestral"), F.when(multi, F.col("counts")).alias("counts"))


def invalid_sites(counts: DataFrame, lanes: DataFrame) -> DataFrame:
    """Sites whose counts do not sum to the sets' sizes; none, if the tables are sound."""
    n = _lanes(counts)
    size = lanes.agg(*(F.sum(c).alias(f"_{c}") for c in n))
    return counts.groupBy("site_id").agg(*(F.sum(c).alias(c) for c in n)).join(F.broadcast(size), F.lit(True)).where(" OR ".join(f"{c} <> _{c}" for c in n)).select("site_id")
