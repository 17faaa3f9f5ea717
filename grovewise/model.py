"""The data model: interval-stamped genealogies as DataFrames.

Row order carries no meaning; every table has explicit ids. A missing id is NULL. Intervals are
half-open: an edge holds on [left, right), a site belongs to the tree whose interval holds its position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = "node_id BIGINT, is_sample BOOLEAN, time DOUBLE, population INT, individual INT"
EDGES = "left DOUBLE, right DOUBLE, parent BIGINT, child BIGINT"
SITES = "site_id BIGINT, position DOUBLE, ancestral_state STRING"
MUTATIONS = "mutation_id BIGINT, site_id BIGINT, node BIGINT, derived_state STRING, parent BIGINT, time DOUBLE"
INDIVIDUALS = "individual_id INT, flags INT, location ARRAY<DOUBLE>, parents ARRAY<INT>"
MIGRATIONS = "left DOUBLE, right DOUBLE, node INT, source INT, dest INT, time DOUBLE"


@dataclass(frozen=True)
class TreeTables:
    """The input tables of a tree sequence and the length of its genome."""

    nodes: DataFrame
    edges: DataFrame
    sites: DataFrame
    mutations: DataFrame
    sequence_length: float
    individuals: DataFrame | None = None
    migrations: DataFrame | None = None

    @property
    def mutated(self) -> DataFrame:
        """(site_id, node): a row for each mutation, for what asks neither for its number nor for its states."""
        return self.mutations.select("site_id", "node")


def sample_ids_are_consecutive(nodes: DataFrame) -> DataFrame:
    """One row, `ok`: the sample ids are exactly 0..n-1. True for no samples."""
    s = nodes.where("is_sample")
    return s.agg(F.coalesce((F.min("node_id") == 0) & (F.max("node_id") == F.count("*") - 1) & (F.count_distinct("node_id") == F.count("*")), F.lit(True)).alias("ok"))


def is_discrete_genome(t: TreeTables) -> DataFrame:
    """One row, `ok`: every edge end and site position is a whole number."""
    x = t.edges.select(F.explode(F.array("left", "right")).alias("p")).unionByName(t.sites.select(F.col("position").alias("p")))
    return x.agg(F.coalesce(F.every(F.col("p") == F.floor("p")), F.lit(True)).alias("ok"))


def violations(t: TreeTables, coverage: DataFrame, roots: DataFrame) -> DataFrame:
    """(check, violations): the preconditions of the statistics, with the number of rows that break each.

    `coverage` has the stretches (node, first, last, above, below) of trees with so many edges above and below a node; `roots` has tree_id."""

    def count(name: str, df: DataFrame, rows: str = "1") -> DataFrame:
        return df.agg(F.lit(name).alias("check"), F.coalesce(F.sum(F.expr(rows)).cast("long"), F.lit(0)).alias("violations"))

    samples = t.nodes.where("is_sample")
    found = [
        count("sample ids are 0..n-1", sample_ids_are_consecutive(t.nodes).where(~F.col("ok"))),
        count("one root per tree", roots.groupBy("tree_id").count().where("count > 1")),
        count("samples are leaves", coverage.join(samples, coverage.node == samples.node_id, "left_semi"), "below * (last - first)"),
        count("one parent per node and tree", coverage.where("above > 1"), "last - first"),
        count("alleles are one character", t.sites.select(F.col("ancestral_state").alias("s")).unionByName(t.mutations.select(F.col("derived_state").alias("s"))).where("s IS NULL OR char_length(s) <> 1")),
        count("edges end after they begin", t.edges.where("NOT left < right")),
    ]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
