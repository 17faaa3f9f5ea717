"""Sites and mutations: states, parents, order checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovewise.operators.spans import by_place, levels_or_places, stab
from grovewise.plans.lineage import cut, dealt, with_dense_id


def seq_mutations(sites: DataFrame, mutations: DataFrame, site_tree: DataFrame) -> DataFrame:
    """(mutation_id, site_id, tree_id, node, parent_state, derived_state): the state before a mutation is its
    parent mutation's, or else the site's ancestral state."""
    # a mutation tells its state under its own id, and asks for its parent's under that; without a parent it has nothing to ask, and no NULL is a key
    row = F.struct("mutation_id", "site_id", "node", "derived_state")
    tell = F.struct(F.col("mutation_id").alias("key"), F.lit(False).alias("asks"), F.col("derived_state").alias("state"), F.when(F.col("parent").isNull(), row).alias("row"))
    ask = F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("key"), F.lit(True).alias("asks"), F.lit(None).cast("string").alias("state"), row.alias("row")))
    rows = mutations.count()
    told = dealt(mutations.select(F.explode(F.array_compact(F.array(tell, ask))).alias("x")).select("x.*"), 2 * rows, "key")
    # the state told under a key comes first, and holds for all that ask
    state = F.first("state").over(W.partitionBy("key").orderBy("asks").rowsBetween(W.unboundedPreceding, 0))
    found = told.withColumn("_state", F.when(F.col("asks"), state)).where("row IS NOT NULL").select("row.*", "_state")
    at = sites.select("site_id", "ancestral_state").join(site_tree, "site_id")
    return dealt(found, rows, "site_id").join(dealt(at, rows, "site_id"), "site_id").select("mutation_id", "site_id", "tree_id", "node", F.coalesce("_state", "ancestral_state").alias("parent_state"), "derived_state")


def to_forest_nodes(seq: DataFrame, spans: DataFrame, size: int, optional: bool = False) -> DataFrame:
    """Mutations with the forest node of their node's range of trees, in chunks of `size` trees; unmapped ones are dropped, or kept with NULL if optional."""
    how = "left" if optional else "inner"
    s = spans.select("chunk", "node", "first", "last", "forest_node")
    if levels_or_places(seq, s, size) is None:  # mutations move once, as they are
        s, rows = by_place(s, "tree_id").select("tree_id", "node", "forest_node"), seq.count()
        return dealt(seq, rows, "tree_id", "node").join(dealt(s, rows, "tree_id", "node"), ["tree_id", "node"], how).select(*seq.columns, "forest_node")
    at = seq.select("mutation_id", F.floor(F.col("tree_id") / size).alias("chunk"), "node", "tree_id")
    return seq.join(stab(at, s, ["chunk", "node"], "tree_id", size).select("mutation_id", "forest_node"), "mutation_id", how)


def hit_forest_nodes(mutated: DataFrame, site_tree: DataFrame, spans: DataFrame, size: int) -> DataFrame:
    """(forest_node): the distinct forest nodes of mutations (site_id, node); a node that several mutations hit in a tree is looked up once."""
    rows = mutated.count()
    at = dealt(mutated, rows, "site_id").join(dealt(site_tree, rows, "site_id"), "site_id").select("tree_id", "node").distinct()
    at = cut(at.select(F.floor(F.col("tree_id") / size).alias("chunk"), "node", "tree_id"))
    return stab(at, spans.select("chunk", "node", "first", "last", "forest_node"), ["chunk", "node"], "tree_id", size).select("forest_node").distinct()


def mutations_at_site(seq: DataFrame, site_id: int) -> DataFrame:
    return seq.where(F.col("site_id") == site_id)


def mutation_ranges(mutations: DataFrame) -> DataFrame:
    """(site_id, first_mutation, num_mutations): the slice of each site's mutations."""
    return mutations.groupBy("site_id").agg(F.min("mutation_id").alias("first_mutation"), F.count("*").alias("num_mutations"))


def set_ancestral_state(sites: DataFrame, site_id: int, state: str) -> DataFrame:
    return sites.withColumn("ancestral_state", F.when(F.col("site_id") == site_id, F.lit(state)).otherwise(F.col("ancestral_state")))


def append_sites(sites: DataFrame, more: DataFrame) -> DataFrame:
    """Sites with (position, ancestral_state) of `more` numbered after them, in order of position."""
    top = sites.agg(F.coalesce(F.max("site_id") + 1, F.lit(0)).alias("_top"))
    numbered = with_dense_id(more.select("position", "ancestral_state"), ["position", "ancestral_state"], "_id")
    return sites.select("site_id", "position", "ancestral_state").unionByName(numbered.join(F.broadcast(top), F.lit(True)).select((F.col("_id") + F.col("_top")).alias("site_id"), "position", "ancestral_state"))


def append_mutations(seq: DataFrame, more: DataFrame) -> DataFrame:
    """Mutations with their states; those of `more` (site_id, tree_id, node, parent_state, derived_state) are numbered after them, by site and node."""
    top = seq.agg(F.coalesce(F.max("mutation_id") + 1, F.lit(0)).alias("_top"))
    numbered = with_dense_id(more, ["site_id", "node"], "_id")
    return seq.unionByName(numbered.join(F.broadcast(top), F.lit(True)).select((F.col("_id") + F.col("_top")).alias("mutation_id"), "site_id", "tree_id", "node", "parent_state", "derived_state"))


def is_sorted(df: DataFrame, order: Column | str, by: str, partition: Column | None = None) -> DataFrame:
    """One row, `ok`: `by` never falls along `order`.

    Neighbours are compared inside the blocks of `partition`, and the blocks' ends with each other, so
    no single task sorts the table."""
    block = (F.floor(F.col(order) / 65536) if partition is None else partition).alias("_b")
    x = df.select(F.col(order).alias("_o"), F.col(by).alias("_v"), block)
    inside = x.withColumn("_bad", F.lag("_v").over(W.partitionBy("_b").orderBy("_o")) > F.col("_v"))
    ends = inside.groupBy("_b").agg(F.max_by("_v", "_o").alias("_last"), F.min_by("_v", "_o").alias("_first"), F.coalesce(F.bool_or("_bad"), F.lit(False)).alias("_bad"))
    across = ends.withColumn("_bad", F.col("_bad") | F.coalesce(F.lag("_last").over(W.orderBy("_b")) > F.col("_first"), F.lit(False)))
    return across.agg((~F.coalesce(F.bool_or("_bad"), F.lit(False))).alias("ok"))
