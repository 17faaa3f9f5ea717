"""Forest compression: equal subtrees of all trees stored once, as a DAG.

A subtree's identity is a pair of 64-bit hashes: a leaf's comes from its sample id, an inner node's from
the XOR of its children's, hashed again, so the order of children does not matter. Everything here has a row for each version of a
subtree (see `spans`), not for each tree; only roots, of which every tree has one, are taken tree by tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.operators.spans import latest, per_tree, stab
from grovewise.plans.lineage import cut, with_dense_id

SPAN = ["chunk", "node", "first", "last", "parent", "forest_node", "created", "is_root", "height", "hi", "lo"]


def subtree_hashes(subtrees: DataFrame) -> DataFrame:
    """(tree_id, node, height, hi, lo): a row for each node of each tree."""
    return per_tree(subtrees).select("tree_id", "node", "height", "hi", "lo")


def node_spans(subtrees: DataFrame, samples: DataFrame, size: int) -> DataFrame:
    """(chunk, node, first, last, parent, forest_node, created, is_root, height, hi, lo): which DAG node stands for a node, by ranges of trees.

    Samples keep their ids. Any other node makes a DAG node where its subtree is seen first, in order
    of (tree, height, node), and a root always does. A repeated subtree maps to the latest node made for it. `created`: the
    DAG node is made in the range's first tree. `size`: trees of a chunk."""
    n = samples.agg(F.count("*").alias("_n"))
    x = subtrees.withColumn("is_root", F.col("parent").isNull())
    inner = x.where("height > 0")
    at = F.struct(F.col("first").alias("tree_id"), "height", "node")
    # where each subtree is seen first, combined before the shuffle, and in how many trees it is the root
    roots = F.sum(F.when(F.col("is_root"), F.col("last") - F.col("first")).otherwise(0))
    keys = cut(inner.groupBy("hi", "lo").agg(F.min(at).alias("_first"), F.min_by("is_root", at).alias("_r"), roots.alias("_roots")))
    keys = keys.select("hi", "lo", "_first", (F.col("_roots") > F.col("_r").cast("long")).alias("_again"))
    often = inner.join(keys.where("_again"), ["hi", "lo"])
    each = cut(per_tree(often.where("is_root")).select("tree_id", "height", "node", "hi", "lo", "_first"))  # at most one a tree
    place = F.struct("tree_id", "height", "node")
    made = keys.select("hi", "lo", "_first.*").unionByName(each.where(place != F.col("_first")).select("hi", "lo", "tree_id", "height", "node"))
    ids = with_dense_id(made, ["tree_id", "height", "node"], "_i").join(F.broadcast(n), F.lit(True)).select("hi", "lo", "tree_id", (F.col("_i") + F.col("_n")).alias("id"))
    # a subtree is at most once in a tree, so its tree tells where it was made
    once = keys.where("NOT _again").join(ids, ["hi", "lo"]).select("hi", "lo", "_first", "id")
    single = inner.join(once, ["hi", "lo"]).select(*SPAN[:5], F.col("id").alias("forest_node"), (F.col("first") == F.col("_first.tree_id")).alias("created"), *SPAN[7:])
    own = each.join(ids, ["hi", "lo", "tree_id"]).select(
        F.floor(F.col("tree_id") / size).alias("chunk"), "node", F.col("tree_id").alias("first"), (F.col("tree_id") + 1).alias("last"), F.lit(None).cast("long").alias("parent"),
        F.col("id").alias("forest_node"), F.lit(True).alias("created"), F.lit(True).alias("is_root"), "height", "hi", "lo",
    )
    # of a subtree that is the root of several trees there is a node for each; what repeats it takes the latest
    asked = often.where("NOT is_root").select(*SPAN[:5], *SPAN[7:], "_first", F.col("first").alias("at"))
    taken = latest(asked, ids.join(keys.where("_again").select("hi", "lo"), ["hi", "lo"], "left_semi").withColumnRenamed("tree_id", "at"), ["hi", "lo"], size)
    taken = taken.select(*SPAN[:5], F.col("id").alias("forest_node"), (F.col("first") == F.col("_first.tree_id")).alias("created"), *SPAN[7:])
    leaves = x.where("height = 0").select(*SPAN[:5], F.col("node").alias("forest_node"), F.lit(False).alias("created"), *SPAN[7:])
    return single.unionByName(own).unionByName(taken).unionByName(leaves)


def node_map(node_spans: DataFrame) -> DataFrame:
    """(tree_id, ts_node, forest_node, created, is_root, height, hi, lo): the same, tree by tree."""
    x = node_spans.withColumn("_at", F.when(F.col("created"), F.col("first")))
    return per_tree(x).select("tree_id", F.col("node").alias("ts_node"), "forest_node", (F.col("tree_id") == F.coalesce("_at", F.lit(-1))).alias("created"), "is_root", "height", "hi", "lo")


def dag_links(node_spans: DataFrame, size: int) -> DataFrame:
    """(parent, child): the edges of created nodes, in no order."""
    made = node_spans.where("created").select("chunk", F.col("node").alias("parent"), F.col("first").alias("_at"), F.col("forest_node").alias("_from"))
    child = node_spans.where("parent IS NOT NULL").select("chunk", "parent", "first", "last", F.col("forest_node").alias("_to"))
    return stab(made, child, ["chunk", "parent"], "_at", size).select(F.col("_from").alias("parent"), F.col("_to").alias("child"))


def dag_edges(node_spans: DataFrame, size: int) -> DataFrame:
    """(rank, parent, child): the edges of created nodes, children before parents by rank."""
    return with_dense_id(dag_links(node_spans, size), ["parent", "child"], "rank").select("rank", "parent", "child")


def dag_roots(node_spans: DataFrame) -> DataFrame:
    """(tree_id, node): one root per tree."""
    return per_tree(node_spans.where("is_root")).select("tree_id", F.col("forest_node").alias("node"))


def unique_subtrees(node_spans: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: subtrees that differ, samples included; and DAG nodes, where each root counts."""
    inner = node_spans.where("height > 0").agg(F.count_distinct("hi", "lo").alias("_u"), F.coalesce(F.sum(F.col("created").cast("long")), F.lit(0)).alias("_c"))
    n = samples.agg(F.count("*").alias("_n"))
    return inner.join(F.broadcast(n), F.lit(True)).select((F.col("_u") + F.col("_n")).alias("unique_subtrees"), (F.col("_c") + F.col("_n")).alias("dag_nodes"))
