"""Edge-list graph operators: (rank, parent, child) tables with roots and leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.operators.sequence import is_sorted


def nodes(edges: DataFrame, roots: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node): the distinct ends of edges, roots and leaves."""
    ends = edges.select(F.explode(F.array("parent", "child")).alias("node"))
    return ends.unionByName(roots.select("node")).unionByName(leaves.select("node")).distinct()


def insert_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges may repeat; new ones are ranked after the old."""
    top = edges.agg(F.coalesce(F.max("rank") + 1, F.lit(0)).alias("_top"))
    return edges.unionByName(more.join(F.broadcast(top), F.lit(True)).select((F.col("rank") + F.col("_top")).alias("rank"), "parent", "child"))


def adjacency(edges: DataFrame, *by: str) -> DataFrame:
    """(*by, node, neighbours): sorted lists, for each graph that `by` tells apart; repeated edges stay repeated."""
    return edges.groupBy(*by, F.col("parent").alias("node")).agg(F.array_sort(F.collect_list("child")).alias("neighbours"))


def has_edge(edges: DataFrame, parent: int, child: int) -> DataFrame:
    return edges.where((F.col("parent") == parent) & (F.col("child") == child)).agg((F.count("*") > 0).alias("found"))


def is_leaf(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("node")).distinct().join(leaves, "node", "left_semi")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """(parent, child, times): edges that occur more than once."""
    return edges.groupBy("parent", "child").agg(F.count("*").alias("times")).where("times > 1")


def duplicate_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node").agg(F.count("*").alias("times")).where("times > 1")


def sort_edges(edges: DataFrame, *by: Column | str) -> DataFrame:
    return edges.orderBy(*by)


def edges_are_sorted(edges: DataFrame, by: str) -> DataFrame:
    return is_sorted(edges, "rank", by)


def postorder_violations(edges: DataFrame, nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(node, problem): nodes used as a child before their own edges are complete, and inner nodes without edges."""
    done = edges.groupBy(F.col("parent").alias("node")).agg(F.max("rank").alias("_done"))
    used = edges.groupBy(F.col("child").alias("node")).agg(F.min("rank").alias("_used"))
    early = done.join(used, "node").where("_used < _done").select("node", F.lit("used before it is complete").alias("problem"))
    never = nodes.join(leaves, "node", "left_anti").join(done, "node", "left_anti").select("node", F.lit("never visited").alias("problem"))
    return early.unionByName(never)
