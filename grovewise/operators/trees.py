"""Trees, their edges, and traversals.

The edge table is interval-stamped; the tree ids it covers are found by equi-joins on breakpoints, so
no join here compares every edge with every tree. Materialised per-tree edges are meant for
selections of trees; `spans` and `compress` work without them. Orders come from sizes of subtrees, so no task takes a whole tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovewise.operators.contract import add_down, fold_up, running
from grovewise.operators.spans import per_tree, stab
from grovewise.plans.lineage import cut, with_dense_id

#: Genome bins in which sites meet trees.
BINS = 1024


def breakpoints(edges: DataFrame) -> DataFrame:
    """(index, position): the distinct edge ends in genome order, the last one included."""
    ends = edges.select(F.explode(F.array("left", "right")).alias("position")).distinct()
    return with_dense_id(ends, ["position"], "index").select("index", "position")


def trees(breakpoints: DataFrame) -> DataFrame:
    """(tree_id, left, right): one row per interval between neighbouring breakpoints."""
    after = breakpoints.select((F.col("index") - 1).alias("index"), F.col("position").alias("right"))
    return breakpoints.join(after, "index").select(F.col("index").alias("tree_id"), F.col("position").alias("left"), "right")


def tree_edges(pieces: DataFrame) -> DataFrame:
    """(tree_id, parent, child): every edge in every tree that it holds for, from edges as ranges of trees. Nothing but selections of trees needs it."""
    return per_tree(pieces).select("tree_id", "parent", "child")


def site_to_tree(sites: DataFrame, trees: DataFrame, sequence_length: float) -> DataFrame:
    """(site_id, tree_id): the tree whose [left, right) holds the position.

    Sites and left ends are put in one order inside each genome bin, where a site takes the last tree that began at or before it;
    the last tree that began before a bin comes from a row of at most one entry a bin. No site is compared with several trees."""
    width = max(float(sequence_length), 1e-300) / BINS
    tree = F.struct(F.col("left").alias("at"), "tree_id", "right")
    starts = trees.select(F.col("left").alias("position"), F.lit(None).cast(sites.schema["site_id"].dataType).alias("site_id"), tree.alias("_tree"))
    both = starts.unionByName(sites.select("position", "site_id"), allowMissingColumns=True).withColumn("_bin", F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(F.col("position") / width))))
    so_far = W.partitionBy("_bin").orderBy("position", F.col("_tree").isNull()).rowsBetween(W.unboundedPreceding, 0)
    latest = both.withColumn("_own", F.last("_tree", ignorenulls=True).over(so_far)).where("_tree IS NULL")
    ends = both.where("_tree IS NOT NULL").groupBy("_bin").agg(F.max("_tree").alias("_tree")).agg(F.sort_array(F.collect_list(F.struct("_bin", "_tree"))).alias("_ends"))
    earlier = F.expr("get(filter(_ends, e -> e._bin < _bin), size(filter(_ends, e -> e._bin < _bin)) - 1)._tree")
    found = latest.join(F.broadcast(ends), F.lit(True)).withColumn("_in", F.coalesce("_own", earlier))
    return found.where("position < _in.right").select("site_id", F.col("_in.tree_id").alias("tree_id"))


def roots(coverage: DataFrame) -> DataFrame:
    """(tree_id, node): parents that are nobody's child in their tree, from `spans.coverage`."""
    return per_tree(coverage.where("below > 0 AND above = 0")).select("tree_id", "node")


def children(tree_edges: DataFrame, parent: int | None = None) -> DataFrame:
    """(tree_id, parent, position, child): the children of each node, or of one, in each tree, from left to right."""
    left_to_right = W.partitionBy("tree_id", "parent").orderBy("child")
    e = tree_edges if parent is None else tree_edges.where(F.col("parent") == parent)
    return e.select("tree_id", "parent", (F.row_number().over(left_to_right) - 1).alias("position"), "child")


def node_summary(tree_edges: DataFrame) -> DataFrame:
    """(tree_id, node, parent, num_children): one row per node and tree; the parent of a root is NULL."""
    up = tree_edges.select("tree_id", F.col("child").alias("node"), "parent", F.lit(0).alias("n"))
    down = tree_edges.select("tree_id", F.col("parent").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(1).alias("n"))
    return up.unionByName(down).groupBy("tree_id", "node").agg(F.max("parent").alias("parent"), F.sum("n").alias("num_children"))


def invalidated_nodes(edges: DataFrame, trees: DataFrame, pieces: DataFrame, size: int) -> DataFrame:
    """(tree_id, node): nodes whose subtree may differ from the tree before: the parents of edges that
    end or begin at the tree's left border, and their ancestors in the tree. The first tree has none.

    `pieces` are the edges by ranges of trees, in chunks of `size` trees; a round climbs by one level."""
    border = trees.where("tree_id > 0").select("tree_id", F.col("left").alias("at"))
    changed = edges.select(F.col("left").alias("at"), "parent").unionByName(edges.select(F.col("right").alias("at"), "parent"))
    found = changed.join(border, "at").select("tree_id", F.col("parent").alias("node")).distinct()
    frontier = found = cut(found)
    while not frontier.isEmpty():
        at = frontier.select("tree_id", F.col("node").alias("child"), F.floor(F.col("tree_id") / size).alias("chunk"))
        up = stab(at, pieces, ["chunk", "child"], "tree_id", size).select("tree_id", F.col("parent").alias("node")).distinct()
        frontier = cut(up.join(found, ["tree_id", "node"], "left_anti"))
        found = found.unionByName(frontier)
    return found


def _sizes(tree_edges: DataFrame, own: DataFrame) -> DataFrame:
    """(tree_id, node, parent, size, before): sums of `own` (tree_id, node, size) at and below each node, and over its earlier siblings."""
    up = tree_edges.select("tree_id", F.col("child").alias("node"), "parent")
    size = fold_up(tree_edges, own, ["size"], ("tree_id",), all_leaves=True).drop("height")
    x = cut(size.join(up, ["tree_id", "node"], "left"))
    top = x.where("parent IS NULL").withColumn("before", F.lit(0).cast("long"))
    return cut(top.unionByName(running(x.where("parent IS NOT NULL"), ["tree_id", "parent"], "node", "size", "before")))


def _nodes(tree_edges: DataFrame) -> DataFrame:
    return tree_edges.select("tree_id", F.explode(F.array("parent", "child")).alias("node")).distinct()


def eulertour(tree_edges: DataFrame, samples: DataFrame) -> DataFrame:
    """(tree_id, position, node, visit): inner nodes appear as 'first' and 'second', samples once as 'leaf'; children by id.

    A node comes behind its parent's first visit and what its earlier siblings take."""
    own = _nodes(tree_edges).join(samples.select(F.col("node_id").alias("node"), F.lit(True).alias("_leaf")), "node", "left")
    x = _sizes(tree_edges, own.select("tree_id", "node", F.when(F.col("_leaf"), 1).otherwise(2).cast("long").alias("size")))
    x = x.withColumn("_off", F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.col("before") + 1).cast("long"))
    at = add_down(x.select("tree_id", "node", "parent", "_off"), ["_off"], ("tree_id",)).join(x.select("tree_id", "node", "size"), ["tree_id", "node"])
    at = at.join(samples.select(F.col("node_id").alias("node"), F.lit(True).alias("_leaf")), "node", "left")
    visit = lambda p, v: F.struct(p.alias("position"), F.lit(v).alias("visit"))
    steps = F.when(F.col("_leaf"), F.array(visit(F.col("_off"), "leaf"))).otherwise(F.array(visit(F.col("_off"), "first"), visit(F.col("_off") + F.col("size") - 1, "second")))
    return at.select("tree_id", "node", F.explode(steps).alias("s")).select("tree_id", "s.position", "node", "s.visit")


def postorder(tree_edges: DataFrame) -> DataFrame:
    """(tree_id, position, node): children before parents, the root last; children by id."""
    x = _sizes(tree_edges, _nodes(tree_edges).select("tree_id", "node", F.lit(1).cast("long").alias("size")))
    at = add_down(x.select("tree_id", "node", "parent", "before"), ["before"], ("tree_id",)).join(x.select("tree_id", "node", "size"), ["tree_id", "node"])
    return at.select("tree_id", (F.col("before") + F.col("size") - 1).alias("position"), "node")


def lca(below: DataFrame, set_size: int, column: str = "n_0") -> DataFrame:
    """(tree_id, node): per tree the lowest node above all of a set's samples. Fewer than two samples: NULL nodes.

    Ancestors of the answer hold as many samples but are strictly higher."""
    if set_size < 2:
        return below.select("tree_id", F.lit(None).cast("long").alias("node")).distinct()
    return below.where(F.col(column) == set_size).groupBy("tree_id").agg(F.min_by("node", "height").alias("node"))
