"""The forest as balanced parentheses with references to subtrees written before.

A tree is written in preorder with children by id. A node opens and closes a pair; a subtree that an
earlier tree has written is one pair marked as a reference, and nothing below it is written.

Positions come from sizes: a pair's length is 2 and that of all pairs inside it, and it opens behind its parent and its earlier
siblings. Reading back needs no tree's tokens together either: depths are running sums in blocks, and the pair that closes at a depth, or that
encloses one, is the latest that opened at that depth, found inside a block or carried over from the blocks before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovewise.operators.contract import add_down, fold_up, running
from grovewise.operators.spans import latest, per_tree, stab
from grovewise.plans.lineage import cut, with_dense_id

#: Positions whose running sums one task takes.
BLOCK = 1 << 18


def written(subtrees: DataFrame, size: int) -> DataFrame:
    """(tree_id, node, parent, hi, lo, leaf, new): every pair that is written; a subtree is new in the first tree that has it.

    Those are the trees' roots, and the children, in that tree, of what is new. A subtree is at most once in a tree."""
    keys = cut(subtrees.groupBy("hi", "lo").agg(F.min(F.struct("first", "chunk", "node")).alias("_first"), F.min("height").alias("height")))
    seen = keys.select("hi", "lo", F.col("_first.first").alias("_tree"))
    new = keys.where("height > 0").select("_first.chunk", F.col("_first.node").alias("parent"), F.col("_first.first").alias("tree_id"))
    # a new pair's parent at its first tree is new as well, but the same node may be there before and after
    children = stab(new, subtrees.where("parent IS NOT NULL"), ["chunk", "parent"], "tree_id", size).select("tree_id", "node", "parent", "hi", "lo", "height")
    roots = per_tree(subtrees.where("parent IS NULL")).select("tree_id", "node", "parent", "hi", "lo", "height")
    x = roots.unionByName(children).join(seen, ["hi", "lo"])
    return x.select("tree_id", "node", "parent", "hi", "lo", (F.col("height") == 0).alias("leaf"), (F.col("tree_id") == F.col("_tree")).alias("new"))


def pairs(subtrees: DataFrame, samples: DataFrame, size: int) -> DataFrame:
    """(tree_id, node, parent, hi, lo, leaf, new, open, close, id): written pairs with their positions; id: the sample, or the inner node's number
    in order of closing, after the samples, also where a pair refers to it."""
    x = cut(written(subtrees, size))
    own = x.select("tree_id", "node", F.lit(2).cast("long").alias("size"))
    inside = x.where("parent IS NOT NULL").select("tree_id", "parent", F.col("node").alias("child"))
    x = x.join(fold_up(inside, own, ["size"], ("tree_id",), all_leaves=True).drop("height"), ["tree_id", "node"])
    roots = running(x.where("parent IS NULL"), [], "tree_id", "size", "_off")
    others = running(x.where("parent IS NOT NULL"), ["tree_id", "parent"], "node", "size", "_off").withColumn("_off", F.col("_off") + 1)
    x = cut(roots.unionByName(others))
    at = add_down(x.select("tree_id", "node", "parent", "_off"), ["_off"], ("tree_id",)).withColumnRenamed("_off", "open")
    x = x.drop("_off").join(at, ["tree_id", "node"]).withColumn("close", F.col("open") + F.col("size") - 1)
    n = samples.agg(F.count("*").alias("_n"))
    ids = with_dense_id(x.where("new AND NOT leaf").select("close", "hi", "lo"), ["close"], "_id").join(F.broadcast(n), F.lit(True)).select("hi", "lo", (F.col("_id") + F.col("_n")).alias("_id"))
    return cut(x.join(ids, ["hi", "lo"], "left").select("tree_id", "node", "parent", "hi", "lo", "leaf", "new", "open", "close", F.coalesce("_id", "node").alias("id")))


def tokens(pairs: DataFrame) -> DataFrame:
    """(pos, tree_id, bp, is_ref, is_leaf, node_id): the bit vectors by position. node_id is the sample, the inner node's
    number in order of closing (after the samples), or for a reference the node that it refers to; NULL
    on the opening of an inner node."""
    both = F.explode(F.array(F.struct(F.col("open").alias("pos"), F.lit(True).alias("bp")), F.struct(F.col("close").alias("pos"), F.lit(False).alias("bp")))).alias("p")
    t = pairs.select("tree_id", "leaf", "new", "id", both).select("p.pos", "tree_id", "p.bp", (~F.col("new")).alias("is_ref"), (F.col("leaf") & F.col("new")).alias("is_leaf"), "leaf", "id")
    return t.select("pos", "tree_id", "bp", "is_ref", "is_leaf", F.when(F.col("leaf") | F.col("is_ref") | ~F.col("bp"), F.col("id")).alias("node_id"))


def spans(pairs: DataFrame, subtrees: DataFrame) -> DataFrame:
    """`subtrees` with forest_node: the sample, or the number of the pair that is written for the subtree."""
    ids = pairs.where("new").select("hi", "lo", F.col("id").alias("forest_node"))
    return subtrees.join(ids, ["hi", "lo"])


def with_ranks(tokens: DataFrame) -> DataFrame:
    """Rank support: closings, leaf pairs and references before each position, by running sums in blocks of equal
    length plus the sums of the blocks before, whatever the trees' sizes."""
    tokens = tokens.withColumn("_block", F.floor(F.col("pos") / BLOCK))
    per = tokens.groupBy("_block").agg(*(F.sum(F.col(c).cast("long")).alias(f"_{c}") for c in ("is_leaf", "is_ref")), F.sum((~F.col("bp")).cast("long")).alias("_zero"))
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    base = per.select("_block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_base{c}") for c in ("_is_leaf", "_is_ref", "_zero")))
    run = W.partitionBy("_block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    own = lambda x: F.coalesce(F.sum(x.cast("long")).over(run), F.lit(0))
    t = tokens.join(base, "_block")
    return t.select("pos", "tree_id", "bp", "is_ref", "is_leaf", "node_id", (F.col("_base_zero") + own(~F.col("bp"))).alias("rank0"), (F.col("_base_is_leaf") + own(F.col("is_leaf"))).alias("leaf_rank"), (F.col("_base_is_ref") + own(F.col("is_ref"))).alias("ref_rank"))


def inner_node_ids(ranked: DataFrame, num_leaves: int) -> DataFrame:
    """(pos, node_id): the number of an inner node from the ranks at its closing."""
    return ranked.where(~F.col("bp") & ~F.col("is_ref") & ~F.col("is_leaf")).select("pos", (F.col("rank0") - F.floor(F.col("leaf_rank") / 2) - F.floor(F.col("ref_rank") / 2) + num_leaves).alias("node_id"))


def leaves(tokens: DataFrame) -> DataFrame:
    """(rank, sample): samples in the order in which they are written."""
    return with_dense_id(tokens.where("is_leaf AND bp"), ["pos"], "rank").select("rank", F.col("node_id").alias("sample"))


def references(tokens: DataFrame) -> DataFrame:
    """(rank, node): the nodes that references stand for, in order."""
    return with_dense_id(tokens.where("is_ref AND bp"), ["pos"], "rank").select("rank", F.col("node_id").alias("node"))


def decode(tokens: DataFrame) -> DataFrame:
    """(parent, child): the DAG edges that the parentheses spell."""
    step = F.when(F.col("bp"), 1).otherwise(-1)
    t = cut(running(tokens.withColumn("_s", step.cast("long")), [], "pos", "_s", "_before"))
    # pairs by the depth inside them: the latest that opened at a depth is the one that closes there, and the one around what opens below
    opens = t.where("bp").select((F.col("_before") + 1).alias("d"), F.col("pos").alias("at"), F.col("pos").alias("id"))
    closes = latest(t.where("NOT bp").select(F.col("_before").alias("d"), F.col("pos").alias("at"), "node_id"), opens, ["d"], BLOCK)
    name = cut(closes.select(F.col("id").alias("open"), "node_id"))
    inside = latest(t.where("bp AND _before > 0").select(F.col("_before").alias("d"), F.col("pos").alias("at"), F.col("pos").alias("open")), opens, ["d"], BLOCK)
    child = inside.select("open", F.col("id").alias("_up")).join(name, "open").select("_up", F.col("node_id").alias("child"))
    return child.join(name.select(F.col("open").alias("_up"), F.col("node_id").alias("parent")), "_up").select("parent", "child")


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Deep equality of two encodings."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
