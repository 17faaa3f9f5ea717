"""Subtrees by interval: a row for each stretch of trees over which the subtree below a node stays the same.

Edges hold over ranges of trees, and so do subtrees: a node has a new version only where an edge below it begins or ends. Versions are
made from the leaves upward. A version of a child reaches the parents of its edges over the trees that both share; a parent's own versions
are swept out of what has reached it, by running sums of begins and ends, wherever all of its children are there.

The genome is cut into chunks of so many trees as a tree has edges, about, so that cutting at most doubles the edges, and no task holds
what happens at one node along the whole genome. A row is written once; no table has a row for every node of every tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovewise.plans.lineage import broadcast_if, cut

#: The smallest chunk, in trees, and breakpoints that are broadcast.
CHUNK, BROADCAST_POINTS = 64, 1_000_000
HERE = ["chunk", "node"]


@dataclass(frozen=True)
class Pieces:
    """edges: (chunk, first, last, parent, child), edges as half-open ranges of tree ids, cut at chunk borders; size: trees of a chunk."""

    edges: DataFrame
    size: int


def pieces(edges: DataFrame, breakpoints: DataFrame) -> Pieces:
    """`breakpoints` has index and position."""
    p = broadcast_if(breakpoints, BROADCAST_POINTS)
    first = p.select(F.col("position").alias("left"), F.col("index").alias("first"))
    last = p.select(F.col("position").alias("right"), F.col("index").alias("last"))
    e = cut(edges.join(first, "left").join(last, "right").select("first", "last", "parent", "child"))
    about = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0)).alias("span")).first()
    size = max(CHUNK, -(-about.span // max(1, about.n)))
    chunk = F.explode(F.sequence(F.floor(F.col("first") / size), F.floor((F.col("last") - 1) / size))).alias("chunk")
    e = e.select("first", "last", "parent", "child", chunk)
    return Pieces(e.select("chunk", F.greatest("first", F.col("chunk") * size).alias("first"), F.least("last", (F.col("chunk") + 1) * size).alias("last"), "parent", "child"), size)


def per_tree(rows: DataFrame) -> DataFrame:
    """Rows by tree_id instead of ranges: for selections of trees, and for what has a row for each tree anyway."""
    return rows.withColumn("tree_id", F.explode(F.sequence("first", F.col("last") - 1))).drop("first", "last", "chunk")


def overlay(versions: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk, node, first, last, hi, lo, parent): versions cut where the node's parent changes; NULL where it has none.

    A node has one version and one parent at a time, so the state at each change is the last that began."""
    kind = "struct<last:bigint,hi:bigint,lo:bigint>"
    v = versions.select(*HERE, F.col("first").alias("at"), F.lit(1).alias("order"), F.struct("last", "hi", "lo").cast(kind).alias("v"), F.lit(None).cast("struct<parent:bigint>").alias("e"))
    ends = F.explode(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("order"), F.col("parent")), F.struct(F.col("last").alias("at"), F.lit(0).alias("order"), F.lit(None).cast("long").alias("parent")))).alias("p")
    e = edges.select("chunk", F.col("child").alias("node"), ends).select(*HERE, "p.at", "p.order", F.lit(None).cast(kind).alias("v"), F.struct("p.parent").alias("e"))
    along = W.partitionBy(*HERE).orderBy("at", "order")
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    x = v.unionByName(e).select(*HERE, "at", F.lead("at").over(along).alias("next"), F.last("v", ignorenulls=True).over(so_far).alias("v"), F.last("e", ignorenulls=True).over(so_far).alias("e"))
    x = x.select(*HERE, F.col("at").alias("first"), F.least("next", "v.last").alias("last"), "v.hi", "v.lo", "e.parent")
    return x.where("hi IS NOT NULL AND first < last")


def coverage(p: Pieces) -> DataFrame:
    """(chunk, node, first, last, above, below): stretches over which a node is the parent of `below` edges and the child of `above`."""
    rows = []
    for end, above, below in (("parent", 0, 1), ("child", 1, 0)):
        both = F.explode(F.array(*(F.struct(F.col(c).alias("at"), F.lit(s * above).alias("above"), F.lit(s * below).alias("below")) for c, s in (("first", 1), ("last", -1))))).alias("p")
        rows.append(p.edges.select("chunk", F.col(end).alias("node"), both).select(*HERE, "p.*"))
    at = rows[0].unionByName(rows[1]).groupBy(*HERE, "at").agg(F.sum("above").alias("above"), F.sum("below").alias("below"))
    along = W.partitionBy(*HERE).orderBy("at")
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    x = at.select(*HERE, F.col("at").alias("first"), F.lead("at").over(along).alias("last"), *(F.sum(c).over(so_far).alias(c) for c in ("above", "below")))
    return x.where("above > 0 OR below > 0")


def complete(arrived: DataFrame, needed: DataFrame, height: int) -> DataFrame:
    """(chunk, node, first, last, hi, lo): the stretches over which all of a node's children have arrived, one of them at height - 1.

    `arrived` has chunk, node, first, last, hi, lo, height of the children; `needed` has a row (chunk, node, first, last) for each edge. Neighbours
    of equal hash are one row."""
    zero = F.lit(0).cast("long")
    both = lambda *v: F.explode(F.array(*(F.struct(F.col(c).alias("at"), *((s * x).alias(n) for n, x in v)) for c, s in (("first", 1), ("last", -1))))).alias("p")
    one, new = F.lit(1), (F.col("height") == height - 1).cast("long")
    a = arrived.select(*HERE, "hi", "lo", both(("have", one), ("new", new))).select(*HERE, "p.at", F.col("p.have").cast("long").alias("have"), "p.new", zero.alias("need"), "hi", "lo")
    n = needed.select(*HERE, both(("need", one))).select(*HERE, "p.at", zero.alias("have"), zero.alias("new"), F.col("p.need").cast("long").alias("need"), zero.alias("hi"), zero.alias("lo"))
    at = a.unionByName(n).groupBy(*HERE, "at").agg(*(F.sum(c).alias(c) for c in ("have", "new", "need")), F.bit_xor("hi").alias("hi"), F.bit_xor("lo").alias("lo"))
    along = W.partitionBy(*HERE).orderBy("at")
    so_far = along.rowsBetween(W.unboundedPreceding, 0)
    x = at.select(*HERE, F.col("at").alias("first"), F.lead("at").over(along).alias("last"), *(F.sum(c).over(so_far).alias(c) for c in ("have", "new", "need")), F.bit_xor("hi").over(so_far).alias("hi"), F.bit_xor("lo").over(so_far).alias("lo"))
    x = x.where("have = need AND need > 0 AND new > 0").select(*HERE, "first", "last", F.xxhash64(F.lit(3), "hi", "lo").alias("hi"), F.xxhash64(F.lit(4), "lo", "hi").alias("lo"))
    along = W.partitionBy(*HERE).orderBy("first")
    same = (F.lag("last").over(along) == F.col("first")) & (F.lag("hi").over(along) == F.col("hi")) & (F.lag("lo").over(along) == F.col("lo"))
    x = x.withColumn("_new", (~F.coalesce(same, F.lit(False))).cast("long")).withColumn("_run", F.sum("_new").over(along.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy(*HERE, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("hi").alias("hi"), F.first("lo").alias("lo")).drop("_run")


def leaf_hash(sample: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), sample), F.xxhash64(F.lit(2), sample)


def subtrees(p: Pieces, samples: DataFrame) -> DataFrame:
    """(chunk, node, first, last, parent, height, hi, lo): the versions of every node, samples included, by parent; NULL for a root.

    A round makes the versions whose highest child came in the round before: as many rounds as the highest tree has levels."""
    hi, lo = leaf_hash(F.col("sample_id"))
    s = samples.select(F.col("sample_id").alias("node"), hi.alias("hi"), lo.alias("lo"))
    leaves = p.edges.withColumnRenamed("child", "node").join(s, "node").select(*HERE, "first", "last", "parent", F.lit(0).alias("height"), "hi", "lo")
    tables, height = [(1, cut(leaves))], 0
    need = p.edges.select("chunk", F.col("parent").alias("node"), "first", "last")
    last = tables[0][1]
    while True:
        height += 1
        arrived = tables[0][1]
        for _, t in tables[1:]:
            arrived = arrived.unionByName(t)
        arrived = arrived.where("parent IS NOT NULL").select("chunk", F.col("parent").alias("node"), "first", "last", "height", "hi", "lo")
        met = last.where("parent IS NOT NULL").select("chunk", F.col("parent").alias("node")).distinct()
        found = complete(arrived.join(met, HERE, "left_semi"), need.join(met, HERE, "left_semi"), height)
        up = p.edges.join(met.withColumnRenamed("node", "child"), ["chunk", "child"], "left_semi")
        last = cut(overlay(found, up).select(*HERE, "first", "last", "parent", F.lit(height).alias("height"), "hi", "lo"))
        if last.isEmpty():
            break
        tables.append((1, last))
        while len(tables) > 16 and tables[-1][0] == tables[-2][0]:  # few tables, each row copied at most log(rounds) times
            (n, b), (_, a) = tables.pop(), tables.pop()
            tables.append((2 * n, cut(a.unionByName(b))))
    out = tables[0][1]
    for _, t in tables[1:]:
        out = out.unionByName(t)
    return out


def latest(asked: DataFrame, made: DataFrame, keys: list[str], size: int) -> DataFrame:
    """`asked` (keys, at, ...) with `id` of the last row of `made` (keys, at, id) at or before `at`; NULL where there is none.

    Both meet inside chunks of `size` places; what came before a chunk is the last of the chunks before."""
    chunk = F.floor(F.col("at") / size).alias("_chunk")
    m = made.select(*keys, "at", "id", chunk)
    ends = m.groupBy(*keys, "_chunk").agg(F.max_by("id", "at").alias("_end"))
    q = asked.withColumn("_chunk", F.floor(F.col("at") / size)).withColumn("_asked", F.lit(True))
    so_far = W.partitionBy(*keys, "_chunk").orderBy("at", F.col("_asked").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    x = m.unionByName(q, allowMissingColumns=True).withColumn("_own", F.last("id", ignorenulls=True).over(so_far)).where("_asked").drop("id")
    chunks = x.where("_own IS NULL").select(*keys, "_chunk").distinct()
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = chunks.withColumn("_asked", F.lit(True)).unionByName(ends, allowMissingColumns=True).groupBy(*keys, "_chunk").agg(F.max("_end").alias("_end"), F.max("_asked").alias("_asked"))
    carried = carried.withColumn("_before", F.last("_end", ignorenulls=True).over(before)).where("_asked").select(*keys, "_chunk", "_before")
    return x.join(carried, [*keys, "_chunk"], "left").withColumn("id", F.coalesce("_own", "_before")).drop("_own", "_before", "_chunk", "_asked")


def _levels(size: int) -> int:
    return max(1, (size - 1).bit_length())


def levels_or_places(points: DataFrame, ranges: DataFrame, size: int) -> int | None:
    """The highest power of two that `ranges` need in `stab`; None, if it is fewer rows to list every place of every range."""
    r = ranges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0)).alias("places"), F.coalesce(F.max(F.col("last") - F.col("first")), F.lit(1)).alias("most")).first()
    levels = min(_levels(size), max(1, r.most.bit_length()))
    return None if r.places <= r.n + levels * points.count() else levels


def by_place(ranges: DataFrame, name: str) -> DataFrame:
    """Ranges with a row, and `name`, for each of their places."""
    return ranges.where("first < last").withColumn(name, F.explode(F.sequence(F.col("first"), F.col("last") - 1)))


def stab(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, size: int) -> DataFrame:
    """The inner join of points with the ranges [first, last) of the same keys that hold `at`. Ranges stay inside chunks of `size` places.

    A range is cut into at most two aligned blocks of each power of two, and a point meets its block of each power, as far up as the ranges need: an
    equi-join whose only rows are hits. Where short ranges meet many points, a point meets the range's place instead and is not copied."""
    levels = levels_or_places(points, ranges, size)
    if levels is None:
        return points.withColumn("_place", F.col(at)).join(by_place(ranges, "_place"), [*keys, "_place"]).drop("_place")
    start = F.struct(F.col("first").alias("a"), F.col("last").alias("b"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))
    block = lambda level, b: F.array(F.struct(level.cast("int").alias("level"), b.alias("block")))

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        out = F.when(left, F.concat(acc["out"], block(level, a))).otherwise(acc["out"])
        a2 = F.when(left, a + 1).otherwise(a)
        out2 = F.when(right & (a2 < b), F.concat(out, block(level, b - 1))).otherwise(out)
        b2 = F.when(right & (a2 < b), b - 1).otherwise(b)
        half = lambda x: F.shiftright(x, 1)
        return F.struct(half(a2).alias("a"), F.greatest(half(b2), half(a2)).alias("b"), out2.alias("out"))

    blocks = F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda acc: acc["out"])
    r = ranges.withColumn("_b", F.explode(blocks)).withColumn("_level", F.col("_b.level")).withColumn("_block", F.col("_b.block")).drop("_b")
    q = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels)))).withColumn("_block", F.call_function("shiftright", F.col(at), F.col("_level")))
    return q.join(r, [*keys, "_level", "_block"]).drop("_level", "_block")
