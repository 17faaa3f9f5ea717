"""Sums over everything below a node, by tree contraction, and places from sizes, by pointer jumps.

`fold_up` resolves nodes from the leaves upward. In a round every edge whose child is resolved is added to its parent once and goes away (rake), and a
node that waits for a single child which itself waits for a single child takes that one's place in the chain (compress: chains halve). So
rounds are logarithmic in the number of nodes however high the trees are, and an edge is shuffled only while it is open.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovewise.plans.lineage import cut

#: Numbers of the order that one task takes in `running`.
BLOCK = 1 << 16


def fold_up(edges: DataFrame, own: DataFrame, values: list[str], by: tuple[str, ...] = (), all_leaves: bool = False) -> DataFrame:
    """(by..., node, values..., height): the sum of `own` values at a node and, along all paths, below it; height: the longest path from a node with own values.

    `edges` has `by`, parent, child, without cycles; an edge that occurs twice counts twice, and a node under several parents counts in each. `own` has
    `by` (or holds for all), node and the values. Rows are the nodes with own values at or below them. all_leaves: own has `by`, and every node without
    edges below it; those that no edge has are rows as well. Without it, own nodes without edges are left out, and leaves without own values count nothing."""
    by = list(by)
    at = [*by, "node"]
    given = [c for c in by if c in own.columns]
    e = edges.select(*by, F.col("parent").alias("node"), "child").withColumn("m", F.lit(1).cast("long")).withColumn("d", F.lit(1))
    parents = e.select(*at).distinct()
    if all_leaves:
        start = own.select(*at, *values).withColumn("height", F.lit(0))
    else:
        own_ = own.select(*given, "node", *values).withColumn("height", F.lit(0))
        start = e.select(*by, F.col("child").alias("node")).unionByName(e.select(*at)).distinct().join(own_, [*given, "node"], "left")
        start = start.select(*at, *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in values), "height")
    start = cut(start.join(parents.withColumn("_p", F.lit(1)), at, "left"))
    resolved = start.where("_p IS NULL").select(*at, *values, "height")
    # a node that waits: what is known of its sums, how many children are open, and the open one if it is one
    const = start.where("_p IS NOT NULL AND height IS NOT NULL").select(*at, *values, "height")
    links, parts = e, [resolved.where("height IS NOT NULL")]
    while True:
        r = resolved.select(*by, F.col("node").alias("child"), *(F.col(c).alias(f"_r_{c}") for c in values), F.col("height").alias("_r_height"), F.lit(True).alias("_hit"))
        met = cut(links.join(r, [*by, "child"], "left"))
        zero = F.lit(0).cast("long")
        rows = met.select(
            *at, *(F.when(F.col("_hit"), F.col("m") * F.col(f"_r_{c}")).otherwise(zero).alias(c) for c in values), F.when(F.col("_hit"), F.col("d") + F.col("_r_height")).alias("height"),
            F.col("_hit").isNull().cast("long").alias("k"), F.when(F.col("_hit").isNull(), F.struct("child", "m", "d")).alias("open"),
        )
        rows = rows.unionByName(const.select(*at, *values, "height", zero.alias("k"), F.lit(None).cast(rows.schema["open"].dataType).alias("open")))
        nodes = cut(rows.groupBy(*at).agg(*(F.sum(c).alias(c) for c in values), F.max("height").alias("height"), F.sum("k").alias("k"), F.min("open").alias("open")))
        resolved = nodes.where("k = 0").select(*at, *values, "height")
        parts.append(resolved.where("height IS NOT NULL"))
        waiting = nodes.where("k > 0")
        left = waiting.agg(F.count("*").alias("n"), F.count_if(F.col("k") == 1).alias("single")).first()
        if not left.n:
            break
        open_ = met.where("_hit IS NULL").select(*at, "child", "m", "d")
        if not left.single:
            const, links = waiting.select(*at, *values, "height"), open_
            continue
        # chains: the only open child's only open child takes its place
        single = waiting.where("k = 1").select(*at, *values, "height", "open.*")
        below = single.select(*by, F.col("node").alias("child"), *(F.col(c).alias(f"_{c}") for c in ("m", "d", "height", *values)), F.col("child").alias("_child"))
        hop = F.col("_child").isNotNull()
        jumped = single.join(below, [*by, "child"], "left").select(
            *at, *(F.when(hop, F.col(c) + F.col("m") * F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values), F.greatest("height", F.col("d") + F.col("_height")).alias("height"),
            F.coalesce("_child", "child").alias("child"), F.when(hop, F.col("m") * F.col("_m")).otherwise(F.col("m")).alias("m"), F.when(hop, F.col("d") + F.col("_d")).otherwise(F.col("d")).alias("d"),
        )
        jumped = cut(jumped)
        several = waiting.where("k > 1")
        const = jumped.select(*at, *values, "height").unionByName(several.select(*at, *values, "height"))
        links = jumped.select(*at, "child", "m", "d").unionByName(open_.join(several.select(*at), at, "left_semi"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def running(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over rows of the same keys with a smaller whole number `order`. Orders are cut into blocks, so that no task takes all rows of a key."""
    x = df.withColumn("_block", F.floor(F.col(order) / BLOCK))
    totals = x.groupBy(*keys, "_block").agg(F.sum(value).alias("_t"))
    earlier = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_block", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_earlier"))
    inside = W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return x.join(totals, [*keys, "_block"]).withColumn(name, F.col("_inside") + F.col("_earlier")).drop("_block", "_inside", "_earlier")


def add_down(rows: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., node, columns...): the sums of columns along the way from the root to each node, by pointer jumps.

    `rows` has `by`, node, parent (NULL for a root) and the columns; rounds are logarithmic in the depth."""
    by = list(by)
    now = cut(rows.select(*by, "node", F.col("parent").alias("up"), *columns))
    parts = [now.where("up IS NULL")]
    now = now.where("up IS NOT NULL")
    known = parts[0]
    while not now.isEmpty():
        above = known.unionByName(now).select(*by, F.col("node").alias("up"), F.col("up").alias("_up"), *(F.col(c).alias(f"_{c}") for c in columns))
        moved = cut(now.join(above, [*by, "up"]).select(*by, "node", F.col("_up").alias("up"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in columns)))
        parts.append(moved.where("up IS NULL"))
        known = known.unionByName(parts[-1])
        now = moved.where("up IS NOT NULL")
    return known.drop("up")
