"""Ids by order, sites in trees, and subtrees that are roots more than once, against plain Python."""

import bisect
import random

from grovewise.operators import compress, spans, trees
from grovewise.plans.lineage import with_dense_id


def test_dense_ids_of_many_partitions(spark):
    values = random.Random(1).sample(range(10**9), 5000)
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(13)
    got = with_dense_id(df, ["v"], "i").collect()
    assert sorted((r.v, r.i) for r in got) == [(v, i) for i, v in enumerate(sorted(values))]
    assert with_dense_id(df.where("v < 0"), ["v"], "i").count() == 0


def test_sites_take_the_tree_that_holds_them(spark):
    rng = random.Random(2)
    # bins without a tree's begin, bins with many, ends that are sites, and sites outside of all trees
    ends = sorted({5.0, 5.001, 5.002, 700.0, *(float(rng.randrange(5, 100_000)) for _ in range(200))})
    t = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(ends, ends[1:]))], "tree_id long, left double, right double")
    at = [*ends, 0.0, 4.9, 99_999.9, 100_000.0, *(rng.uniform(0, 100_000) for _ in range(800))]
    sites = spark.createDataFrame(list(enumerate(at)), "site_id long, position double")
    want = {(i, bisect.bisect_right(ends, p) - 1) for i, p in enumerate(at) if ends[0] <= p < ends[-1]}
    got = [(r.site_id, r.tree_id) for r in trees.site_to_tree(sites, t, 100_000.0).collect()]
    assert len(got) == len(want) and set(got) == want
    assert trees.site_to_tree(sites, t.where("tree_id < 0"), 100_000.0).count() == 0


def test_repeated_roots_get_a_node_in_each_tree(spark):
    # (tree, parent, child); samples 0 to 2. Trees 0, 2 and 3 are equal; in tree 1 another node joins 1 and 2; in tree 4 the old root stands below a new one.
    same = [(3, 0), (3, 1), (4, 3), (4, 2)]
    rows = [(t, *e) for t in (0, 2, 3) for e in same] + [(1, 5, 1), (1, 5, 2), (1, 4, 5), (1, 4, 0)] + [(4, *e) for e in same] + [(4, 6, 4)]
    e = spark.createDataFrame([(0, t, t + 1, p, c) for t, p, c in rows], "chunk long, first long, last long, parent long, child long")
    samples = spark.createDataFrame([(i,) for i in range(3)], "sample_id long")
    x = compress.node_spans(spans.subtrees(spans.Pieces(e, 64), samples), samples, 64)
    m = compress.node_map(x).where("height > 0").collect()
    got = {(r.tree_id, r.ts_node): (r.forest_node, r.created) for r in m}
    assert len(got) == len(m)
    want = {(0, 3): (3, True), (0, 4): (4, True), (1, 5): (5, True), (1, 4): (6, True), (2, 3): (3, False), (2, 4): (7, True), (3, 3): (3, False), (3, 4): (8, True), (4, 3): (3, False), (4, 4): (8, False), (4, 6): (9, True)}
    assert got == want
