"""What must not grow: work that a query does not need, keys that are NULL, sorts of a whole table, copies of points."""

import random
from pathlib import Path

import pytest

from grovewise.forest import Forest
from grovewise.operators import frequencies, sequence, spans
from grovewise.plans.lineage import cut
from grovewise.sources.adapter import adapter
from fixtures import EXAMPLES, tables


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_trees_need_no_line_items(spark, tmp_path):
    """F2, F4, F10 to F14: mutations are made when first asked for, so what asks for trees only reads no line items."""
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        if f.stem not in ("lineitem", "orders"):
            (tmp_path / f.name).symlink_to(f)
    f = Forest(adapter(spark, str(tmp_path)))
    assert f.trees.count() == 4 and f.samples_below(["true"]).count() > 0
    assert f.invalidated_nodes().count() > 0 and f.lca("sample_id % 10 = 0").count() == 4


def test_mutations_without_parent_do_not_meet(spark):
    """rows without a parent are no rows of one NULL key."""
    t = tables(spark, "multi_tree_back_recurrent")
    f = Forest(t)
    got = sequence.seq_mutations(cut(t.sites), cut(t.mutations), cut(f.site_tree))
    assert "LeftOuter" not in _plan(got)
    state = {m.mutation_id: m.derived_state for m in t.mutations.collect()}
    anc = {s.site_id: s.ancestral_state for s in t.sites.collect()}
    want = {(m.mutation_id, state.get(m.parent, anc[m.site_id])) for m in t.mutations.collect()}
    assert {(m.mutation_id, m.parent_state) for m in got.collect()} == want


def test_kinds_of_sites_sort_no_mutations(spark):
    """a site's kind comes from numbers of its states."""
    f = Forest(tables(spark, "multi_derived_states"))
    kind = frequencies.site_kind(f.tables.sites, f.forest_mutations, f.counts(["true"]), by=("forest_node",))
    assert "SortAggregate" not in _plan(kind)
    assert {r.site_id: r.is_multiallelic for r in kind.collect()}[0]


def test_points_are_not_copied_for_short_ranges(spark):
    """F1, F6 to F9: either way of meeting ranges gives the same rows."""
    rng = random.Random(3)
    ranges = [(k, a, a + rng.randrange(1, 5), k * 100 + a) for k in range(3) for a in range(0, 60, 4)]
    r = spark.createDataFrame(ranges, "k long, first long, last long, i long")
    many = [(rng.randrange(4), rng.randrange(64)) for _ in range(300)]
    for points, listed in ((many, True), (many[:3], False)):
        p = spark.createDataFrame(points, "k long, at long")
        assert (spans.levels_or_places(p, r, 64) is None) == listed
        got = spans.stab(p, r, ["k"], "at", 64)
        assert sorted((x.k, x.at, x.i) for x in got.collect()) == sorted((k, at, i) for k, at in points for j, a, b, i in ranges if k == j and a <= at < b)
        assert ("_level" in _plan(got)) == (not listed)


@pytest.mark.parametrize("name", ["sf0.001", *EXAMPLES])
def test_statistics_number_nothing(spark, name):
    """statistics of a dataset need no numbered mutations, edges or parentheses, and are those that the encodings have."""
    f = Forest(adapter(spark, f"/root/testdata/{name}") if name.startswith("sf") else tables(spark, name))
    got = {r.metric: r.value for r in f.stats().collect()}
    assert not {"bp_pairs", "bp_tokens", "dag_edges", "seq_mutations"} & set(f.__dict__)
    assert not name.startswith("sf") or "mutations" not in f.tables.__dict__
    mapped = sequence.to_forest_nodes(f.seq_mutations, f.node_spans, f.chunk_size).select("forest_node").distinct()
    want = {"num_mutations": f.tables.mutations, "num_dag_edges": f.dag_edges, "num_dag_nodes": f.graph_nodes(), "num_bp_references": f.bp_tokens.where("is_ref AND bp"), "num_subtrees_with_mutations": mapped}
    assert {k: got[k] for k in want} == {k: df.count() for k, df in want.items()}
    if name.startswith("sf"):
        assert f.tables.mutated.exceptAll(f.tables.mutations.select("site_id", "node")).isEmpty()
