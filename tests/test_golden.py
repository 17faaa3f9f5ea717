import math

import pytest
from pyspark.sql import functions as F

from fixtures import EXAMPLES, tables
from grovewise import Forest
from grovewise.operators import bp, graph, samples, sequence, stats, trees
from grovewise.operators.folds import Fold, fold

A, B = "sample_id < 2", "sample_id >= 2"
#: all, A, B diversity; divergence; segregating sites; f2, f3, f4; F_ST; Tajima's D; AFS
GOLDEN = {
    "paper_ex": (1.5, 2, 1, 1.5, 3, 0, 0, 0, 0, -0.7544510777, [0, 2, 0, 1, 0]),
    "single_tree_ex": (1, 1, 1, 1, 2, 0, 0, 0, 0, -0.7098961679, [0, 2, 0, 0, 1]),
    "multi_tree_back_recurrent": (11 / 6, 2, 1, 2, 3, 0.5, 0.5, -1, 1 / 7, 1.0897626677, [0, 1, 2, 0, 0]),
    "multi_derived_states": (2, 2, 1, 9 / 4, 4, 0.75, 1, 0, 0.2, -0.7801229938, [0, 3, 1, 0, 0]),
    "single_tree_multi_derived_states": (5 / 6, 1, 0, 1, 2, 0, 0, 0, 1 / 3, -2.0113724757, [0, 1, 1, 0, 0]),
}


@pytest.fixture(scope="module")
def forests(spark):
    return {n: Forest(tables(spark, n)) for n in EXAMPLES}


def only(*ids):
    return [f"sample_id = {i}" for i in ids]


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("name", EXAMPLES)
def test_statistics(forests, name):
    f, g = forests[name], GOLDEN[name]
    c = f.allele_counts(["true", A, B, *only(0, 1, 2, 3)]).cache()
    got = [stats.diversity(c, 4), stats.diversity(c, 2, "n_1"), stats.diversity(c, 2, "n_2"), stats.divergence(c, 2, 2, "n_1", "n_2"), stats.segregating_sites(c), stats.f2(c, (2, 2), ("n_1", "n_2")), stats.f3(c, (2, 1, 1), ("n_1", "n_5", "n_6")), stats.f4(c, (1, 1, 1, 1), ("n_3", "n_4", "n_5", "n_6")), stats.fst(c, 2, 2, "n_1", "n_2"), stats.tajimas_d(c, 4)]
    assert [one(x) for x in got] == pytest.approx(list(g[:-1]), abs=1e-9)
    assert [r.num_sites for r in stats.afs(c, 4).orderBy("num_derived").collect()] == g[-1]
    assert f.violations().where("violations > 0").count() == 0


def test_facade(forests):
    f, g = forests["multi_derived_states"], GOLDEN["multi_derived_states"]
    got = [f.diversity(), f.divergence(A, B), f.segregating_sites(), f.f2(A, B), f.f3(A, *only(2, 3)), f.f4(*only(0, 1, 2, 3)), f.fst(A, B), f.tajimas_d()]
    assert [one(x) for x in got] == pytest.approx([g[i] for i in (0, 3, 4, 5, 6, 7, 8, 9)], abs=1e-9)


@pytest.mark.parametrize("name", ["multi_derived_states"])
def test_layouts_agree(spark, forests, name):
    rules = [A, B]
    dag = Forest(tables(spark, name), layout="dag")
    assert bp.equal(forests[name].samples_below(rules).drop("height"), dag.samples_below(rules).drop("height"))
    assert one(dag.divergence(A, B)) == pytest.approx(GOLDEN[name][3])


def test_kinds(forests):
    f = forests["multi_derived_states"]
    rows = {r.site_id: r for r in f.allele_frequencies().collect()}
    assert [rows[i].kind for i in range(3)] == ["multiallelic", "biallelic", "biallelic"]
    assert rows[0].counts == {"0": 2, "1": 1, "2": 1} and rows[1].num_ancestral == 3 and rows[2].num_ancestral == 2
    single = lambda k: [(r.kind[0], r.num_ancestral) for r in f.allele_frequencies(*only(k)).orderBy("site_id").collect()]
    assert single(0) == [("b", 0), ("b", 1), ("b", 1)] and single(1) == [("b", 1), ("b", 0), ("b", 1)] and single(2) == [("b", 1), ("b", 1), ("b", 0)]
    assert single(3) == [("m", 0), ("b", 1), ("b", 0)]


def test_trees(forests):
    f = forests["paper_ex"]
    assert [tuple(r) for r in f.trees.orderBy("tree_id").collect()] == [(0, 0, 2), (1, 2, 7), (2, 7, 10)]
    assert [r.tree_id for r in f.site_tree.orderBy("site_id").collect()] == [0, 1, 2]
    bad = {(r.tree_id, r.node) for r in f.invalidated_nodes().collect()}
    assert bad == {(1, n) for n in (4, 5, 6, 8)} | {(2, 6), (2, 7)}
    lca = lambda u, v: [r.node for r in f.lca_pair(u, v).orderBy("tree_id").collect()]
    assert (lca(2, 3), lca(1, 3), lca(0, 1)) == ([8, 4, 4], [5, 5, 5], [6, 6, 7])
    assert [r.node for r in f.lca(*only(1)).collect()] == [None] * 3
    tour = [(r.node, r.visit[0]) for r in f.eulertour().where("tree_id = 0").orderBy("position").collect()]
    assert tour == [(8, "f"), (2, "l"), (6, "f"), (0, "l"), (5, "f"), (1, "l"), (3, "l"), (5, "s"), (6, "s"), (8, "s")]
    assert [r.node for r in f.postorder().where("tree_id = 0").orderBy("position").collect()] == [2, 0, 1, 3, 5, 6, 8]
    assert {(r.tree_id, r.node) for r in f.roots.collect()} == {(0, 8), (1, 6), (2, 7)}
    assert [r.child for r in trees.children(f.tree_edges, 4).where("tree_id = 1").orderBy("position").collect()] == [2, 3]


def test_dag(forests):
    f = forests["paper_ex"]
    assert tuple(f.unique_subtrees().first()) == (10, 11)
    assert f.graph_nodes().count() == 11 and graph.duplicate_edges(f.dag_edges).count() == 0
    leaves = f.samples.select(F.col("sample_id").alias("node"))
    assert graph.postorder_violations(f.dag_edges, f.graph_nodes(), leaves).count() == 0
    assert one(graph.edges_are_sorted(f.dag_edges, "parent")) is True
    reverse = f.dag_edges.withColumn("rank", -F.col("rank"))
    assert graph.postorder_violations(reverse, f.graph_nodes(), leaves).count() > 0 and one(graph.edges_are_sorted(reverse, "parent")) is False


def test_parentheses(forests):
    t = forests["paper_ex"].bp_tokens.orderBy("pos").collect()
    bits = lambda c: [int(r[c]) for r in t]
    one_tree = [1, 1, 0, 1, 1, 0, 1, 1, 0, 1, 0, 0, 0, 0]
    assert bits("bp") == one_tree * 2 + [1, 0]
    assert bits("is_ref") == [0] * 14 + [0, 1, 1, 0, 1, 1, 0, 1, 1, 1, 1, 0, 0, 0] + [1, 1]
    assert bits("is_leaf") == [0, 1, 1, 0, 1, 1, 0, 1, 1, 1, 1, 0, 0, 0] + [0] * 16
    f = forests["paper_ex"]
    assert [r["sample"] for r in bp.leaves(f.bp_tokens).orderBy("rank").collect()] == [2, 0, 1, 3]
    assert bp.references(f.bp_tokens).count() == 5
    ids = {r.pos: r.node_id for r in bp.inner_node_ids(bp.with_ranks(f.bp_tokens), 4).collect()}
    assert ids == {r.pos: r.node_id for r in t if not r.bp and not r.is_ref and not r.is_leaf}
    assert sorted(r.n_0 for r in f.samples_below_bp(["true"]).collect()) == [1, 1, 1, 1, 2, 2, 3, 3, 4, 4]


def test_unary_chain_heights(spark):
    """A chain of 11 nodes above two samples: rounds are bounded by the height only."""
    n = 12
    edges = "0 1 2 0,1\n" + "\n".join(f"0 1 {i + 1} {i}" for i in range(2, n))
    from grovewise.sources.text import tables_from_text

    f = Forest(tables_from_text(spark, 1, "1 0\n1 0\n" + "0 0\n" * (n - 1), edges, "0.5 0", "0 2 1"))
    top = {r.node: (r.n_0, r.height) for r in f.samples_below(["true"]).collect()}
    assert top[n] == (2, n - 1) and top[2] == (2, 1)
    assert one(f.diversity()) == 0


def test_sample_sets(spark):
    s = spark.range(6).select(F.col("id").alias("sample_id"))
    two = samples.sample_sets(s, samples.round_robin(2))
    assert {(r.set_id, r.num_samples) for r in samples.popcount(two).collect()} == {("0", 3), ("1", 3)}
    inv = {(r.set_id, r.sample_id) for r in samples.inverse(two, s).collect()}
    assert inv == {("0", i) for i in (1, 3, 5)} | {("1", i) for i in (0, 2, 4)}
    assert samples.union(two, two).count() == 6 and samples.remove(two, two).count() == 0
    assert samples.sample_sets(s, samples.every_nth(4)).count() == 2


def test_empty_set_is_an_error(forests):
    with pytest.raises(ValueError):
        forests["paper_ex"].diversity("sample_id > 99")
    with pytest.raises(ValueError):
        forests["paper_ex"].f2("sample_id = 0", B)


def test_archives(spark, forests, tmp_path):
    f = forests["multi_derived_states"]
    f.save(str(tmp_path / "a"))
    g = Forest.load(spark, str(tmp_path / "a"))
    assert one(g.diversity()) == 2 and g.tables.sequence_length == 10
    f.save_dag(str(tmp_path / "d")), f.save_bp(str(tmp_path / "b")), f.save_sequence(str(tmp_path / "s"))
    from grovewise.sources import archive

    t, _ = archive.load(spark, str(tmp_path / "b"), "bp")
    assert bp.equal(t["bp_tokens"], f.bp_tokens)
    with pytest.raises(ValueError):
        archive.load(spark, str(tmp_path / "b"), "dag")


def test_sequence(forests):
    f = forests["multi_derived_states"]
    assert [(r.parent_state, r.derived_state) for r in f.seq_mutations.orderBy("mutation_id").collect()] == [("0", "1"), ("1", "0"), ("0", "2"), ("0", "3"), ("3", "0"), ("0", "1")]
    assert one(sequence.is_sorted(f.seq_mutations, "mutation_id", "site_id")) is True
    assert {(r.site_id, r.first_mutation, r.num_mutations) for r in sequence.mutation_ranges(f.tables.mutations).collect()} == {(0, 0, 3), (1, 3, 2), (2, 5, 1)}
    assert sequence.set_ancestral_state(f.tables.sites, 1, "9").where("ancestral_state = '9'").count() == 1
    assert sequence.mutations_at_site(f.seq_mutations, 0).count() == 3


def test_stats_are_finite(forests):
    d = {r.metric: r.value for r in forests["paper_ex"].stats().collect()}
    assert d["num_dag_nodes"] == 11 and d["num_unique_subtrees"] == 10 and d["num_trees"] == 3 and d["num_bp_references"] == 5
    assert all(math.isfinite(v) for v in d.values())


def test_adjacency_of_all_trees(spark):
    from grovewise.plans.queries import QUERIES

    d = "/root/testdata/sf0.001"
    want = {}
    for r in QUERIES["tree_edges"](spark, d).collect():
        want.setdefault((r.tree_id, r.parent), []).append(r.child)
    got = QUERIES["adjacency"](spark, d).collect()
    assert {(r.tree_id, r.node): r.neighbours for r in got} == {k: ",".join(map(str, sorted(x))) for k, x in want.items()}
    assert len(got) == len(want) and len({r.tree_id for r in got}) == 4


def test_tajimas_constants():
    """Of the published example with ten sequences."""
    k = stats.tajimas_constants(10)
    assert [k[x] for x in ("a1", "a2", "b1", "b2", "c1", "c2")] == pytest.approx([2.828968, 1.539768, 0.407407, 0.279012, 0.053922, 0.047227], abs=1e-5)
    assert (k["e1"], k["e2"]) == pytest.approx((0.019061, 0.004949), abs=1e-5)


def test_text_of_unsorted_sites_and_odd_times(spark):
    from grovewise.sources.text import tables_from_text

    t = tables_from_text(spark, 10, "1 0\n1 0\n0 1", "0 10 2 0,1", "8 G\n2 A", "0 0 T -1 1234567.5\n1 1 C -1 0.12345\n1 0 G -1 1e2")
    at = {r.site_id: (r.position, r.ancestral_state) for r in t.sites.collect()}
    assert {(at[r.site_id], r.node, r.derived_state, r.time) for r in t.mutations.collect()} == {((8.0, "G"), 0, "T", 1234567.5), ((2.0, "A"), 1, "C", 0.12345), ((2.0, "A"), 0, "G", 100.0)}


def test_compressed_forest_is_loaded(spark, forests, tmp_path):
    f = forests["multi_derived_states"]
    f.save(str(tmp_path / "t")), f.save_dag(str(tmp_path / "d")), f.save_bp(str(tmp_path / "b")), f.save_sequence(str(tmp_path / "s"))
    g = Forest.load_compressed(spark, str(tmp_path / "t"), str(tmp_path / "d"), str(tmp_path / "s"))
    assert one(g.diversity()) == pytest.approx(2) and "hashes" not in g.__dict__
    assert bp.equal(Forest.load_bp(spark, str(tmp_path / "b"))["bp_tokens"], f.bp_tokens)
    h = Forest.load_compressed(spark, str(tmp_path / "t"), str(tmp_path / "b"), str(tmp_path / "s"), "bp")
    assert one(h.diversity()) == pytest.approx(2) and "subtrees" not in h.__dict__


def test_user_fold_and_appenders(forests, spark):
    f = forests["multi_derived_states"]
    most = f.fold_sites("true", lambda c: F.array_max(F.transform(c, lambda x: x["n"])), "most")
    assert {r.site_id: r.most for r in most.collect()} == {0: 2, 1: 3, 2: 2}
    more = spark.createDataFrame([(9.5, "A"), (3.0, "C")], "position double, ancestral_state string")
    assert [(r.site_id, r.ancestral_state) for r in sequence.append_sites(f.tables.sites, more).orderBy("site_id").collect()][3:] == [(3, "C"), (4, "A")]
    rows = spark.createDataFrame([(2, 2, 1, "1", "0")], "site_id long, tree_id long, node long, parent_state string, derived_state string")
    assert [r.mutation_id for r in sequence.append_mutations(f.seq_mutations, rows).orderBy("mutation_id").collect()] == list(range(7))


@pytest.mark.parametrize("name", EXAMPLES)
def test_tajimas_d_as_a_fold(forests, name):
    assert one(forests[name].fold(["true"], stats.tajimas_fold(4))) == pytest.approx(GOLDEN[name][-2], abs=1e-9)


def test_fold_of_any_partitions(spark):
    """Sum, count and largest of rows over 1 and 150 partitions, of rows with NULLs, and of none."""
    import pyarrow.compute as pc

    def update(s, b):
        x = b.column("x")
        big = pc.max(x).as_py()
        return s[0] + (pc.sum(x).as_py() or 0), s[1] + len(x) - x.null_count, max((v for v in (s[2], big) if v is not None), default=None)

    def merge(a, b):
        return a[0] + b[0], a[1] + b[1], max((v for v in (a[2], b[2]) if v is not None), default=None)

    by = Fold("s long, n long, m long", lambda: (0, 0, None), update, merge, {"mean": "s / n", "most": "m"})
    rows = spark.range(1000).select(F.when(F.col("id") % 7 != 0, F.col("id")).alias("x"))
    x = [i for i in range(1000) if i % 7]
    for parts in (1, 150):
        got = fold(rows.repartition(parts), by).collect()
        assert [(r.mean, r.most) for r in got] == [(pytest.approx(sum(x) / len(x)), 999 if 999 % 7 else 998)]
    for none in (rows.where("x < 0"), spark.createDataFrame([], "x long")):
        assert [tuple(r) for r in fold(none, by.__class__(*by[:4], {"n": "n", "m": "m"})).collect()] == [(0, None)]


def test_graph_edges(spark):
    e = spark.createDataFrame([(0, 5, 1), (1, 5, 2)], "rank long, parent long, child long")
    more = graph.insert_edges(e, spark.createDataFrame([(0, 6, 5)], e.schema))
    assert [tuple(r) for r in graph.sort_edges(more, "rank").collect()] == [(0, 5, 1), (1, 5, 2), (2, 6, 5)]
    assert one(graph.has_edge(more, 6, 5)) is True and one(graph.has_edge(more, 1, 5)) is False
    leaves = spark.createDataFrame([(1,), (2,)], "node long")
    assert graph.is_leaf(more, leaves).count() == 2 and graph.duplicate_nodes(leaves.union(leaves)).count() == 2


def test_scalar_functions(spark):
    from grovewise.functions import scalar

    d = spark.createDataFrame([(1, 300, "7")], "a long, b long, s string")
    r = d.select(scalar.hash64(F.col("a")).alias("h"), scalar.hash128(F.col("a")).alias("hh"), scalar.edge_hash(F.col("a"), F.col("b")).alias("e"), scalar.in_range(F.col("b"), "tinyint").alias("i"), scalar.checked_cast(F.col("a"), "tinyint").alias("c"), scalar.numeric_index(F.col("s")).alias("n"), scalar.ns_to_ms(F.col("b")).alias("ms"), scalar.with_sd(F.col("a"), F.col("b")).alias("t")).first()
    assert r.hh.hi == r.h != r.hh.lo and r.i is False and (r.c, r.n, r.ms, r.t) == (1, 7, 3e-4, "1.00 ± 300.00")
    with pytest.raises(Exception, match="out of range"):
        d.select(scalar.checked_cast(F.col("b"), "tinyint")).collect()


def test_results_and_catalogue(spark, tmp_path):
    from grovewise.operators import report
    from grovewise.sources import results

    rows = [("a", "v", "d", "r", "m", i, "walltime", float(i), "ns") for i in (-1, 0, 1)]
    results.write_results(spark.createDataFrame(rows, results.RESULTS), str(tmp_path / "r"))
    assert results.collect_results(spark, [str(tmp_path / "r"), str(tmp_path / "none")]).count() == 2 and results.collect_results(spark, [str(tmp_path / "none")]).count() == 0
    (tmp_path / "c.csv").write_text("collection,filename\nx,x_chr3.trees\ny,y_chr4.trees\n")
    c = results.from_filename(results.catalogue(spark, str(tmp_path / "c.csv"), ["x"]))
    assert [(r.collection, r.chromosome) for r in c.collect()] == [("x", 3)]
    assert spark.range(1).select(report.close(F.lit(1.0), F.lit(1.00005)).alias("x")).first().x and not spark.range(1).select(report.close(F.lit(1.0), F.lit(1.1)).alias("x")).first().x


def test_failing_tables_are_found(spark):
    from grovewise import Forest as Trees
    from grovewise.operators import frequencies
    from grovewise.sources.text import tables_from_text

    f = Trees(tables_from_text(spark, 10, "0 1\n1 0\n1 0", "0 10 0 1\n0 10 2 1", "1 AA", "0 1 T"))
    bad = {r.check for r in f.violations().where("violations > 0").collect()}
    assert {"sample ids are 0..n-1", "one root per tree", "one parent per node and tree", "alleles are one character"} <= bad
    counts = spark.createDataFrame([(0, "A", True, 1)], "site_id long, state string, is_ancestral boolean, n_0 long")
    lanes = spark.createDataFrame([(0, 1), (1, 1)], "sample_id long, n_0 long")
    assert [r.site_id for r in frequencies.invalid_sites(counts, lanes).collect()] == [0]
