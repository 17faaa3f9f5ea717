"""The commands on a small forest: what they write, time and compare."""

from fixtures import tables
from grovewise import Forest
from grovewise.operators.samples import random_pairs
from grovewise.plans import commands
from grovewise.sources.results import collect_results


def test_commands(spark, tmp_path):
    source, folder, out = (str(tmp_path / x) for x in ("source", "folder", "out"))
    Forest(tables(spark, "multi_tree_back_recurrent")).save(source)
    commands.main(["compress", "--source", source, "--folder", folder, "--results", f"{out}/compress", "--dataset", "x"])
    commands.main(["stats", "--source", source, "--folder", folder, "--results", f"{out}/stats", "--dataset", "x"])
    rows = collect_results(spark, [f"{out}/compress", f"{out}/stats"])
    times = rows.where("variable = 'walltime'").collect()
    assert {(r.section, r.variant) for r in times} == {("load_trees_file", "tables"), *((s, v) for s in ("compress_forest_and_sequence", "save_forest_file") for v in ("dag", "bp"))}
    assert all(r.value > 0 and r.unit == "ns" and r.dataset == "x" for r in times)
    found = {(r.variant, r.variable): r.value for r in rows.where("section = 'stats'").collect()}
    for v in ("all", "dag", "bp"):
        assert (found[v, "num_trees"], found[v, "num_samples"]) == (3, 4)
    assert found["dag", "num_edges"] == found["all", "num_dag_edges"]
    assert commands.mismatches(rows).isEmpty()
    other = commands.Recorder("x")
    other.value("stats", "bp", "num_trees", 2, "1")
    assert [tuple(r) for r in commands.mismatches(rows.unionByName(other.frame(spark))).collect()] == [("x", "num_trees", 2, 3)]

    record = commands.Recorder("x")
    few = {k: commands.SECTIONS[k] for k in ("diversity", "num_segregating_sites", "lca_2th")}
    checks = commands.benchmark(spark, record, source, folder, iterations=1, warmup=1, sections=few)
    assert {(r.section, r.ok) for r in checks.collect()} == {(n, True) for n in few}
    timed = {(r[0], r[1], r[5]) for r in record.rows}
    assert {(s, v, i) for s in (*few, "lca_pairwise") for v in ("tree", "dag") for i in (-1, 0)} <= timed


def test_random_pairs(spark):
    s = spark.range(5).withColumnRenamed("id", "sample_id")
    got = random_pairs(s, 4000, 7).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in random_pairs(s, 4000, 7).collect()]
    n = {}
    for r in got:
        n[r.u, r.v] = n.get((r.u, r.v), 0) + 1
    assert set(n) == {(u, v) for u in range(5) for v in range(5) if u != v}
    assert all(120 < k < 280 for k in n.values())  # 200 each
    assert random_pairs(s.limit(1), 3, 7).isEmpty()
