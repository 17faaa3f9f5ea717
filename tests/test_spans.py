"""Subtrees by interval, contraction, orders and layouts on random tree sequences, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from grovewise import Forest
from grovewise.operators import bp, contract, spans
from simulate import Simulated


def plain_dag(sim):
    """(node map by (tree, node), number of distinct subtrees, edges of the DAG, rows of subtrees that changed)."""
    names, ids, n, edges, where, changed, last = {}, {}, sim.n, [], {}, 0, {}
    for t in range(len(sim.trees)):
        order, kids, root = sim.walk(t)
        name, height = {}, {}
        for u in order:
            name[u] = names.setdefault(frozenset(name[c] for c in kids[u]) if u in kids else -1 - u, len(names))
            height[u] = 1 + max(height[c] for c in kids[u]) if u in kids else 0
            changed += last.get(u) != (name[u], sim.trees[t].get(u))
        last = {u: (name[u], sim.trees[t].get(u)) for u in order}
        for u in sorted(order, key=lambda u: (height[u], u)):
            if height[u] and (name[u] not in ids or u == root):
                ids[name[u]], n = n, n + 1
                edges += [(ids[name[u]], ids[name[c]] if c in kids else c) for c in kids[u]]
            where[t, u] = ids[name[u]] if height[u] else u
    return where, len(names), edges, changed


@pytest.mark.parametrize("samples,trees,chunk,seed", [(8, 150, 4, 1), (5, 60, 64, 2), (3, 200, 16, 3)])
def test_dag_of_versions(spark, monkeypatch, samples, trees, chunk, seed):
    """Small chunks, nodes that come back, roots that are seen again."""
    monkeypatch.setattr(spans, "CHUNK", chunk)
    sim = Simulated(samples, trees, seed)
    f = Forest(sim.tables(spark))
    where, unique, edges, _ = plain_dag(sim)
    assert {(r.tree_id, r.ts_node): r.forest_node for r in f.node_map.collect()} == where
    assert f.unique_subtrees().first().unique_subtrees == unique
    assert sorted((r.parent, r.child) for r in f.dag_edges.collect()) == sorted(edges)
    assert {(r.tree_id, r.node) for r in f.roots.collect()} == {(t, sim.walk(t)[2]) for t in range(trees)}
    order = {t: [(r.node, r.visit) for r in rows] for t, rows in by_tree(f.eulertour()).items()}
    post = {t: [r.node for r in rows] for t, rows in by_tree(f.postorder()).items()}
    for t in range(trees):
        walk, kids, root = sim.walk(t)
        assert post[t] == walk and order[t] == tour(root, kids)


def by_tree(df):
    out = {}
    for r in df.orderBy("tree_id", "position").collect():
        assert len(out.setdefault(r.tree_id, [])) == r.position
        out[r.tree_id].append(r)
    return out


def tour(u, kids):
    return [(u, "leaf")] if u not in kids else [(u, "first"), *(x for c in kids[u] for x in tour(c, kids)), (u, "second")]


def test_rows_follow_changes(spark):
    """2,000 trees of 500 samples: a row for each change, and at most one more for each node at a chunk's border."""
    sim = Simulated(500, 2000, 4, low=9)
    f = Forest(sim.tables(spark))
    where, unique, edges, changed = plain_dag(sim)
    size, rows = f.chunk_size, f.subtrees.count()
    assert changed <= rows <= changed + (len(sim.trees) // size) * 999 + 999
    assert rows < 0.12 * len(where)
    assert f.unique_subtrees().first().unique_subtrees == unique and f.dag_edges.count() == len(edges)


@pytest.mark.parametrize("seed", [5])
def test_layouts_answer_alike(spark, monkeypatch, seed):
    monkeypatch.setattr(spans, "CHUNK", 8)
    sim = Simulated(6, 40, seed)
    t = sim.mutated(spark, 60, seed)
    dag, paren, tree = (Forest(t, x) for x in ("dag", "bp", "tree"))
    a, b = "sample_id < 2", "sample_id >= 2"
    for query in (lambda f: f.samples_below([a, b, "sample_id = 0"]), lambda f: f.allele_counts([a, b]), lambda f: f.site_kind(a), lambda f: f.lca(b), lambda f: f.afs(), lambda f: f.f2(a, b), lambda f: f.tajimas_d()):
        want = sorted(map(tuple, query(tree).collect()))
        for f in (dag, paren):
            x = query(f)
            assert sorted(map(tuple, x.select(*query(tree).columns).collect())) == want
    genotype = {}
    ms, ss = ([r.asDict() for r in x.collect()] for x in (t.mutations, t.sites))
    for s in ss:
        at = int(s["position"])
        for u in range(sim.n):
            state = s["ancestral_state"]
            for v in reversed(sim.above(at, u)):
                for m in ms:
                    if m["site_id"] == s["site_id"] and m["node"] == v:
                        state = m["derived_state"]
            genotype[s["site_id"], u] = state
    counts = {}
    for (s, u), state in genotype.items():
        counts.setdefault((s, state), [0, 0])[u >= 2] += 1
    assert {(r.site_id, r.state): [r.n_0, r.n_1] for r in dag.allele_counts([a, b]).collect()} == counts
    two = {r.site_id: r for r in dag.allele_frequencies(a, b).collect()}
    for s in ss:
        assert [two[s["site_id"]][f"num_ancestral_{i}"] for i in (0, 1)] == counts.get((s["site_id"], s["ancestral_state"]), [0, 0])


def test_parentheses_spell_the_forest(spark):
    sim = Simulated(6, 30, 7)
    f = Forest(sim.tables(spark), "bp")
    tokens = f.bp_tokens.orderBy("pos").collect()
    assert [t.pos for t in tokens] == list(range(len(tokens)))
    seen, ids, out, want_edges = {}, sim.n, [], []

    def write(u, kids, name):
        nonlocal ids
        if name[u] in seen:
            out.extend([(1, 1, 0, seen[name[u]]), (0, 1, 0, seen[name[u]])])
        elif u not in kids:
            seen[name[u]] = u
            out.extend([(1, 0, 1, u), (0, 0, 1, u)])
        else:
            out.append((1, 0, 0, None))
            for c in kids[u]:
                write(c, kids, name)
            seen[name[u]], ids = ids, ids + 1
            want_edges.extend((seen[name[u]], seen[name[c]]) for c in kids[u])
            out.append((0, 0, 0, seen[name[u]]))

    names = {}
    for t in range(len(sim.trees)):
        order, kids, root = sim.walk(t)
        name = {}
        for u in order:
            name[u] = names.setdefault(frozenset(name[c] for c in kids[u]) if u in kids else -1 - u, len(names))
        write(root, kids, name)
    assert [(int(t.bp), int(t.is_ref), int(t.is_leaf), t.node_id) for t in tokens] == out
    assert sorted((r.parent, r.child) for r in bp.decode(f.bp_tokens).collect()) == sorted(want_edges)


def test_contraction_of_chains_is_logarithmic(spark, monkeypatch):
    """A caterpillar of 300 samples, whose height is 299: twice its length takes one more round or two, and what is written follows its length."""

    def run(n):
        edges = [(n + i, n + i - 1 if i else 0) for i in range(n - 1)] + [(n + i, i + 1) for i in range(n - 1)]
        written = []
        with monkeypatch.context() as m:
            m.setattr(contract, "cut", lambda df, real=contract.cut: written.append(real(df)) or written[-1])
            own = spark.range(n).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("x"))
            got = {r.node: (r.x, r.height) for r in contract.fold_up(spark.createDataFrame(edges, "parent long, child long"), own, ["x"], all_leaves=True).collect()}
        assert got == {**{i: (1, 0) for i in range(n)}, **{n + i: (i + 2, i + 1) for i in range(n - 1)}}
        return len(written), sum(df.count() for df in written)

    (rounds, rows), (more, twice) = run(150), run(300)
    assert rounds <= 30 and more - rounds <= 6 and twice <= 2.4 * rows


def test_sums_over_a_dag_count_paths(spark):
    """Repeated edges and shared children; own values at inner nodes; leaves without own values."""
    rng = random.Random(8)
    edges = [(p, rng.randrange(p)) for p in range(6, 40) for _ in range(rng.randrange(1, 4))] + [(9, 3), (9, 3)]
    own = {0: 5, 1: 7, 2: 1, 10: 100}
    total, high = {}, {}
    for u in range(40):
        below = [c for p, c in edges if p == u]
        total[u] = own.get(u, 0) + sum(total[c] for c in below)
        heights = [1 + high[c] for c in below if high[c] is not None] + [0] * (u in own)
        high[u] = max(heights, default=None)
    got = contract.fold_up(spark.createDataFrame(edges, "parent long, child long"), spark.createDataFrame(list(own.items()), "node long, x long"), ["x"])
    touched = {u for e in edges for u in e}
    assert {(r.node, r.x, r.height) for r in got.collect()} == {(u, total[u], high[u]) for u in touched if high[u] is not None}


def test_stab_and_latest(spark):
    rng = random.Random(9)
    ranges = [(k, *sorted(rng.sample(range(64 * c, 64 * c + 65), 2)), i) for i, (k, c) in enumerate((rng.randrange(3), rng.randrange(2)) for _ in range(150))]
    points = [(rng.randrange(3), rng.randrange(128)) for _ in range(200)]
    r = spark.createDataFrame(ranges, "k long, first long, last long, i long")
    p = spark.createDataFrame(points, "k long, at long")
    got = sorted((x.k, x.at, x.i) for x in spans.stab(p, r, ["k"], "at", 64).collect())
    assert got == sorted((k, at, i) for k, at in points for j, a, b, i in ranges if k == j and a <= at < b)
    made = {(rng.randrange(3), rng.randrange(500)): i for i in range(40)}
    asked = [(k, at) for k in range(4) for at in range(0, 600, 7)]
    x = spans.latest(spark.createDataFrame(asked, "k long, at long"), spark.createDataFrame([(k, at, i) for (k, at), i in made.items()], "k long, at long, id long"), ["k"], 16)
    want = {(k, at): made[max((j, b) for j, b in made if j == k and b <= at)] if any(j == k and b <= at for j, b in made) else None for k, at in asked}
    assert {(r.k, r.at): r.id for r in x.collect()} == want


def test_running_sums_and_sums_down(spark, monkeypatch):
    monkeypatch.setattr(contract, "BLOCK", 8)
    rng = random.Random(10)
    rows = [(k, o, rng.randrange(9)) for k in range(2) for o in rng.sample(range(200), 60)]
    got = contract.running(spark.createDataFrame(rows, "k long, o long, v long"), ["k"], "o", "v", "s")
    assert {(r.k, r.o): r.s for r in got.collect()} == {(k, o): sum(v for j, b, v in rows if j == k and b < o) for k, o, _ in rows}
    up = {u: rng.randrange(max(0, u - 3), u) if u else None for u in range(300)}
    got = {r.node: r.w for r in contract.add_down(spark.createDataFrame([(u, p, u) for u, p in up.items()], "node long, parent long, w long"), ["w"]).collect()}
    want = {}
    for u, p in up.items():
        want[u] = u + (want[p] if p is not None else 0)
    assert got == want
