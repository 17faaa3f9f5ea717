"""Lexical search, near vectors and clusters against plain Python, and the cases that their docstrings name."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from grovewise.llm import binarycodes, centroids, search

ODD = ["", None, "..., !", "a", "A b-c_d", "é É ß Ünï\u0085x y", "one two two", "\x00zero\x00one", "x" * 300, "word " * 3000, "two, one; two", "x\x7fy"]


def plain_search(docs, items, k):
    terms = lambda t: re.findall(search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    words = {}
    for i, t in items:
        words.setdefault(i, set()).update(terms(t))
    out = []
    for i, query in words.items():
        scores = []
        for d, b in bags:
            m = 50 + (50 * sum(b.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 20 * m)) for w in query if w in b)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(i, r + 1, x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("size", [3, 50, 1 << 21])
def test_search_is_plain_search(spark, monkeypatch, size):
    """Odd texts twice, NULL and repeated ids, ties, shards of any size, blocks of queries, and clashing columns."""
    monkeypatch.setattr(search, "SHARD_TOKENS", size)
    monkeypatch.setattr(search, "BLOCK_TERMS", 7 if size < 1000 else 200_000)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = ODD + ODD + [" ".join(rng.choice(vocabulary, rng.integers(1, 40), p=np.arange(60, 0, -1) / 1830)) for _ in range(150)] + ["w1 w2"] * 30
    docs = [(None if i == 5 else i // 2 if i < 12 else i, t) for i, t in enumerate(texts)]
    items = [(0, "w1 w2 w3"), (1, "W59 two"), (2, None), (3, "nowhere"), (4, "é x ÜNÏ"), (4, "zero"), (None, "a b"), (5, " ".join(vocabulary))]
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], "doc_id long, text string, terms string, score int").repartition(5)
    got = search.ranked(d, spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, rank int"), 10)
    want = plain_search(docs, items, 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_search_of_empty_tables_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "x")], "item_id string, text string")
    assert [tuple(r)[:3] for r in search.ranked(docs, items, 2).orderBy("rank").collect()] == [("i", 1, "a"), ("i", 2, "b")]
    assert search.ranked(docs.where("false"), items).count() == 0 == search.ranked(docs, items.where("false")).count()


def test_length_beyond_64_bits():
    n, documents, tokens = np.array([10, 9_000_000]), 10**12, 3 * 10**15
    assert search.lengths(n, documents, tokens).tolist() == [50 + 50 * int(x) * documents // tokens for x in n]
    assert [search.count_terms(t) for t in ODD] == [len(search.terms(t)) for t in ODD]


def plain_near(rows, cosine=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            x, y = (np.array(rows[z][1], float) / np.abs(rows[z][1]).max() for z in (a, b))
            if a != b and len(x) == len(y) and x @ y >= cosine * np.linalg.norm(x) * np.linalg.norm(y):
                near[a].add(b)
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        c = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((d, len(near[i]), c, c is None or c == d))
    return out


def near_rows(seed=5):
    rng = np.random.default_rng(seed)
    rows = [v for c in rng.normal(size=(12, 16)) for v in (c, *(c + rng.normal(size=(rng.integers(0, 9), 16)) * 0.05))]
    rows += [rows[0] * 3, rows[0], rows[0], *rng.normal(size=(60, 16))]
    rows = [v.tolist() for v in rows] + [None, [], [0.0] * 16, [-0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1e300] * 16, [1e-300] * 16, [1.0] * 16, [1.0] * 3, [1.0, 1.1, 1.0], [1.0]]
    return [(None if i % 40 == 7 else i - i % 25 % 2, v) for i, v in enumerate(rows)]


@pytest.mark.parametrize("block", [4, 2048])
def test_near_vectors_are_all_pairs(spark, monkeypatch, block):
    """One bucket cut into blocks of few vectors, or whole; odd vectors, lengths, ids and columns."""
    monkeypatch.setattr(binarycodes, "BLOCK", block)
    rows = near_rows()
    got = binarycodes.near_vectors(spark.createDataFrame([(*x, 1, "q") for x in rows], "vec_id long, embedding array<double>, v int, n string"))
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_near(rows), key=key)
    assert binarycodes.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_at_the_least_cosine(spark, monkeypatch):
    """Random vectors, and for each one at a cosine just above the bound: nine tenths at least are found by the tables, and nothing that is not linked."""
    monkeypatch.setattr(binarycodes, "BUCKET", 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = rng.normal(size=x.shape)
    t -= (t * x).sum(1)[:, None] * x
    y = 0.951 * x + math.sqrt(1 - 0.951**2) * t / np.linalg.norm(t, axis=1)[:, None]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]))]
    got = binarycodes.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert got.codes.width >= 8 and got.codes.tables > 4
    out = {r.vec_id: r for r in got.collect()}
    both = np.concatenate([x, y])
    true = (both @ both.T >= 0.95).sum(1) - 1
    found = np.array([out[i].n_links for i in range(6000)])
    assert (found <= true).all() and found.sum() >= 0.95 * true.sum()
    assert np.mean([out[i + 3000].component_id == out[i].component_id for i in range(3000)]) >= 0.95


def plain_clusters(rows, k, rounds, dim):
    kept = [(d, np.floor(256 * np.array(v, float)).astype(int).tolist()) for d, v in rows if v and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{d}".encode()).hexdigest(), v) for d, v in kept if d is not None)[:k]
    c = [v for _, v in first]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((dist(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        a = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), i in zip(kept, a) if i == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine)]
    a = [near(v) for _, v in kept]
    inertia = Counter()
    for d, j in a:
        inertia[j] += d
    return [(d, j, s, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (d, _), (s, j) in zip(kept, a)]


@pytest.mark.parametrize("k,scale", [(1, 1), (7, 1), (40, 0.01), (200, 1), (9, 2000)])
def test_clusters_are_plain_clusters(spark, k, scale):
    """Ties, repeated vectors and ids, odd vectors, more centroids than vectors, and numbers beyond exact doubles."""
    rng = np.random.default_rng(7)
    rows = [(v * scale).tolist() for c in rng.normal(size=(8, 6)) for v in c + rng.normal(size=(20, 6)) * 0.2]
    rows += [rows[0]] * 5 + [None, [], [1.0] * 5, [1.0] * 7, [1.0] * 5 + [None], [float("nan")] * 6, [float("inf")] * 6, [0.0] * 6, [-0.001] * 6]
    rows = [(None if i % 50 == 9 else i - i % 31 % 2, v) for i, v in enumerate(rows)]
    got = centroids.clusters(spark.createDataFrame([(*x, 1, "z") for x in rows], "vec_id long, embedding array<double>, cluster int, q string").repartition(3), k, 5, 6)
    want = plain_clusters(rows, k, 5, 6)
    key = lambda x: tuple(-1 if y is None else y for y in x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert got.scans[0] == len(want) and (k == 1 or scale < 1 or sum(got.scans[1:]) < 5 * len(want))


def test_bounds_spare_scans_and_odd_tables(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([c + rng.normal(size=(100, 8)) * 0.05 for c in rng.normal(size=(10, 8))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    scans = centroids.clusters(df, 10, 5, 8).scans
    assert scans[0] == len(x) and sum(scans[1:]) < 1.5 * len(x) and max(scans[3:]) < 0.1 * len(x)
    assert centroids.clusters(df.where("false"), 10, 5, 8).count() == 0 == centroids.clusters(df, 10, 5, 9).count()
    with pytest.raises(ValueError, match="no vector has an id"):
        centroids.clusters(spark.createDataFrame([(None, [1.0, 2.0])], "vec_id long, embedding array<double>"), 3, 2, 2)
    with pytest.raises(Exception, match="do not fit 64 bits"):
        centroids.clusters(spark.createDataFrame([(1, [1e9, 2.0])], "vec_id long, embedding array<double>"), 3, 2, 2).count()
