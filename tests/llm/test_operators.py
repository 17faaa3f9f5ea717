"""Operators against brute force, libraries, and the cases that their docstrings name."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovewise.llm import chat, decontaminate, langid, lines, lm, neardup, pieces, quality, sharding, tokencount
from grovewise.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, shard_ string"
ODD = ["", None, " \n\t ", "a", "a b", "one line\n\n  two\n", "x" * 300, "é à ü ▁ ﬁ   \x1c b", "word " * 3000, "tail  \n", "\nstart", "<|endoftext|> a<|endoftext|>"]


def odd(spark, n=None):
    """Odd texts, twice each, with NULLs and extra columns of clashing names."""
    texts = (ODD + ODD)[:n]
    return spark.createDataFrame([(i if i % 5 else None, t, None if i % 3 else "en", None if i % 2 else "s", 1, "z", "q") for i, t in enumerate(texts)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def bwords(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


def test_quality_counts():
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        three = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)]

    for t in [*ODD, "a b c a b c d", "l\nl\nl ", "#a# b|c\n#a# b|c\n#a# b|c", "a a a a"]:
        assert quality.statistics(t)[0] == brute(t), t


def test_quality_rejects_planted_outliers(spark):
    rng = np.random.default_rng(1)
    v = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(300)]
    good = [(i, " ".join(rng.choice(v, 200)), "en", f"s{i % 2}") for i in range(400)]
    bad = [(1000 + i, " | ".join(rng.choice(v, 150)), "en", f"s{i % 2}") for i in range(40)]
    out = {r.doc_id: r for r in quality.judged(spark.createDataFrame(good + bad + [(2000, "short", "en", "s0"), (2001, None, None, None)], "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i].kept for i, *_ in good) and not any(out[i].kept for i, *_ in bad)
    assert out[2000].base_failed and out[2001].base_failed and not out[2001].kept and out[2001].n_words == 0


def vectors(spark, groups):
    rows = [(100, lang, source, *map(float, v)) for (lang, source), x in groups.items() for v in x]
    return spark.createDataFrame(rows, "n_words long, lang string, source string, " + ", ".join(f"{c} double" for c in quality.NAMES))


def test_mcd_is_the_least_determinant(spark):
    """All halves of small groups, and of large ones with a third of outliers, the good rows."""
    rng = np.random.default_rng(2)
    scale = np.sqrt(np.diag(quality.FLOOR)) * 3
    groups = {("en", f"s{k}"): np.vstack([rng.normal(0, 1, (9, quality.P)), rng.normal(9, 0.1, (3, quality.P))]) * scale for k in range(4)}
    groups["de", None] = np.vstack([rng.normal(0, 1, (6000, quality.P)), rng.normal(9, 0.1, (2500, quality.P))]) * scale
    got = {r.g: r for r in quality.robust(vectors(spark, groups)).collect()}
    for k in range(4):
        x, r = groups["en", f"s{k}"], got[f"2/2:en/2:s{k}"]
        best = min((np.linalg.slogdet(np.cov(x[list(t)].T, bias=True) + quality.FLOOR)[1], t) for t in itertools.combinations(range(12), 9))
        assert np.linalg.slogdet(quality.square(r.c))[1] == pytest.approx(best[0], abs=1e-9) and np.allclose(r.m, x[list(best[1])].mean(0))
    assert np.abs(np.array(got["2/2:de/-"].m) / scale).max() < 0.2 and set(got) == {"0", "1/2:en", "1/2:de", "2/2:de/-", *(f"2/2:en/2:s{k}" for k in range(4))}
    e = {r.g: r for r in quality.estimates(vectors(spark, groups)).collect()}["2/2:de/-"]
    spread = np.sqrt(np.diag(np.linalg.inv(quality.square(e.i)))) / scale
    assert np.abs(np.array(e.m) / scale).max() < 0.2 and 0.7 < spread.min() and spread.max() < 1.5


def test_distances_are_those_of_the_estimates(spark, monkeypatch):
    """Distances and verdicts by numpy, with broadcast groups and without."""
    d = docs(spark)
    x = {r.doc_id: r for r in quality.judged(d).collect()}
    e = {r.g: r for r in quality.estimates(quality.measured(d)).collect()}
    part = lambda v: "-" if v is None else f"{len(v)}:{v}"
    limit = quality.chi_square(1 - quality.ALPHA, quality.P)
    for r in x.values():
        if r.n_words == 0:
            assert r.distance is None and not r.kept
            continue
        g = e[f"2/{part(r.lang)}/{part(r.source)}"]
        v = np.array([r[c] for c in quality.NAMES]) - g.m
        assert r.distance == pytest.approx(v @ quality.square(g.i) @ v, rel=1e-6)
        assert r.kept == (not r.base_failed and r.distance <= limit)
    monkeypatch.setattr(quality, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(quality, "HOT", 5)
    again = {r.doc_id: r.distance for r in quality.judged(d).collect()}
    assert all(again[i] == pytest.approx(r.distance, rel=1e-6) for i, r in x.items())


def test_language_model(spark):
    d = docs(spark)
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    out = lm.scored(d, fold != 2).collect()
    rows = {r.doc_id: r.text for r in d.collect()}
    train = [i for i in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in bwords(rows[i]))
    n, v, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    for r in out:
        w = bwords(rows[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w) + 1, sum(x in c for x in w) + 1, n, r.doc_id not in set(train))
        assert r.base_score == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w) + np.log10((ends + 1) / (n + v + 1)))
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_are_the_models_by_plain_loops(spark):
    """The probability of every token from the parameters, by sums over all outputs; words outside the vocabulary by their counts."""
    d = docs(spark).where("doc_id < 150")
    train = F.col("doc_id") % 5 != 1
    out = {r.doc_id: r.score for r in lm.scored(d, train).collect()}
    learn = d.where(train)
    v = lm.vocabulary(lm.word_counts(learn), learn.count())
    p, c, all_counts = lm.train(learn, v), v.classes, Counter(w for r in learn.collect() for w in bwords(r.text))
    k, n = len(c.sizes) + 2, c.n_words
    assert n < v.types - 1 and v.other_tokens > 0
    for r in d.where("doc_id % 10 = 1").collect():
        w, total, two, one = bwords(r.text), 0.0, n + 2, n + 2
        for x in [*w, None]:
            i = n if x is None else v.index.get(x, n + 1)
            i = n + 1 if x is not None and i >= n else i
            q = p.context[one] * p.scale[0] + p.context[two] * p.scale[1]
            top = np.exp(p.word[:k] @ q + p.bias[:k])
            total += np.log10(top[c.tops[i]] / top.sum())
            if i < n:
                a, b = c.bounds[c.tops[i]], c.bounds[c.tops[i] + 1]
                e = np.exp(p.word[k + a : k + b] @ q + p.bias[k + a : k + b])
                total += np.log10(e[i - a] / e.sum())
            elif i > n:
                total += np.log10((all_counts[x] + 1) / (v.other_tokens + v.other_types + 1))
            two, one = one, i
        assert out[r.doc_id] == pytest.approx(total, rel=1e-3, abs=1e-3)


def test_language_model_does_not_depend_on_partitions(spark):
    """The same corpus in 1, 4 and 32 partitions: what is gained over counts does not fade; texts come in other orders."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 3 = 0")
    gain = []
    for k in (1, 4, 32):
        r = lm.scored(d.repartition(k), F.col("doc_id") % 7 != 2).where("held_out").agg(F.sum("score") - F.sum("base_score")).first()
        gain.append(r[0])
    assert min(gain) > 0.8 * max(gain) > 0, gain


def test_word_classes_are_normalised_exactly():
    rng = np.random.default_rng(6)
    c = lm.Classes.of_counts(np.sort(rng.zipf(1.5, 3000).clip(max=10**6))[::-1], 40, 70)
    assert c.bounds[0] == 0 and c.bounds[-1] == 3000 and c.sizes.min() >= 1 and c.sizes.max() > 20
    p = c.start()
    p.word[:] = rng.normal(0, 1, p.word.shape)
    n, s = c.n_words + 2, lm.ClassScorer(p, c)
    for one, two in rng.integers(0, n + 1, (5, 2)):
        q = p.context[one] * p.scale[0] + p.context[two] * p.scale[1]
        e = np.exp(p.word @ q + p.bias)
        top, inner = e[: len(c.sizes) + 2], e[len(c.sizes) + 2 :]
        want = top[c.tops] / top.sum()
        want[:-2] *= inner / np.add.reduceat(inner, c.bounds[:-1])[c.tops[:-2]]
        got = np.exp(s.log_p(np.arange(n), np.full(n, one), np.full(n, two)))
        assert got.sum() == pytest.approx(1, abs=1e-4) and got == pytest.approx(want, rel=1e-3)
    ids = [rng.integers(0, n, k) for k in (1, 2, 70_000, 5)]
    each = [s.log_p(i, *lm.stream(i, n)).astype(float).sum() / np.log(10) for i in ids]
    assert s.texts(ids) == pytest.approx(each)


def test_scoring_takes_exponentials_once_for_each_frequent_context(monkeypatch):
    """Less than half of the exponentials of a row of top outputs and one of the class for each token, and the same probabilities: with some contexts kept, all, none, and where kept sums leave a float's range."""
    rng = np.random.default_rng(8)
    c = lm.Classes.of_counts(10**6 // np.arange(1, 3001), 4000, 10**6)
    p, n, k = c.start(), c.n_words + 2, len(c.sizes) + 2
    p.word[:] = rng.normal(0, 1, p.word.shape)
    ids = rng.choice(n, 150_000, p=c.counts / c.counts.sum())
    one, two = lm.stream(np.where(ids == c.n_words, n - 1, ids), n)

    def plain(at):
        q = (p.context[one[at]] * p.scale[0] + p.context[two[at]] * p.scale[1]).astype(float)
        s, top = q @ p.word.T + p.bias, c.tops[ids[at]]
        log_sum = lambda x: x.max() + np.log(np.exp(x - x.max()).sum())
        out = []
        for x, t, i in zip(s, top, ids[at]):
            out.append(x[t] - log_sum(x[:k]))
            if i < c.n_words:
                out[-1] += x[k + i] - log_sum(x[k + c.bounds[t] : k + c.bounds[t + 1]])
        return np.array(out)

    made, exp = [0], np.exp

    def counted(x, *args, **kw):
        made[0] += np.size(x)
        return exp(x, *args, **kw)

    monkeypatch.setattr(lm, "KEPT", 300 * n, raising=False)
    monkeypatch.setattr(np, "exp", counted)
    got = lm.ClassScorer(p, c).log_p(ids, one, two)
    monkeypatch.setattr(np, "exp", exp)
    rows = (k + np.append(c.sizes, [0, 0])[c.tops[ids]]).sum()
    assert made[0] < rows / 2, (made[0], rows)
    at = rng.integers(0, len(ids), 300)
    assert got[at] == pytest.approx(plain(at), abs=1e-4)
    for kept in (0, 20 * n):
        monkeypatch.setattr(lm, "KEPT", kept)
        assert lm.ClassScorer(p, c).log_p(ids, one, two) == pytest.approx(got, abs=1e-4)
    monkeypatch.setattr(lm, "KEPT", 10**9)
    p.context *= 300
    assert lm.ClassScorer(p, c).log_p(ids[at], one[at], two[at]) == pytest.approx(plain(at), rel=1e-4, abs=1e-2)


def test_language_model_learns_words_of_any_rank(spark):
    """5,000 words of equal count, each followed by its own partner: a model of the 1,022 most frequent words knows few of the pairs."""
    rng = np.random.default_rng(7)
    texts = [" ".join(f"a{k} b{k}" for k in rng.integers(0, 2500, 500)) for _ in range(600)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    counts = lm.word_counts(d)
    v = lm.vocabulary(counts, 600)
    assert v.classes.n_words == 5000 and v.other_types == v.other_tokens == 0
    r = lm.scored(d, F.col("doc_id") < 550).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.97 * r[1]


def test_language_model_learns_what_follows(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(x for _ in range(60) for x in (("a", "b") if rng.random() < 0.5 else ("c", "d"))) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    r = lm.scored(d, F.col("doc_id") < 150, rounds=2).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > 0.85 * r[1]


def brute_contained(a, b):
    def sh(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {("short", *w)} if w else set()

    items = [(i, sh(t)) for i, t in b]
    return {(d, i) for d, t in a for i, s in items if s and 100 * len(s & sh(t)) >= 80 * len(s)}


def test_decontamination(spark):
    rng = np.random.default_rng(4)
    w = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choice(w, rng.integers(8, 40)))) for i in range(30)] + [(90, None), (91, " "), (92, "two words")]
    texts = []
    for i in range(150):
        t = list(rng.choice(w, int(rng.choice([30, 300, 6000]))))
        if i % 3 == 0:
            t[5:5] = items[i % 30][1].split()
        texts.append((i, " ".join(t).upper() if i % 2 else " ".join(t)))
    texts += [(200, "Two words"), (201, None), (202, ""), (203, items[0][1]), (203, items[1][1]), (203, items[1][1])]
    d, b = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained(d, b).collect()}
    assert got == brute_contained(texts, items)
    bad = {i for i, _ in got}
    assert sorted(r.doc_id for r in decontaminate.decontaminated(d, b).collect()) == sorted(i for i, _ in texts if i not in bad)
    assert decontaminate.contained(d, b.where("false")).count() == 0


def test_decontamination_of_every_window(spark):
    """Each five-word window of long texts is an item, beside items of other sizes: no link of them is lost."""
    rng = np.random.default_rng(3)
    texts = [[f"x{j}" for j in rng.integers(0, 100_000, 2000)] for _ in range(3)]
    items = {" ".join(t[i : i + k]) for t in texts for k in (5, 8, 9, 14, 30) for i in range(0, len(t) - k + 1, 1 if k == 5 else 7)}
    d = spark.createDataFrame([(str(i), " ".join(t)) for i, t in enumerate(texts)], "doc_id string, text string")
    b = spark.createDataFrame(list(enumerate(sorted(items))), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_common, r.n_item) for r in decontaminate.contained(d, b).collect()}
    windows = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = {}
    for i, t in enumerate(sorted(items)):
        w = t.split()
        s = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
        for k, x in enumerate(windows):
            if 100 * len(s & x) >= 80 * len(s):
                want[str(k), i] = (len(s & x), len(s))
    assert got == want and len(want) > 7000
    clash = d.withColumn("_doc", F.lit("a")).withColumn("_hash", F.lit("b"))
    assert decontaminate.decontaminated(clash, b).count() == 0 and decontaminate.decontaminated(clash, b.where("false")).columns == clash.columns


def test_sentencepiece(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Model.load(path)
    assert m.bpe
    texts = [*ODD, *(r.text for r in docs(spark).limit(60).collect()), "a  b   c \n d\n\n e", "日本 語 🎉 é", " lead", "q▁q", "%" + "x" * 300, "tail%%" + "a" * 90 + "\n" + "b" * 70, "é%" + "z" * 64]
    texts += ["ab" * 3000 + "abc" * 700, "the" * 50]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: sp.encode(t) if t else [] for i, t in enumerate(texts)}
    x = pieces.decode(pieces.encode(d, m, check=True), m).collect()
    assert all(r.lossless for r in x)
    assert {r.doc_id: r.ids for r in x} == want
    assert {r.doc_id: r.decoded for r in x} == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)} == {i: sp.decode(v) for i, v in want.items()}
    odd_ids = spark.createDataFrame([([sp.unk_id(), 5 + m.first_byte],), ([1, 2],), ([m.first_byte + 0xE9],), (None,)], "ids array<int>")
    assert [r.decoded for r in pieces.decode(odd_ids, m).collect()] == [" ⁇ \x05", "", "\ufffd", ""]


def test_blocks_of_texts_meet_their_units(spark, monkeypatch):
    """The same ids when each text or two are a block of their own, and other columns of any name come through."""
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Model.load(path)
    d = docs(spark).limit(30).select("text", F.col("doc_id").alias("block"), F.lit("u").alias("unit"), F.lit(1).alias("a b`c"))
    monkeypatch.setattr(pieces, "BLOCK", 3000)
    monkeypatch.setattr(pieces, "PACK", 3)
    out = pieces.encode(d, m)
    assert out.columns == [*d.columns, "ids"] and pieces.encode(d, m, "unit").columns == ["unit", "ids"]
    assert sorted((r.block, r.unit, r["a b`c"], r.ids) for r in out.collect()) == sorted((r.block, "u", 1, sp.encode(r.text)) for r in d.collect())


def test_model_types():
    assert pieces.model_type(tokenizer_path("piece_bpe_32k.model")) == "bpe"
    assert list(pieces._fields(bytes([0x18, 0xAC, 0x02, 0x12, 0x01, 0x41, 0x25, 1, 2, 3, 4]))) == [(3, 300), (2, b"A"), (4, bytes([1, 2, 3, 4]))]


def test_merges_of_any_table(spark):
    """Tables in which pieces score better than their parts do, so that edges are met before they can be merged."""
    rng = np.random.default_rng(3)
    us = sorted({"".join(rng.choice(list("abc"), int(rng.integers(1, 16)))) for _ in range(150)})
    met_early = 0
    for _ in range(3):
        some = sorted({u[i : i + k] for u in us for k in (2, 3, 4) for i in range(len(u) - k + 1)})
        rng.shuffle(some)
        rank = {p: r for r, p in enumerate(some[: len(some) // 2])}
        m = pieces.Model([(c, i, 0.0) for i, c in enumerate("abc")] + [(p, 3 + r, -1.0 - r) for p, r in rank.items()], 100_000, True)
        name = {i: p for p, i, _ in m.pieces}

        def merged(u):
            out = list(u)
            while pairs := [(rank[x + y], i) for i, (x, y) in enumerate(zip(out, out[1:])) if x + y in rank]:
                i = min(pairs)[1]
                out[i : i + 2] = [out[i] + out[i + 1]]
            return out

        want = {u: merged(u) for u in us}
        lattices = pieces.lattice(spark.createDataFrame([(u,) for u in us], "unit string"), m).collect()
        cuts = {r.unit: pieces.merged(r.edges, len(r.unit)) for r in lattices}
        assert {u: [u[i:j] for i, j in zip(c, c[1:])] for u, c in cuts.items()} == want
        got = {r.unit: [name[i] for i in r.ids] for r in pieces.segmented(spark.createDataFrame([(u, 1) for u in us], "unit string, n long"), m).collect()}
        assert got == want
        met_early += sum(len(p) > 2 and all(q not in rank or rank[q] > rank[p] for q in (p[:-1], p[1:])) for u in want.values() for p in u)
    assert met_early > 10


def test_viterbi(spark):
    table = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.9, "bc": -3.1, "abc": -6.5, "▁": -1.0, "▁a": -3.2, "ca": -4.0, "cab": -5.5}
    m = pieces.Model([(p, i, s) for i, (p, s) in enumerate(table.items())], 100, False)

    def best(u):
        b = [(0.0, [])] + [(-1e9, [])] * len(u)
        for j in range(1, len(u) + 1):
            b[j] = max(((b[i][0] + table.get(u[i:j], -16.5 if j - i == 1 else -1e9), [*b[i][1], u[i:j]]) for i in range(j)), key=lambda x: x[0])
        return b[-1][1]

    us = ["▁abc", "▁cab", "▁aabbcc", "abcabcab", "▁", "▁bcab", "▁" + "abcca" * 20]
    got = {r.unit: r.ids for r in pieces.segmented(spark.createDataFrame([(u, 1) for u in us], "unit string, n long"), m).collect()}
    score = lambda ids: sum(list(table.values())[i] for i in ids)
    for u in us:
        assert "".join(list(table)[i] for i in got[u]) == u and score(got[u]) == pytest.approx(sum(table[p] for p in best(u)))


def test_language_id(spark):
    d = docs(spark).withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    m = langid.fit(d.where("NOT held_out"))
    r = langid.predict(d, m, "doc_id", "lang", "held_out").where("held_out AND lang_pred <> 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert r > 0.95
    out = {x.text: x for x in langid.predict(odd(spark), m, "text").collect()}
    assert all(out[t].lang_pred == "und" and out[t].score == 0 for t in ("", None, " \n\t ")) and out["a b"].lang_pred in m.languages
    assert langid.predict(odd(spark), langid.fit(d.where("false")), "doc_id").where("lang_pred <> 'und'").count() == 0


def test_language_sample_forgets_no_language(spark):
    rows = [(x, f"{x} one text of this language" if i else f"{x} text {j} of many") for i, x in enumerate(("aa", "bb", "cc", "dd", "ee")) for j in range(1500)] + [("ff", "a rare language"), (None, "no label"), ("gg", "½ ² ① Ⅷ 12"), ("hh", None)]
    d = spark.createDataFrame(rows, "lang string, text string")
    s = Counter(r.lang for r in langid.sample(d).collect())
    assert s == {"aa": 1000, "bb": 1, "cc": 1, "dd": 1, "ee": 1, "ff": 1}
    m = langid.fit(d)
    assert m.languages == ["aa", "bb", "cc", "dd", "ee", "ff"]
    assert [x for x, *_ in m.predict(["½", "²²", "①", "Ⅷ", "ab"])][:4] == ["und"] * 4


def test_language_is_that_of_the_nearest_centroid(spark):
    """Cosines by plain loops over n-grams, on the model's own centroids."""
    d = docs(spark)
    m = langid.fit(d)
    for r in langid.predict(d.orderBy("doc_id").limit(60), m, "doc_id", "text").collect():
        if not langid.has_letter(r.text):
            continue
        t = re.sub(rb"[^a-z\x80-\xff]+", b" ", f" {r.text} ".encode().lower())
        x = np.zeros(langid.DIMENSIONS)
        for k in (2, 3):
            for j in range(len(t) - k + 1):
                h = int.from_bytes(t[j : j + k], "big") + (1 << 24 if k == 3 else 0)
                x[h * 2654435761 % 2**32 >> 20] += 1
        x = np.log1p(x) * m.idf
        cos = (m.centroids @ x) / np.linalg.norm(x)
        assert r.score == pytest.approx(float(cos.max()), abs=1e-4)
        assert cos.max() - cos[[m.languages[o] == r.lang_pred for o in m.owner]].max() < 1e-4


def test_long_texts_are_counted_in_parts(monkeypatch):
    t = "some words é here, and more. " * 50
    want = langid.counts(t)
    monkeypatch.setattr(langid, "PART", 7)
    assert (langid.counts(t) == want).all()


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = [*ODD, *(r.text for r in docs(spark).limit(80).collect()), "it's  we'll\n\n  x　y\x85z ​ 12½", "日本語 🎉🎉"]
    got = {r.doc_id: r for r in tokencount.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, 512, "doc_id").collect()}
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((x or "").encode()), n > 512), x


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = bwords(t)
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    c = {i: i for i in sets}
    for _ in range(20):
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    c[a] = c[b] = min(c[a], c[b])
    return {i: (len(sets[i]), c[i]) for i in sets}


def test_units():
    m = pieces.Model.load(tokenizer_path("piece_bpe_32k.model"))
    pairs = m.pairs
    long_words = ["%" + "x" * 300, "tail%%" + "a" * 90 + "\n" + "b" * 70, "  " * 50 + "#" * 80, "é%" + "z" * 64]
    cutters = [pieces.Cutter(pairs), pieces.Cutter(pairs)]
    cutters[1].table = None  # as for models of very many characters
    for t in [*ODD, *long_words, "", None]:
        us = cutters[0](pieces.words(t))[0]
        assert us == cutters[1](pieces.words(t))[0]
        assert "".join(us) == "".join(pieces.words(t)) == ("" if not t else "\u2581" + t.replace(" ", "\u2581"))
        assert not any(u[i : i + 2] not in pairs for u in us for i in range(len(u) - 1))
        assert all(x + y in pairs for u in us for x, y in zip(u, u[1:]))


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    rng = np.random.default_rng(5)
    w = [f"w{i}" for i in range(900)]
    rows = []
    base, passage = list(rng.choice(w, 200)), list(rng.choice(w, 120))
    for i in range(120):
        t = list(base) if i % 3 == 0 else passage + list(rng.choice(w, 60)) if i % 3 == 1 else list(rng.choice(w, 50))
        for _ in range(int(rng.integers(0, 12))):
            t[int(rng.integers(len(t)))] = "edit" + str(rng.integers(99))
        rows.append((i, " ".join(t)))
    rows += [(300, rows[3][1].upper()), (301, "one"), (302, "One"), (303, ""), (304, None), (305, "a b"), (306, "b a")]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(rows, size, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_rare_agreements_lose_no_similar_pair(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(150)]
    texts = {0: base}
    for i in range(1, 90):
        t = list(base if i % 3 or i < 4 else texts[1 + i // 3 % 3])  # some are copies of copies, similar to them but not to the centre
        for _ in range(25 if i < 4 else int(rng.integers(2, 12))):
            t[int(rng.integers(len(t)))] = "edit" + str(rng.integers(999))
        texts[i] = t[: len(t) - int(rng.integers(0, 6))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    sets = {i: set(zip(t, t[1:])) for i, t in texts.items()}
    alike = lambda x, y: 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])
    members = spark.createDataFrame([(i, i, 0, 0) for i in texts if i], "v long, c long, p long, m long")
    diffs = neardup.differences(members, docs.withColumnRenamed("doc_id", "v"), 2)
    assert {r.v: len(r["diff"]) for r in diffs.collect()} == {i: len(sets[i] ^ sets[0]) for i in texts if i}
    got = {(r.x, r.y) for r in neardup.rare_agreements(diffs, 80).collect()}
    far = [i for i in texts if i and not alike(i, 0)]
    want = {(min(x, y), max(x, y)) for x in far for y in texts if y not in (0, x) and alike(x, y)}
    assert len(want) > 10 and want <= got
    assert len(got) < len(far) * len(texts) / 4


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    d = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "x y z"), (1, "x y z"), (2, "x y z"), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(d, 2).collect()), key=repr)
    assert got == sorted([(None, None, True)] * 2 + [(1, 1, True)] * 2 + [(2, 1, False), (3, 3, True)], key=repr)
    assert sorted((r.doc_id for r in neardup.deduplicated(d, 2).collect()), key=repr) == [1, 3, None, None]


def test_near_duplicates_of_ids_with_several_texts(spark):
    """An id links the classes of all its texts, and each text is compared as it is."""
    w = " ".join(f"w{i}" for i in range(40))
    rows = [("1", "aaa aaa aaa bbb"), ("1", w), ("2", w + " extra"), ("3", "aaa aaa aaa bbb"), ("4", "alone"), ("4", ""), ("5", ""), ("6", None)]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    out = neardup.near_duplicates(d, 2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [("1", "1", True)] * 2 + [("2", "1", False), ("3", "1", False)] + [("4", "4", True)] * 2 + [("5", "5", True), ("6", "6", True)]
    assert sorted(r.doc_id for r in neardup.deduplicated(d.withColumn("_gone", F.lit(1)), 2).collect()) == ["1", "4", "5", "6"]


def test_bands_take_different_functions():
    sig = np.arange(2 * neardup.FUNCTIONS, dtype=np.uint64)
    base, hit = neardup.band_keys(sig), {}
    for i in range(len(sig)):
        x = sig.copy()
        x[i] += np.uint64(10_000)
        hit[i] = set(np.flatnonzero(neardup.band_keys(x) != base))
    assert all(len(h) == 1 for h in hit.values())
    for b in range(neardup.BANDS):
        assert len({i % neardup.FUNCTIONS for i, h in hit.items() if b in h}) == neardup.ROWS


def test_frequent_keys_meet_the_same_rows(spark):
    from grovewise.llm.common import join_on_hot

    rows = spark.range(100).select((F.col("id") % 7).alias("k"), "id").unionByName(spark.range(50).select(F.lit(3).cast("long").alias("k"), "id"))
    sizes = rows.where("k < 6").groupBy("k").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(sizes, "k").collect()))
    assert all(sorted(map(tuple, join_on_hot(rows, sizes, "k", "n", hot).collect())) == want for hot in (1, 40, 1000))


@pytest.mark.parametrize("block", [20, 200_000])
def test_sharding(spark, monkeypatch, block):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", block)
    monkeypatch.setattr(sharding, "PIECE", 100)
    d = spark.range(0, 10_003, 1, 7).select(F.col("id").alias("doc_id"))
    out = sharding.assign(d, 40, [F.col("doc_id")]).collect()
    n = Counter(r.shard for r in out)
    assert len({r.doc_id for r in out}) == 10_003 and len(n) == 40 and max(n.values()) - min(n.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n[s])) for s in (0, 3, 39))
    by = Counter((r.doc_id // 1430, r.shard) for r in out)
    assert max(by.values()) < 75 and np.corrcoef([r.doc_id for r in out], [r.slot for r in out])[0, 1] < 0.05
    same = sharding.assign(spark.createDataFrame([(1,)] * 50, "doc_id long").coalesce(1), 40, [F.col("doc_id")]).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in same) == [1] * 30 + [2] * 10
    assert sharding.assign(d.where("false"), 40, [F.col("doc_id")]).count() == 0


def test_sharding_keeps_columns_of_any_name(spark):
    names = ["shard", "slot", "_p", "_a", "_b", "_j", "_ends", "_s", "_c", "_n", "a b"]
    d = spark.createDataFrame([tuple([i if i % 4 else None] * len(names)) for i in range(90)] * 2, ", ".join(f"`{c}` long" for c in names))
    out = sharding.assign(d, 7, [F.col("_p")])
    assert out.columns == [*names, "shard_", "slot_"] and out.select(*(f"`{c}`" for c in names)).exceptAll(d).isEmpty()
    assert sorted(Counter(r.shard_ for r in out.collect()).values()) == [25] * 2 + [26] * 5


def test_communication_matrix():
    sizes = sharding.shard_sizes(1003, 7)
    m = np.stack(list(sharding.draw([3, 0, 500, 500], sizes, 1)))
    assert m.sum(1).tolist() == [3, 0, 500, 500] and (m.sum(0) == sizes).all()
    # one row of a shuffle is hypergeometric: its mean over seeds is in proportion to the shards
    mean = np.mean([next(sharding.draw([100, 903], sizes, s)) for s in range(300)], axis=0)
    assert np.abs(mean - 100 / 7).max() < 0.8


def test_preference_pairs(spark):
    t = [(0, 0, "user", "hi"), (0, 1, "assistant", "good"), (1, 1, "assistant", "bad"), (1, 0, "user", "hi"), (1, 2, None, None), (4, 0, "user", "x"), (6, 0, "user", "x"), (7, 0, "user", "x")]
    turns = spark.createDataFrame(t, "conv_id long, turn long, role string, text string")
    out = {r.pair_id: r for r in chat.preference_pairs(turns, chat.neighbours(turns)).collect()}
    a = out[0]
    assert a.n_prefix == 1 and a.prompt == "<|im_start|>user\nhi<|im_end|>\n" and a.chosen == "<|im_start|>assistant\ngood<|im_end|>\n"
    assert [a.chosen[s.start : s.end] for s in a.chosen_mask] == ["good<|im_end|>\n"] and [a.rejected[s.start : s.end] for s in a.rejected_mask] == ["bad<|im_end|>\n"]
    assert (out[2].n_prefix, out[2].prompt, out[2].rejected) == (0, "", None) and out[2].chosen.endswith("x<|im_end|>\n")
    assert (out[3].n_prefix, out[3].chosen, out[3].rejected) == (1, "", "")
    assert chat.preference_pairs(turns.where("false"), chat.neighbours(turns.where("false"))).count() == 0
    big = spark.createDataFrame([(2**53 + i, 0, "user", "x") for i in range(4)], "conv_id long, turn long, role string, text string").withColumn("_c", F.lit(1))
    assert sorted((r.chosen_id, r.rejected_id, r.n_prefix) for r in chat.preference_pairs(big, chat.neighbours(big)).collect()) == [(2**53 + i, 2**53 + i + 1, 1) for i in (0, 2)]
    named = spark.createDataFrame([("6", 0, "user", "x"), ("7", 0, "user", "x"), ("a", 0, "user", "x")], "conv_id string, turn long, role string, text string")
    assert [(r.chosen_id, r.n_prefix) for r in chat.preference_pairs(chat.numbered(named), chat.neighbours(named)).collect()] == [(6, 1)]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_site_lines(spark, broadcast):
    pages = [(i, "h", f"menu\nbody {i}\n\n menu ") for i in range(20)] + [(30 + i, "h", "copy of a page") for i in range(9)] + [(50, None, "menu"), (51, "h", None), (52, "g", "menu"), (53, "h", "")]
    d = spark.createDataFrame(pages, "page_id long, host string, text string")
    for distinct in (False, True):
        out = {r.page_id: r for r in lines.drop_boilerplate(d, "host", "text", 0.3, distinct=distinct, broadcast=broadcast).collect()}
        assert out[3].text == "body 3\n" and (out[3].n_lines, out[3].n_dropped) == (4, 2)
        assert out[30].text == "copy of a page"  # 9 of 30 pages, 0.3 at most
        assert out[50].text == "menu" and out[51].text is None and out[52].text == "menu" and out[53].text == ""
    assert lines.drop_boilerplate(d.where("false"), "host", "text").count() == 0


@pytest.mark.parametrize("distinct", [False, True])
def test_site_lines_of_hosts_of_any_size(spark, distinct):
    """Every host size from 1 to 60: a menu on all pages, a line on two pages, and one on a tenth of them and one more."""
    pages = []
    for n in range(1, 61):
        for i in range(n):
            t = ["menu", f"body {n} {i}"] + ["twice"] * (i < 2) + ["tenth"] * (i < n // 10 + 1)
            pages += [(len(pages) + j, f"h{n}", "\n".join(t)) for j in range(1 + (i == 0 and n > 1))]
    d = spark.createDataFrame(pages, "page_id long, host string, text string")
    texts = {h: [t for _, x, t in pages if x == h] for h in {x for _, x, _ in pages}}
    if distinct:  # a copy of the first page counts once
        texts = {h: set(t) for h, t in texts.items()}
    seen = {h: Counter(s for t in ts for s in set(t.split("\n"))) for h, ts in texts.items()}
    bad = {h: {s for s, k in c.items() if k >= 2 and k > 0.1 * len(texts[h])} for h, c in seen.items()}
    assert bad["h1"] == set() and {"menu", "twice"} <= bad["h2"] and {"menu", "twice"} <= bad["h4"] and {"menu", "tenth"} <= bad["h20"]
    for broadcast in (10, 100_000):
        out = {r.page_id: r for r in lines.drop_boilerplate(d, "host", "text", distinct=distinct, broadcast=broadcast).collect()}
        for i, h, t in pages:
            kept = [s for s in t.split("\n") if s not in bad[h]]
            assert (out[i].text, out[i].n_dropped) == ("\n".join(kept), t.count("\n") + 1 - len(kept)), (h, t)


def test_page_text(spark):
    rows = [(1, "HTTPS://u@Ex.org:8/x", "<p>a <b>b</b></p><script>x\n</script>\n c"), (2, "nothing", ""), (3, None, None)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").select("page_id", lines.host_of(F.col("url")).alias("h"), lines.html_text(F.col("html")).alias("t"))
    assert [tuple(r) for r in d.orderBy("page_id").collect()] == [(1, "ex.org", "a b\nc"), (2, None, ""), (3, None, None)]


@pytest.mark.parametrize("rows", [odd, empty])
def test_odd_and_empty_tables(spark, rows):
    d, n = rows(spark), rows(spark).count()
    m = pieces.Model.load(tokenizer_path("piece_bpe_32k.model"))
    items = d.select(F.col("doc_id").alias("item_id"), "text")
    assert quality.judged(d).count() == n and quality.kept(d).columns == d.columns
    assert lm.scored(d, F.lit(True)).count() == n and lm.scored(d, F.lit(False)).count() == n
    assert decontaminate.decontaminated(d, items.where("false")).count() == n and decontaminate.contained(d, items).where("n_common > n_item").count() == 0
    assert pieces.decode(pieces.encode(d, m, check=True), m).where('lossless').count() == n and neardup.near_duplicates(d).count() == n and neardup.deduplicated(d).columns == d.columns
    assert lines.drop_boilerplate(d, "source", "text").count() == n
    assert tokencount.token_counts(d, tokenizer_path("byte_bpe_50k.json"), 512, "doc_id").count() == n
