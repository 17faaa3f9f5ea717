"""Sharding at any size, and pairs of conversations with any ids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovewise.llm import chat, sharding


def test_draws_at_any_size():
    """5e10 rows in 40 shards: exact sums, and the mean and variance of a hypergeometric number."""
    rows, shards, parts = 50_000_000_007, 40, 500
    counts = [rows // parts + (i < rows % parts) for i in range(parts)]
    sizes = sharding.shard_sizes(rows, shards)
    out = np.array(list(sharding.draw(counts, sizes, 1)))
    assert (out.sum(1) == counts).all() and (out.sum(0) == sizes).all() and (out >= 0).all()
    n, p = counts[0], 1 / shards
    sd = math.sqrt(n * p * (1 - p) * (rows - n) / (rows - 1))
    z = (out - n * p) / sd
    assert abs(z.mean()) < 0.05 and 0.95 < z.std() < 1.05 and np.abs(z).max() < 6


@pytest.mark.parametrize("good,bad,n", [(30, 50, 20), (5, 400, 60), (200, 3, 100), (40, 40, 79)])
def test_own_sampler_is_hypergeometric(monkeypatch, good, bad, n):
    """The sampler for large numbers, on small ones, against the probabilities."""
    monkeypatch.setattr(sharding, "LARGE", 0)
    rng, times = np.random.default_rng(2), 40_000
    got = np.bincount([sharding.hypergeometric(rng, good, bad, n) for _ in range(times)], minlength=n + 1)
    want = np.array([math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) if 0 <= n - k <= bad and k <= good else 0 for k in range(n + 1)]) * times
    some = want > 5
    assert ((got[some] - want[some]) ** 2 / want[some]).sum() < some.sum() + 5 * math.sqrt(2 * some.sum()) and got[want == 0].sum() == 0


def test_rises_of_large_factorials():
    for x, d in ((5 * 10**10, 12345), (10**9, -40_000), (1 << 20, 3), (3_000_000, -1)):
        exact = sum(math.log1p(i / (x + 1)) for i in range(d)) if d > 0 else -sum(math.log1p((d + i) / (x + 1)) for i in range(-d))
        assert sharding._log_rise(x, d) == pytest.approx(exact, abs=1e-7)


def test_changed_partitions_fail(spark):
    """A partition with fewer rows than were counted is an error, as one with more is."""
    df = spark.range(1000).repartition(4)
    real = sharding.matrix
    for delta in (-3, 3):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(sharding, "matrix", lambda d, found, *a: real(d, {p: n + delta for p, n in found.items()}, *a))
            with pytest.raises(Exception, match="rows than were counted"):
                sharding.assign(df, 7, [F.col("id")]).collect()


def test_write_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 50)
    df = spark.range(1003).withColumn("shard", F.lit("x"))
    sharding.write_shards(df, str(tmp_path / "s"), 4, [F.col("id")])
    out = spark.read.parquet(str(tmp_path / "s"))
    assert out.columns == ["id", "shard", "slot", "shard_"] and out.select("id").distinct().count() == 1003
    found = {}
    for r in out.collect():
        found.setdefault(r.shard_, []).append(r.slot)
    assert {k: sorted(v) for k, v in found.items()} == {k: list(range(251 - (k == 3))) for k in range(4)}


def test_ids_of_conversations(spark):
    turns = lambda *ids: spark.createDataFrame([(i, 0, "user", "same") for i in ids] + [(i, 1, "assistant", str(i)) for i in ids], f"conv_id {'string' if isinstance(ids[0], str) else 'double'}, turn int, role string, text string")
    for bad in (turns("c-1", "c-2"), turns(1.5, 2.0)):
        with pytest.raises(Exception, match="not a whole number"):
            chat.neighbours(bad, strict=True).collect()
    t = turns("c-1", "c-2", "c-3")
    out = {r.pair_id: r for r in chat.preference_pairs(t, chat.ranked_pairs(t)).collect()}
    assert [(out[k].chosen_id, out[k].rejected_id, out[k].n_prefix) for k in (0, 1)] == [("c-1", "c-2", 1), ("c-3", None, 0)]
    assert "c-1" in out[0].chosen and "c-2" in out[0].rejected and out[1].rejected is None
    assert chat.ranked_pairs(t.where("false")).count() == 0 == chat.neighbours(turns("1").where("false")).count()
