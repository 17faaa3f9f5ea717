"""Site statistics as one aggregate over allele counts.

Numerators are integer polynomials in the counts. They are summed exactly, and divided once, so
results do not depend on how rows are partitioned. Undefined ratios are NULL.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.operators.folds import Fold

WIDE = "decimal(38,0)"


def _ratio(df: DataFrame, name: str, terms: Column, denominator: int) -> DataFrame:
    x = df.agg(F.coalesce(F.sum(terms), F.lit(0).cast(WIDE)).cast(WIDE).alias("numerator"))
    below = F.lit(str(denominator)).cast(WIDE)
    return x.select((F.col("numerator").cast("double") / F.nullif(below.cast("double"), F.lit(0.0))).alias(name), "numerator", below.alias("denominator"))


def _product(*xs: Column) -> Column:
    """A product in decimals wide enough for four counts."""
    return reduce(lambda a, b: (a * b).cast(WIDE), (x.cast("decimal(18,0)") for x in xs))


def diversity(counts: DataFrame, n: int, a: str = "n_0") -> DataFrame:
    c = F.col(a)
    return _ratio(counts, "diversity", _product(c, n - c), n * (n - 1))


def divergence(counts: DataFrame, n_a: int, n_b: int, a: str = "n_0", b: str = "n_1") -> DataFrame:
    return _ratio(counts, "divergence", _product(F.col(a), n_b - F.col(b)), n_a * n_b)


def segregating_sites(counts: DataFrame, a: str = "n_0") -> DataFrame:
    """States with samples beyond the first, over all sites."""
    per = counts.where(F.col(a) > 0).groupBy("site_id").agg((F.count("*") - 1).alias("k"))
    return per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("segregating_sites"))


def afs(counts: DataFrame, n: int, a: str = "n_0") -> DataFrame:
    """(num_derived, num_sites) for 0..n: derived states by their number of samples. Bin n counts states that all
    samples have; bin 0 is always 0."""
    spine = counts.sparkSession.range(n + 1).select(F.col("id").alias("num_derived"))
    bins = counts.where(~F.col("is_ancestral") & (F.col(a) > 0)).groupBy(F.col(a).alias("num_derived")).agg(F.count("*").alias("k"))
    return spine.join(bins, "num_derived", "left").select("num_derived", F.coalesce("k", F.lit(0)).alias("num_sites"))


def tajimas_constants(n: int) -> dict[str, float]:
    """The constants of Tajima's 1989 test for n >= 2 sequences, under the names of the paper."""
    k = {"a1": math.fsum(1 / i for i in range(1, n)), "a2": math.fsum(i**-2 for i in range(1, n)), "b1": (n + 1) / (3 * (n - 1)), "b2": 2 * (n**2 + n + 3) / (9 * n * (n - 1))}
    k["c1"] = k["b1"] - 1 / k["a1"]
    k["c2"] = k["b2"] - (n + 2) / (k["a1"] * n) + k["a2"] / k["a1"] ** 2
    return {**k, "e1": k["c1"] / k["a1"], "e2": k["c2"] / (k["a1"] ** 2 + k["a2"])}


def tajimas_d(counts: DataFrame, n: int, a: str = "n_0") -> DataFrame:
    """One row: tajimas_d, the mean number of differences less Watterson's estimate over the standard deviation of both;
    NULL without segregating sites or with fewer than two samples."""
    if n < 2:
        return counts.agg(F.lit(None).cast("double").alias("tajimas_d"))
    k = tajimas_constants(n)
    # one row per site: its share of the mean number of differences, and its segregating states
    c = F.col(a)
    site = counts.where(c > 0).groupBy("site_id").agg(F.sum(_product(c, n - c)).alias("differences"), (F.count("*") - 1).alias("states"))
    both = site.agg((F.sum("differences").cast("double") / float(n * (n - 1))).alias("pi"), F.sum("states").cast("double").alias("seg"))
    seg = F.col("seg")
    deviation = F.sqrt(k["e1"] * seg + k["e2"] * seg * (seg - 1))
    return both.select(F.when(seg > 0, (F.col("pi") - seg / k["a1"]) / deviation).alias("tajimas_d"))


def tajimas_fold(n: int) -> Fold:
    """The same for n >= 2 samples, as a fold over states: a site's counts add up to n, so sites are counted without being grouped."""
    k = tajimas_constants(n)

    def update(s: tuple, rows: pa.RecordBatch) -> tuple:
        c = rows.column("n_0").to_numpy(zero_copy_only=False)
        return s[0] + sum((c * (n - c)).tolist()), s[1] + int((c > 0).sum()), s[2] + sum(c.tolist())

    seg = f"(states - carriers div {n})"
    deviation = f"sqrt({k['e1']!r}D * {seg} + {k['e2']!r}D * {seg} * ({seg} - 1))"
    d = f"CASE WHEN {seg} > 0 THEN (cast(differences AS double) / {float(n * (n - 1))!r}D - {seg} / {k['a1']!r}D) / {deviation} END"
    return Fold("differences decimal(38,0), states long, carriers long", lambda: (0, 0, 0), update, lambda a, b: tuple(int(x) + int(y) for x, y in zip(a, b)), {"tajimas_d": d})


def fst(counts: DataFrame, n_a: int, n_b: int, a: str = "n_0", b: str = "n_1") -> DataFrame:
    """1 - 2 (d_A + d_B) / (d_A + 2 d_AB + d_B), with the set's own size in each diversity; NULL without variation."""
    ca, cb = F.col(a), F.col(b)
    x = counts.agg(*(F.coalesce(F.sum(_product(*f)), F.lit(0).cast(WIDE)).cast("double").alias(k) for k, f in (("x", (ca, n_a - ca)), ("y", (cb, n_b - cb)), ("z", (ca, n_b - cb)))))
    div = lambda c, d: F.col(c) / F.nullif(F.lit(float(d)), F.lit(0.0))
    da, db, dab = div("x", n_a * (n_a - 1)), div("y", n_b * (n_b - 1)), div("z", n_a * n_b)
    return x.select((1 - 2 * (da + db) / F.nullif(da + 2 * dab + db, F.lit(0.0))).alias("fst"))


def f2(counts: DataFrame, n: tuple[int, int], s: tuple[str, str] = ("n_0", "n_1")) -> DataFrame:
    (a, b), (na, nb) = map(F.col, s), n
    return _ratio(counts, "f2", _product(a, a - 1, nb - b, nb - b - 1) - _product(a, na - a, b, nb - b), na * (na - 1) * nb * (nb - 1))


def f3(counts: DataFrame, n: tuple[int, int, int], s: tuple[str, str, str] = ("n_0", "n_1", "n_2")) -> DataFrame:
    (a, b, c), (na, nb, nc) = map(F.col, s), n
    return _ratio(counts, "f3", _product(a, a - 1, nb - b, nc - c) - _product(a, na - a, nb - b, c), na * (na - 1) * nb * nc)


def f4(counts: DataFrame, n: tuple[int, int, int, int], s: tuple[str, str, str, str] = ("n_0", "n_1", "n_2", "n_3")) -> DataFrame:
    (a, b, c, d), (na, nb, nc, nd) = map(F.col, s), n
    return _ratio(counts, "f4", _product(a, nb - b, c, nd - d) - _product(a, nb - b, nc - c, d), na * nb * nc * nd)
