"""Robust multivariate outliers: minimum-covariance-determinant (MCD) estimates per language and source.

Each text becomes a vector of transformed statistics. A group's location and scatter come from
the half of its rows whose covariance has the least determinant. Concentration steps find it: all of a group's rows are measured by the current estimate, the half
nearest to it gives the next one. Three starts take two steps each, the one of least determinant goes on until no group's determinant falls.
Steps run over all rows of all groups at once: distances are counted by group in fine logarithmic bins, which gives the bin of the half's last row,
and sums over the rows up to it give mean and covariance. So a group of any size has one estimate, and no task holds a group.
One reweighting pass over all rows follows. A text is rejected when its squared Mahalanobis distance passes a chi-square cutoff.

A group's estimate is mixed with its language's, and a language's with that of all rows, in proportion of its rows to `PRIOR`, at every size: few rows say little of
their own, many decide alone.

Cases: a NULL or empty text has no words and fails the base rule; its vector is zero and takes no part in estimates; NULL
languages and sources are groups of their own; repeated rows count as often as they occur; rows at equal distance, in one bin, are in the half or out of it together;
equal vectors (no scatter) are held apart from zero by a floor on each statistic's variance; a very long text is one vector; an empty table gives an empty result;
ids may be of any type; other columns are ignored or pass through, whatever their names.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovewise.llm.common import broadcast_if, fresh, join_on_hot, mapped, one_of, release, short_plans, stored

MIN_WORDS, MOST_REPEATED = 50, 50
#: Rows that a group's parent counts for; most concentration steps; bins of distance for each factor of e; a fall of the log determinant that counts.
PRIOR, STEPS, FINE, FALL = 30, 20, 256, 1e-4
#: The share of good texts that the cutoff would reject if vectors were normal.
ALPHA = 1e-6
#: The transformed statistics and the standard deviation under which none of them is taken to fall.
FEATURES = {"log_word_length": 0.05, "symbol_share": 0.03, "upper_share": 0.05, "mark_share": 0.05, "repeat_share": 0.15, "dup_line_share": 0.15}
NAMES = list(FEATURES)
P = len(NAMES)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
FLOOR = np.diag([s * s for s in FEATURES.values()])
#: Groups whose estimates (about 300 bytes each) are broadcast; beyond, those of so many rows are.
BROADCAST_GROUPS, HOT = 20_000, 10_000
_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\v\f\r"
_UPPER, _LETTER, _MARK = string.ascii_uppercase.encode(), string.ascii_letters.encode(), string.punctuation.encode()
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five base counts, and the vector of transformed statistics."""
    if not text:
        return [0] * 5, [0.0] * P
    raw = text.encode("utf-8", "surrogatepass")
    w = raw.split()
    n = len(w)
    size = lambda of: len(raw) - len(raw.translate(None, of))
    chars, symbols = len(text) - size(_SPACE), size(_SYMBOLS)
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        a = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int64, n)
        k = len(ids)
        if k < 2_000_000:
            _, where, count = np.unique((a[:-2] * k + a[1:-1]) * k + a[2:], return_inverse=True, return_counts=True)
        else:  # the products above would leave 64 bits
            _, where = np.unique(a[:-2] * k + a[1:-1], return_inverse=True)
            _, where, count = np.unique(where * k + a[2:], return_inverse=True, return_counts=True)
        twice = count[where] > 1
        covered = np.zeros(n, bool)
        covered[:-2] |= twice
        covered[1:-1] |= twice
        covered[2:] |= twice
        repeat = int(covered.sum())
    letters = size(_LETTER)
    v = [math.log(chars / n) if n else 0.0, math.sqrt(symbols / max(1, chars)), math.sqrt(size(_UPPER) / max(1, letters)), math.sqrt(size(_MARK) / max(1, chars)), math.sqrt(repeat / max(1, n)), math.sqrt(dup / max(1, lines))]
    return [n, chars, symbols, dup, repeat], v


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, base counts, vector): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(x.as_py()) for x in b.column("text")]
            counts = list(zip(*(c for c, _ in found))) or [()] * 5
            cols = [pa.array(c, pa.int64()) for c in counts] + [pa.array(c, pa.float64()) for c in (list(zip(*(v for _, v in found))) or [()] * P)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(3)] + cols, names=["doc_id", "lang", "source", *(x.split()[0] for x in BASE.split(", ")), *NAMES])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, source string, {BASE}, " + ", ".join(f"{c} double" for c in NAMES)
    return mapped(docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text"), run, schema)


def chi_square(q: float, p: int) -> float:
    """Quantile of the chi-square distribution, by the cube-root normal approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * math.sqrt(2 / (9 * p))) ** 3


def _part(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.char_length(c).cast("string"), F.lit(":"), F.col(c)))


def _keys() -> tuple[Column, Column, Column]:
    """The names of a row's groups: its language and source, its language, and all."""
    return F.concat(F.lit("2/"), _part("lang"), F.lit("/"), _part("source")), F.concat(F.lit("1/"), _part("lang")), F.lit("0")


def _vector(x: DataFrame) -> DataFrame:
    """(g, up, v): each row with words in its three groups, with the group above."""
    two, one, zero = _keys()
    groups = F.explode(F.array(*(F.struct(g.alias("g"), up.alias("up")) for g, up in ((two, one), (one, zero), (zero, F.lit(None).cast("string")))))).alias("k")
    return x.where("n_words > 0").select(F.array(*NAMES).alias("v"), groups).select("k.g", "k.up", "v")


def _meet(rows: DataFrame, table: DataFrame, groups: int) -> DataFrame:
    """Rows with their group's row of a table that has g and n."""
    return rows.join(F.broadcast(table), "g") if groups <= BROADCAST_GROUPS else join_on_hot(rows, table, "g", "n", HOT)


def _quadratic(m: Column, c: Column) -> Column:
    d = [F.get("v", F.lit(i)) - F.get(m, F.lit(i)) for i in range(P)]
    return sum((F.get(c, F.lit(k)) * (1.0 if i == j else 2.0) * d[i] * d[j] for k, (i, j) in enumerate(PAIRS)), F.lit(0.0))


def _moments(rows: DataFrame, *by: str) -> DataFrame:
    """(by..., k, m, c): number, mean and covariance, summed about the group's `middle`."""
    d = [F.get("v", F.lit(i)) - F.get("middle", F.lit(i)) for i in range(P)]
    sums = rows.groupBy(*by).agg(F.count("*").alias("k"), F.any_value("middle").alias("middle"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(d)), *(F.sum(d[i] * d[j]).alias(f"s{i}_{j}") for i, j in PAIRS))
    mean = [F.col(f"s{i}") / F.col("k") for i in range(P)]
    cov = F.array(*(F.col(f"s{i}_{j}") / F.col("k") - mean[i] * mean[j] for i, j in PAIRS))
    return sums.select(*by, "k", F.array(*(F.get("middle", F.lit(i)) + mean[i] for i in range(P))).alias("m"), cov.alias("c"))


def square(c: np.ndarray) -> np.ndarray:
    out = np.zeros((P, P))
    for (i, j), v in zip(PAIRS, c):
        out[i, j] = out[j, i] = v
    return out


def _solved(df: DataFrame) -> DataFrame:
    """Adds i and det: the inverse of the covariance c, and the logarithm of its determinant; one small row per group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            full = [square(c) for c in b.column("c").to_pylist()]
            i = pa.array([[float(x[i, j]) for i, j in PAIRS] for x in map(np.linalg.inv, full)], pa.list_(pa.float64()))
            yield b.append_column("i", i).append_column("det", pa.array([float(np.linalg.slogdet(x)[1]) for x in full], pa.float64()))

    return mapped(df, run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", i array<double>, det double")


_FLAT = [float(FLOOR[i, j]) for i, j in PAIRS]


def _floored(c: Column, factor: Column | float = 1.0) -> Column:
    return F.array(*(F.get(c, F.lit(k)) * factor + f for k, f in enumerate(_FLAT)))


def _concentrated(near: DataFrame, sizes: DataFrame, groups: int) -> DataFrame:
    """(g, n, middle, tries): from rows (g, start, d, v, middle, n), the estimates of the nearer half for each start; each with `far`, the distance of the half's last row."""
    bin_ = F.floor(F.log(F.col("d") + 1e-12) * FINE)
    hist = near.groupBy("g", "n", "start", bin_.alias("b")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(W.partitionBy("g", "start").orderBy("b"))
    half = F.least(F.floor((F.col("n") + (P + 1)) / 2), F.col("n"))
    last = hist.withColumn("upto", upto).where(F.col("upto") >= half).groupBy("g", "start").agg(F.min("b").alias("b"))
    last = stored(last.groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("start", "b"))).alias("last")).join(sizes, "g"), "halves", narrow=True)
    inside = _meet(near.drop("n", "up", "middle"), last, groups).where(bin_ <= F.try_element_at("last", F.col("start")))
    m = _moments(inside, "g", "start").withColumn("c", _floored(F.col("c")))
    far = F.exp((F.try_element_at("last", F.col("start")) + 1) / FINE)
    tries = _solved(m).join(last, "g").withColumn("far", far).groupBy("g").agg(F.collect_list(F.struct("start", "m", "c", "i", "det", "far")).alias("tries"))
    return tries.join(sizes, "g")


def _measured(rows: DataFrame, tries: DataFrame, groups: int) -> DataFrame:
    """Rows by their distance from each try of their group."""
    x = _meet(rows, tries.select("g", "n", "middle", "tries"), groups).select("g", "n", "middle", "v", F.explode("tries").alias("t"))
    return x.select("g", "n", "middle", "v", F.col("t.start").alias("start"), _quadratic(F.col("t.m"), F.col("t.i")).alias("d"))


def robust(x: DataFrame) -> DataFrame:
    """(g, up, n, middle, m, c, far): the MCD location and scatter of every group of rows with words; c is the half's own covariance with the floor."""
    rows = _vector(x)
    at = [F.percentile_approx(F.get("v", F.lit(i)), 0.5, 10_000) for i in range(P)]
    middle = stored(rows.groupBy("g").agg(F.min("up").alias("up"), F.count("*").alias("n"), F.array(*at).alias("middle")), "middles", narrow=True)
    groups = middle.count()
    rows = rows.drop("up")
    off = [F.percentile_approx(F.abs(F.get("v", F.lit(i)) - F.get("middle", F.lit(i))), 0.5, 10_000) for i in range(P)]
    spread = _meet(rows, middle, groups).groupBy("g").agg(F.array(*off).alias("spread"))
    sizes = stored(middle.join(spread, "g"), "sizes", narrow=True)
    z = [(F.get("v", F.lit(i)) - F.get("middle", F.lit(i))) / (F.get("spread", F.lit(i)) * 1.4826 + math.sqrt(FLOOR[i, i])) for i in range(P)]
    starts = (sum((a * a for a in z), F.lit(0.0)), F.greatest(*(F.abs(a) for a in z)), sum((F.pow(F.tanh(a), 2) for a in z), F.lit(0.0)))
    sizes_ = sizes.select("g", "up", "n", "middle")
    first = _meet(rows, sizes, groups).select("g", "n", "middle", "v", F.explode(F.array(*(F.struct(F.lit(k).alias("start"), d.alias("d")) for k, d in enumerate(starts)))).alias("t")).select("g", "n", "middle", "v", "t.*")
    tries = stored(_concentrated(first, sizes_, groups), "tries", narrow=True)
    for _ in range(2):
        tries = stored(_concentrated(_measured(rows, tries, groups), sizes_, groups), "tries", narrow=True)
    least = F.array_sort("tries", lambda a, b: F.when(a["det"] < b["det"], -1).when(a["det"] > b["det"], 1).otherwise(a["start"] - b["start"]))
    best = stored(tries.withColumn("tries", F.slice(least, 1, 1)), "best", narrow=True)
    for _ in range(STEPS):
        new = _concentrated(_measured(rows, best, groups), sizes_, groups)
        old = best.select("g", F.col("tries")[0]["det"].alias("_det"), F.col("tries").alias("_old"))
        both = new.join(old, "g").withColumn("fell", F.col("tries")[0]["det"] < F.col("_det") - FALL)
        best = stored(both.withColumn("tries", F.when(F.col("fell"), F.col("tries")).otherwise(F.col("_old"))).drop("_det", "_old"), "best", narrow=True)
        if best.where("fell").isEmpty():
            break
        release(x.sparkSession)
        best = best.drop("fell")
    return best.select("g", "up", "n", "middle", F.col("tries")[0]["m"].alias("m"), F.col("tries")[0]["c"].alias("c"), F.col("tries")[0]["far"].alias("far"))


def _mixed(own: DataFrame, above: DataFrame) -> DataFrame:
    """Estimates (g, up, n, m, c) mixed with those above them, as PRIOR rows of these would be."""
    up = above.select(F.col("g").alias("up"), F.col("m").alias("um"), F.col("c").alias("uc"))
    x, w = own.join(up, "up"), F.col("n") / (F.col("n") + PRIOR)
    get = lambda c, i: F.get(c, F.lit(i))
    apart = [get("m", i) - get("um", i) for i in range(P)]
    m = F.array(*(w * get("m", i) + (1 - w) * get("um", i) for i in range(P)))
    c = F.array(*(w * get("c", k) + (1 - w) * get("uc", k) + w * (1 - w) * apart[i] * apart[j] for k, (i, j) in enumerate(PAIRS)))
    return x.select("g", "up", "n", m.alias("m"), c.alias("c"))


def estimates(x: DataFrame) -> DataFrame:
    """(g, n, m, i): reweighted location and inverse scatter of every language and source, mixed with those above them."""
    raw = robust(x)
    # the half's covariance is widened until the median distance is that of a normal vector
    factor = F.greatest(F.lit(1.0), F.col("far") / chi_square(0.5, P))
    own = F.array(*((F.get("c", F.lit(k)) - f) * factor + f for k, f in enumerate(_FLAT)))
    raw = stored(_solved(raw.withColumn("c", own)), "raw-estimates", narrow=True)
    groups = raw.count()
    near = _meet(_vector(x).drop("up"), raw, groups).where(_quadratic(F.col("m"), F.col("i")) <= chi_square(0.975, P))
    again = _moments(near.select("g", "v", "middle"), "g").select("g", "m", _floored(F.col("c"), 1.1).alias("c"))
    e = stored(raw.select("g", "up", "n").join(again, "g"), "reweighted", narrow=True)
    level = lambda k: e.where(F.col("g").startswith(str(k)))
    return _solved(_mixed(level(2), _mixed(level(1), level(0))).drop("up"))


def judged(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, base counts, vector, base_failed, distance, kept): one row per document of (doc_id, lang, source, text)."""
    one_of(docs, "doc_id", "lang", "source", "text")
    x = stored(measured(docs), "quality")
    with short_plans(docs.sparkSession):
        e = stored(estimates(x), "estimates", narrow=True)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    y = _meet(x.where("n_words > 0").withColumn("g", _keys()[0]).withColumn("v", F.array(*NAMES)), e, e.count())
    y = y.select(*x.columns, _quadratic(F.col("m"), F.col("i")).alias("distance")).unionByName(x.where("n_words = 0").withColumn("distance", F.lit(None).cast("double")))
    return y.select(*x.columns, failed.alias("base_failed"), "distance", (~failed & F.coalesce(F.col("distance") <= chi_square(1 - alpha, P), F.lit(True))).alias("kept"))


def kept(docs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The documents that the rules keep, with all their columns; equal (doc_id, lang, source, text) are judged alike."""
    one_of(docs, "doc_id", "lang", "source", "text")
    row = F.xxhash64(*(docs[c] for c in ("doc_id", "lang", "source", "text")))
    (name,) = fresh(docs, "_bad")
    keyed = docs.select(row.alias("doc_id"), "lang", "source", "text")
    bad = stored(judged(keyed, alpha).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct(), "rejected", narrow=True)
    return docs.join(broadcast_if(bad, bad.count(), 1_000_000), row == bad[name], "left_anti")
