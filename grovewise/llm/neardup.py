"""Near-duplicates by min-max hashing: exact components of the graph of similar texts.

A text is its set of distinct word shingles. Equal sets are one class at once. Each class has a signature that keeps both the least and
the largest value under every hash function, so half as many functions fill it; bands of it propose pairs.

In each bucket of a band all members are compared with the least one only, on full sets; classes are numbered in order of their least ids, so that an original is mostly less than its copies.
In buckets that are not connected then, members are held against a centre of the largest component: what their sets do not share with it is small, and two sets that are similar
agree on rare parts of it, which an equi-join finds without loss. No bucket is expanded into all pairs.

Classes of equal sets are the vertices, under numbers of their own, so ids may be of any type that has an order. A class is sketched once, and compared by the text
of its least row. Frequent sets and keys are broadcast to the rows that have them, so that no task holds all rows of one.

Cases: texts that are NULL or have no word have the empty set and stand alone; texts shorter than a shingle are one shingle of all
their words; rows that repeat an id are one document, which links the classes of all its texts; a NULL id stands alone with a NULL component and is kept;
very long texts are sketched in parts and compared whole; ties between ids cannot arise, the least of a component stays; an empty table gives an empty result;
other columns are ignored or pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovewise.llm.common import broadcast_if, fresh, join_on_hot, mapped, one_of, stored

#: Bands, and signature values in each: a pair of similarity 0.8 is missed with chance (1 - 0.8 ** ROWS) ** BANDS, under 1e-5.
BANDS, ROWS = 40, 6
FUNCTIONS = BANDS * ROWS // 2
BROADCAST_IDS = 500_000
#: A set or a key with so many rows is broadcast to them.
HOT = 1000
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, FUNCTIONS, np.uint64)
_K = _RNG.integers(0, 1 << 63, (64,), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    """Word hashes, forgotten when there are many."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, size: int, hashes: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text, lower-cased in ASCII."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    k = min(size, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = _mix(out + h[i : len(w) - k + 1 + i] * _K[i])
    return np.unique(out + np.uint64(k < size))


def signature(s: np.ndarray) -> np.ndarray:
    """The least and the largest value of a non-empty set under each function."""
    lo = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    hi = np.zeros(FUNCTIONS, np.uint64)
    for i in range(0, len(s), 256):
        v = s[i : i + 256, None] * _A + _B
        v ^= v >> np.uint64(32)
        np.minimum(lo, v.min(0), out=lo)
        np.maximum(hi, v.max(0), out=hi)
    return np.concatenate([lo, hi])


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A key for each band, of least values of some functions and greatest values of others, so that its values are independent."""
    low, high = signature.reshape(2, ROWS // 2, BANDS)
    sig = np.concatenate([low, np.roll(high, 1, axis=1)])
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = _mix(key + sig[j] * _MIX[:, j])
    return key


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, t, n_shingles, hi, lo, bands): t is a hash of the text, hi and lo identify the set, bands hold the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            n, hi, lo, keys = [], [], [], []
            for t in b.column("text"):
                s = shingle_set(t.as_py(), size, hashes)
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                hi.append((d >> 64) - (1 << 63))
                lo.append((d & ((1 << 64) - 1)) - (1 << 63))
                keys.append(band_keys(signature(s)).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "t", "n_shingles", "hi", "lo", "bands"])

    return mapped(docs.select("doc_id", "text", F.xxhash64("text").alias("t")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, n_shingles long, hi long, lo long, bands array<long>")


def similarities(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(x, y, common, total): exact sizes of intersection and union, from the whole texts (v, text) of both."""
    x = texts.select(F.col("v").alias("x"), F.col("text").alias("_tx"))
    y = texts.select(F.col("v").alias("y"), F.col("text").alias("_ty"))
    both = pairs.join(y, "y").join(x, "x").select("x", "y", "_tx", "_ty")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, s = _Hashes(), None, None
        for b in batches:
            xs, ys = b.column("x").to_pylist(), b.column("y").to_pylist()
            common, total = [], []
            for a, ta, tb in zip(xs, b.column("_tx"), b.column("_ty")):
                if s is None or a != last:
                    last, s = a, shingle_set(ta.as_py(), size, hashes)
                t = shingle_set(tb.as_py(), size, hashes)
                k = len(np.intersect1d(s, t, assume_unique=True))
                common.append(k)
                total.append(len(s) + len(t) - k)
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array(common, pa.int64()), pa.array(total, pa.int64())], names=["x", "y", "common", "total"])

    return mapped(both, run, "x long, y long, common long, total long")


def differences(members: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(v, c, p, m, n, n_m, diff): the hashes that only one of the sets of v and of its centre m has, and the sizes of both sets.

    `members` has v, c, p and m."""
    x = texts.select("v", F.col("text").alias("_tv"))
    y = texts.select(F.col("v").alias("m"), F.col("text").alias("_tm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, s = _Hashes(), None, np.zeros(0, np.uint64)
        for b in batches:
            n, n_m, diff = [], [], []
            for m, tv, tm in zip(b.column("m").to_pylist(), b.column("_tv"), b.column("_tm")):
                if m != last:
                    last, s = m, shingle_set(tm.as_py(), size, hashes)
                t = shingle_set(tv.as_py(), size, hashes)
                n.append(len(t))
                n_m.append(len(s))
                diff.append(np.setxor1d(s, t, assume_unique=True).view(np.int64))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("v", "c", "p", "m")] + [pa.array(z, k) for z, k in zip((n, n_m, diff), kinds)], names=["v", "c", "p", "m", "n", "n_m", "diff"])

    both = members.join(x, "v").join(y, "m").select("v", "c", "p", "m", "_tv", "_tm")
    return mapped(both, run, "v long, c long, p long, m long, n long, n_m long, diff array<long>")


def centred(placed: DataFrame) -> DataFrame:
    """(v, c, p, m): for each member of an open bucket, the bucket's largest component p and the centre m of p.

    The centre is the member that shares most keys of open buckets with members of its component."""
    sizes = stored(placed.groupBy("key", "c").agg(F.count("*").alias("_n")), "sizes", narrow=True)
    largest = stored(sizes.groupBy("key").agg(F.max_by("c", F.struct("_n", "c")).alias("p"), F.sum("_n").alias("_rows")), "largest", narrow=True)
    both = F.struct("key", "c")
    score = join_on_hot(placed.withColumn("at", both), sizes.select(both.alias("at"), "_n"), "at", "_n", HOT).groupBy("c", "v").agg(F.sum("_n").alias("_s"))
    centre = score.groupBy(F.col("c").alias("p")).agg(F.max_by("v", F.struct("_s", "v")).alias("m"))
    return join_on_hot(placed, largest, "key", "_rows", HOT).select("v", "c", "p").distinct().join(centre, "p").where("v <> m").select("v", "c", "p", "m")


def rare_agreements(diffs: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of different components that may reach the similarity; none that reaches it is left out.

    Sets are as far apart as their differences from a common centre m are: |x ^ y| = |dx ^ dy|. Similar sets differ in at most k * (|x| + |y|),
    so dx and dy have t = (|dx| + |dy| - k * (|x| + |y|)) / 2 hashes in common or more, and the first of these, rarest first, stands among the
    first |dx| - t + 1 and |dy| - t + 1. A member that is not similar to m has |dx| > k * (|x| + |m|), so t is over 0. Pairs without such a
    member are connected by m. Hashes of one member only take places, but are not joined."""
    k = (100 - percent) / (100 + percent)
    d = diffs.withColumn("a", F.size("diff").cast("long")).withColumn("out", (F.col("c") != F.col("p")) & (F.col("a") > k * (F.col("n") + F.col("n_m")) + 1e-9))
    each = d.select("m", "v", F.explode("diff").alias("e"))
    several = each.groupBy("m", "e").agg(F.count("*").alias("f")).where("f > 1")
    # so many of the first places can matter, whatever the other member is
    places = F.when(F.col("out"), k * F.col("n") * (1 + 100 / percent)).otherwise(F.col("a") / 2 + k * (F.col("n") - F.col("n_m")) / 2) + 1 + 1e-6
    both = F.struct("m", "e")
    ranked = join_on_hot(each.withColumn("at", both), several.select(both.alias("at"), "f"), "at", "f", HOT).groupBy("m", "v").agg(F.sort_array(F.collect_list(F.struct("f", "e"))).alias("r"))
    first = d.drop("diff").join(ranked, ["m", "v"]).withColumn("alone", F.col("a") - F.size("r")).withColumn("places", places)
    first = first.select("m", "v", "n", "a", "out", F.when(F.col("a") > k * (F.col("n") + F.col("n_m")) + 1e-9, F.col("c")).otherwise(F.col("p")).alias("c"), "alone", F.posexplode(F.slice("r", 1, F.greatest(F.floor(F.col("places") - F.col("alone")), F.lit(0)).cast("int"))).alias("i", "r"))
    first = stored(first.select("m", F.col("r.e").alias("e"), "v", "n", "a", "out", "c", (F.col("alone") + F.col("i") + 1).alias("at")), "places", narrow=True)
    # holders of a hash are dealt to parts of HOT rows or so, and those that look for others meet each part
    held = first.groupBy("m", "e").agg(F.count("*").alias("f"), F.bool_or("out").alias("any")).where("any AND f > 1").select(both.alias("key"), "f")
    first = join_on_hot(first.withColumn("key", both), stored(held, "held", narrow=True), "key", "f", HOT).withColumn("parts", F.ceil(F.col("f") / HOT).cast("int"))
    every, own = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")
    left, right = (rows.select("m", "e", part.alias("part"), *(F.col(z).alias(z + side) for z in ("v", "n", "a", "c", "at"))) for rows, part, side in ((first.where("out"), every, "x"), (first, own, "y")))
    t = (F.col("ax") + F.col("ay") - k * (F.col("nx") + F.col("ny"))) / 2 - 1e-6
    near = (F.col("cx") != F.col("cy")) & (F.col("ax") - F.col("atx") + 1 >= t) & (F.col("ay") - F.col("aty") + 1 >= t)
    return left.join(right, ["m", "e", "part"]).where(near).select(F.least("vx", "vy").alias("x"), F.greatest("vx", "vy").alias("y")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, c): the least vertex reachable from each vertex of links (x, y), by least neighbours and pointer jumps."""
    both = stored(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links", narrow=True)
    label = stored(both.groupBy(F.col("x").alias("v")).agg(F.least(F.min("y"), F.col("x")).alias("c")), "labels", narrow=True)
    while True:
        near = both.join(label.select(F.col("v").alias("y"), "c"), "y").groupBy(F.col("x").alias("v")).agg(F.min("c").alias("n"))
        step = label.join(near, "v", "left").select("v", "c", F.least("c", "n").alias("n"))
        jump = label.select(F.col("v").alias("n"), F.col("c").alias("j"))
        new = stored(step.join(jump, "n", "left").select("v", F.least("n", F.coalesce("j", "n")).alias("c"), (F.least("n", F.coalesce("j", "n")) < F.col("c")).alias("moved")), "labels", narrow=True)
        if new.where("moved").isEmpty():
            return new.select("v", "c")
        label = new.select("v", "c")


def _open(members: DataFrame, c: DataFrame) -> DataFrame:
    """(key, v, c): members of buckets that hold more than one component."""
    placed = stored(members.join(c, "v", "left").select("key", "v", F.coalesce("c", "v").alias("c")), "placed", narrow=True)
    several = stored(placed.groupBy("key").agg(F.min("c").alias("_a"), F.max("c").alias("_b"), F.count("*").alias("_n")).where("_a <> _b").select("key", "_n"), "several", narrow=True)
    return join_on_hot(placed, several, "key", "_n", HOT).drop("_n")


def _class_links(sig: DataFrame, classes: DataFrame, size: int, percent: int, docs: DataFrame) -> DataFrame:
    """(x, y): links between similar classes, enough of them to connect all that are connected."""
    first = sig.join(classes, (sig.hi == classes.hi) & (sig.lo == classes.lo) & (sig.doc_id == classes["first.doc_id"]) & (sig.t == classes["first.t"])).select("v", "bands")
    keys = first.dropDuplicates(["v"]).select("v", F.explode("bands").alias("key"))
    shared = stored(keys.groupBy("key").agg(F.min("v").alias("x"), F.count("*").alias("_n")).where("_n > 1"), "shared", narrow=True)
    buckets = stored(join_on_hot(keys, shared, "key", "_n", HOT).select("key", "x", "v"), "buckets")
    pairs = stored(buckets.where("x < v").select("x", F.col("v").alias("y")).distinct(), "pairs", narrow=True)
    ids = stored(pairs.select(F.explode(F.array("x", "y")).alias("v")).distinct().join(classes, "v").select("v", F.col("first.doc_id").alias("doc_id"), F.col("first.t").alias("t")), "ids", narrow=True)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t")).join(broadcast_if(ids, ids.count(), BROADCAST_IDS), ["doc_id", "t"]).select("v", "text")
    texts = stored(texts.groupBy("v").agg(F.min("text").alias("text")) if _repeats(sig) else texts, "texts")
    tested = stored(similarities(pairs, texts, size), "tested")
    similar = f"100 * common >= {percent} * total"
    links = tested.where(similar).select("x", "y")

    # buckets that one comparison per member leaves in several components: members' differences from a centre of the bucket's largest
    # component, and pairs that agree on enough of them
    placed = _open(buckets.select("key", "v"), components(links))
    diffs = stored(differences(centred(placed), texts, size), "differences")
    central = diffs.where(f"{100 + percent} * size(diff) <= {100 - percent} * (n + n_m)").select(F.least("v", "m").alias("x"), F.greatest("v", "m").alias("y"))
    more = stored(rare_agreements(diffs, percent).join(tested.select("x", "y"), ["x", "y"], "left_anti"), "pairs", narrow=True)
    return links.unionByName(central).unionByName(similarities(more, texts, size).where(similar).select("x", "y"))


def _repeats(sig: DataFrame) -> bool:
    return not sig.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: 100 * common >= percent * union links two documents."""
    one_of(docs, "doc_id", "text")
    sig = stored(signatures(docs, size), "signatures")
    some = sig.where("doc_id IS NOT NULL AND n_shingles > 0")
    least = F.min(F.struct("doc_id", "t")).alias("first")
    classes = stored(some.groupBy("hi", "lo").agg(least, F.count("*").alias("_n")).orderBy("first").withColumn("v", F.monotonically_increasing_id()), "classes", narrow=True)
    links = _class_links(some, classes, size, percent, docs)

    both = F.struct("hi", "lo")
    alone = sig.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    own = join_on_hot(some.select("doc_id", "n_shingles", both.alias("set")), classes.select(both.alias("set"), "v", "_n"), "set", "_n", HOT).select("doc_id", "n_shingles", "v")
    if _repeats(sig):  # a document's texts belong together
        own = stored(own, "own", narrow=True)
        texts = own.groupBy("doc_id").agg(F.min("v").alias("x"), F.collect_set("v").alias("vs")).where("size(vs) > 1")
        links = links.unionByName(texts.select("x", F.explode("vs").alias("y")).where("x <> y"))
        empty = alone.where("doc_id IS NOT NULL").join(own.select(F.col("doc_id").alias("_d"), "v").groupBy("_d").agg(F.min("v").alias("v")), F.col("doc_id") == F.col("_d"), "left")
        own = own.unionByName(empty.where("v IS NOT NULL").select("doc_id", "n_shingles", "v"))
        alone = empty.where("v IS NULL").select(*alone.columns).unionByName(alone.where("doc_id IS NULL"))
    c = components(links)
    names = classes.select("v", "_n", F.col("first.doc_id").alias("rep"))
    named = c.join(names.select("v", "rep"), "v").groupBy("c").agg(F.min("rep").alias("component"))
    label = names.join(c.join(named, "c").select("v", "component"), "v", "left").select("v", "_n", F.coalesce("component", "rep").alias("component"))
    out = join_on_hot(own, stored(label, "label", narrow=True), "v", "_n", HOT).select("doc_id", "n_shingles", "component").unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, with all columns: the one whose id is least. Of rows that repeat an id, one stays."""
    verdict = stored(near_duplicates(docs, size, percent), "verdict", narrow=True)
    (name,) = fresh(docs, "_gone")
    gone = verdict.where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    out = docs.join(broadcast_if(gone, gone.count(), 2 * BROADCAST_IDS), docs["doc_id"] == gone[name], "left_anti")
    again = verdict.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return out
    return out.join(again, "doc_id", "left_anti").unionByName(out.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
