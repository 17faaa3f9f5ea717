"""Short benchmark items inside long documents, by MinHash containment search over size partitions.

A text is its set of distinct five-word shingles (all words as one, if fewer), as 64-bit hashes. Documents
are partitioned by the size of their set, in powers of two. A partition has a sketch of its own width:
hash space is cut into bins in proportion to the partition's size, and a set's minimum in each bin is a
one-row band. So however long a document is, an item inside it meets a fixed share of its own
minima, while the sketch holds one hash per bin. Items are sketched once for each partition. Sketches
that share a minimum are candidates, and are verified by the exact count of common shingles.

Every item has bins for its own size, and coarser bins' minima are among finer bins' minima, so a document has one
sketch, as fine as the shortest item needs. An item all of whose shingles are needed (up to four of them) has its least
shingle as its key and meets all shingles of the documents; none of these is missed.

Cases: NULL and empty texts have no shingles and match nothing; items under five words match only documents
that are the same words; a very long text is one row and a sketch in proportion to it; ties between equal hashes cannot
arise, as sets are distinct; repeated rows match alike; without items or documents nothing matches; a document's key is (doc_id, its text), so
ids may repeat or be NULL and are of any type; other columns are ignored or pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.llm.common import broadcast_if, fresh, one_of, stored, words

SHINGLE, CONTAINMENT = 5, 0.8
#: The chance that a contained item shares no minimum with its document stays under this; bins of 2^COARSEST shingles suffice for long items.
MISS, COARSEST = 1e-7, 2
#: Bounds for broadcasts: sketch or shingle rows of all items (28 bytes each), candidates (24 bytes each).
BROADCAST_ROWS = 1_000_000
PARTITIONS = 36


def shingles(text: Column) -> Column:
    """Sorted distinct shingle hashes; NULL where there is no word."""
    w = words(F.lower(text))

    def of(x: Column) -> Column:
        long = F.transform(F.sequence(F.lit(0), F.size(x) - SHINGLE), lambda i: F.xxhash64(*(F.get(x, i + k) for k in range(SHINGLE))))
        short = F.array(F.xxhash64(F.lit("short"), F.array_join(x, " ")))
        return F.when(F.size(x) >= SHINGLE, long).when(F.size(x) > 0, short)

    return F.sort_array(F.array_distinct(F.element_at(F.transform(F.array(w), of), 1)))


def partition_of(n: Column) -> Column:
    """The size partition: the least s with n <= 2^s."""
    return F.least(F.ceil(F.log2(n.cast("double"))).cast("int"), F.lit(PARTITIONS - 1))


def bin_bits(common: int) -> int:
    """Powers of two by which bins are fewer (positive) or more than shingles, so that `common` shared shingles are missed
    with a chance of at most MISS: in bins of mean load x one of them is the minimum with chance (1 - e^-x) / x."""
    e = COARSEST
    while (1 - (1 - math.exp(-(2.0**e))) / 2.0**e) ** common > MISS:
        e -= 1
    return e


def needed(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def _bins(n: Column, percent: int) -> Column:
    """`bin_bits` for an item of n shingles; NULL where it needs all of them."""
    size, first = 1, {}
    while COARSEST not in first:
        first.setdefault(bin_bits(needed(size, percent)), size)
        size += 1
    bits = F.lit(None).cast("int")
    for e, least in sorted(first.items()):  # larger items have coarser bins
        bits = F.when(n >= least, F.lit(e)).otherwise(bits)
    return F.when(F.floor((n * percent + 99) / 100) < n, bits)


def _bin(h: Column, bits: Column) -> Column:
    return F.when(bits > 0, F.call_function("shiftrightunsigned", h, F.lit(64) - bits)).otherwise(0)


def _bits(s: Column, e: Column) -> Column:
    return F.least(F.greatest(s - e, F.lit(0)), F.lit(48))


def _minima(df: DataFrame, *keep: str) -> DataFrame:
    """(keep..., _s, _h): each bin's least hash, from `_set` (sorted), `_bits`: where the bin changes along the order."""
    x = df.select(*keep, "_s", "_set", "_bits", F.explode_outer(F.sequence(F.lit(0), F.size("_set") - 1)).alias("_i"))
    x = x.withColumn("_h", F.get("_set", F.col("_i"))).withColumn("_before", F.get("_set", F.col("_i") - 1))
    return x.where((F.col("_i") == 0) | (_bin(F.col("_h"), F.col("_bits")) != _bin(F.col("_before"), F.col("_bits")))).select(*keep, "_s", "_h")


def contained(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, _text, item_id, n_common, n_item): documents that hold at least `containment` of an item's shingles.

    `docs` has doc_id, text; `items` has item_id, text. _text is the hash of the document's text."""
    one_of(docs, "doc_id", "text")
    one_of(items, "item_id", "text")
    percent = round(containment * 100)
    i = items.select("item_id", shingles(F.col("text")).alias("_set")).where("_set IS NOT NULL").distinct().withColumn("n_item", F.size("_set"))
    i = stored(i.withColumn("_e", _bins(F.col("n_item"), percent)).withColumn("_item", F.monotonically_increasing_id()), "items", narrow=True)
    about = i.agg(F.count("*").alias("n"), F.min("_e").alias("finest"), F.bool_or(F.col("_e").isNull()).alias("every"), F.sum("n_item").alias("shingles")).first()
    if not about.n:
        return docs.select("doc_id", F.xxhash64("text").alias("_text"), F.lit(None).cast(i.schema["item_id"].dataType).alias("item_id"), F.lit(0).cast("long").alias("n_common"), F.lit(0).alias("n_item")).where("false")
    per = i.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(PARTITIONS - 1)))).where(F.pow(F.lit(2.0), F.col("_s")) * 100 >= F.col("n_item") * percent)
    sketch = stored(_minima(per.withColumn("_bits", F.coalesce(_bits(F.col("_s"), F.col("_e")), F.lit(0))), "_item"), "sketch", narrow=True)

    # filters on the set, or an explode that implies them, would compute it once more
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_text"), "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    d = keyed.select("doc_id", "_text", shingles(F.col("text")).alias("_set"))
    d = d.withColumn("_s", partition_of(F.size("_set")))
    d = d.withColumn("_bits", F.lit(64) if about.every else _bits(F.col("_s"), F.lit(about.finest)))
    met = _minima(d, "doc_id", "_text").join(broadcast_if(sketch, sketch.count(), BROADCAST_ROWS), ["_s", "_h"])
    candidates = stored(met.select("doc_id", "_text", "_item").distinct(), "candidates", narrow=True)

    # a document's shingles meet those of its own candidates only
    ids = stored(candidates.select("doc_id", "_text").distinct(), "ids", narrow=True)
    same = keyed["doc_id"].eqNullSafe(ids["doc_id"]) & (keyed["_text"] == ids["_text"])
    again = keyed.join(broadcast_if(ids, ids.count(), BROADCAST_ROWS), same, "left_semi").dropDuplicates(["doc_id", "_text"])
    rows = again.select("doc_id", "_text", F.explode_outer(shingles(F.col("text"))).alias("_h"))
    each = broadcast_if(i.select("_item", F.explode("_set").alias("_h")), int(about.shingles), BROADCAST_ROWS)
    wanted = candidates.join(each, "_item").select(F.col("doc_id").alias("_d"), F.col("_text").alias("_t"), "_item", F.col("_h").alias("_w"))
    hits = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_t")) & (F.col("_h") == F.col("_w")))
    n = hits.groupBy("doc_id", "_text", "_item").agg(F.count("*").alias("n_common"))
    found = n.join(broadcast_if(i.select("_item", "item_id", "n_item"), about.n, BROADCAST_ROWS), "_item").where(F.col("n_common") * 100 >= F.col("n_item") * percent)
    return found.select("doc_id", "_text", "item_id", "n_common", "n_item")


def decontaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    doc, text = fresh(docs, "_doc", "_hash")
    bad = stored(contained(docs, items, containment).select(F.col("doc_id").alias(doc), F.col("_text").alias(text)).distinct(), "contaminated", narrow=True)
    return docs.join(broadcast_if(bad, bad.count(), BROADCAST_ROWS), docs["doc_id"].eqNullSafe(bad[doc]) & (F.xxhash64(docs["text"]) == bad[text]), "left_anti")
