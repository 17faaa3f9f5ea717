"""Ranked lexical search: document-sharded postings with whole-number impacts, dense accumulators, merged top lists.

An index is a table of shards. A shard holds about SHARD_TOKENS tokens of whole documents as compressed sparse rows: its terms in one
block of bytes, where each term's postings start, the documents' places, and each posting's impact: the part of the score that depends on the term's
occurrences and the document's length alone. Documents are in order of their ids in a shard, so an equal score is settled by place.

Queries are answered in blocks of a bounded number of terms, each of which meets all shards. A first pass over the terms and starts alone counts each query
term's documents; a second one adds weight times impact, term by term, into an accumulator with a number for each document of the shard. The best are cut
by argpartition at the k-th score; all above it are taken, and of those equal to it the first in order. A task merges the top lists of its shards, and
Spark those of tasks, in two steps.

Scores are exact: weights are the floor of a logarithm in doubles, all else is 64-bit, or larger where it must be.

Cases: NULL and empty texts, and those without a term, have no postings and are not counted; rows that repeat an id are documents of their own; a NULL id comes after others of
equal score; a very long text is a document of one shard, however long; ties are in order of ids; items that repeat an id are one item with the terms of all their texts; an item
without terms, or whose terms no document has, has no rows; an empty table on either side gives an empty result; a term of all documents has weight 0; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from grovewise.llm.common import discard, mapped, one_of, stored

#: Terms are runs of ASCII letters and digits and of whatever is not ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEEP = bytes(b if b >= 0x80 or re.match(rb"[0-9a-z]", bytes([b])) else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_IS_TERM = np.array([b != 0x20 for b in _KEEP])
#: Tokens of a shard, but for a single longer document, and query terms of one block, over all items.
SHARD_TOKENS, BLOCK_TERMS = 1 << 21, 200_000
#: Groups of tasks whose top lists are merged before those of all.
MERGE = 64


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, lower-cased in ASCII. Separators become spaces, and bytes split at those only, as no other white space is left."""
    return text.encode("utf-8", "surrogatepass").translate(_KEEP).split() if text else []


def count_terms(text: str | None) -> int:
    if not text:
        return 0
    on = _IS_TERM[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    return int(on[0]) + int((on[1:] & ~on[:-1]).sum())


@dataclass(frozen=True)
class Index:
    """shards: a stored table; documents, tokens: N and L."""

    shards: DataFrame
    documents: int
    tokens: int


def lengths(n: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """m of documents with n tokens each, as whole numbers of any size."""
    if 50 * int(n.max(initial=0)) * documents < 1 << 63:
        return 50 + (50 * n * documents) // tokens
    return np.array([50 + (50 * int(x) * documents) // tokens for x in n], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class _Numbers(dict):
    """Terms by number in order of first use."""

    def __missing__(self, w: bytes) -> int:
        n = self[w] = len(self)
        return n


def build(docs: DataFrame) -> Index:
    """The index of (doc_id, text). Two passes over the texts: one counts, one writes postings."""
    one_of(docs, "doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for t in b.column("text"):
                k = count_terms(t.as_py())
                n, total = n + (k > 0), total + k
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    about = mapped(docs.select("text"), count, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    documents, tokens = about.n, about.total
    kind = docs.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def shard(ids: list, found: list[np.ndarray], numbers: _Numbers) -> pa.RecordBatch:
        ids = pa.array(ids, arrow)
        order = pc.sort_indices(ids).to_numpy()  # NULLs last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        n = np.array([len(x) for x in found], np.int64)
        keys, tf = np.unique(np.concatenate(found).astype(np.int64) * len(n) + np.repeat(place, n), return_counts=True)
        term, doc = np.divmod(keys, len(n))
        starts = np.append(np.flatnonzero(np.append(True, term[1:] != term[:-1])), len(term))
        m = lengths(n[order], documents, tokens)
        blob = [b"\n".join(numbers), starts.astype("<i8").tobytes(), doc.astype("<i4").tobytes(), impacts(tf, m[doc]).astype("<i4").tobytes()]
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.binary()) for x in blob), pa.array([ids.take(pa.array(order)).to_pylist()], pa.list_(arrow))], names=["terms", "starts", "docs", "impacts", "ids"])

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, numbers, size = [], [], _Numbers(), 0
        for b in batches:
            for d, t in zip(b.column("doc_id"), b.column("text")):
                w = terms(t.as_py())
                if not w:
                    continue
                if size and size + len(w) > SHARD_TOKENS:
                    yield shard(ids, found, numbers)
                    ids, found, numbers, size = [], [], _Numbers(), 0
                ids.append(d.as_py())
                found.append(np.fromiter(map(numbers.__getitem__, w), np.int32, len(w)))
                size += len(w)
        if size:
            yield shard(ids, found, numbers)

    schema = f"terms binary, starts binary, docs binary, impacts binary, ids array<{kind.simpleString()}>"
    return Index(stored(mapped(docs.select("doc_id", "text"), postings, schema), "shards"), documents, tokens)


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, the first of equal ones; in order of places."""
    on = np.flatnonzero(scores > 0)
    if len(on) <= k:
        return on
    s = scores[on]
    least = s[np.argpartition(s, len(s) - k)[len(s) - k]]
    above = on[s > least]
    return np.sort(np.append(above, on[s == least][: k - len(above)]))


def _order(s: int, d: object) -> tuple:
    return -s, d is None, d


def _frequencies(shards: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """In how many documents each query term is, for those in any."""
    shared = shards.sparkSession.sparkContext.broadcast(wanted)  # a block's terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}
        for b in batches:
            for t, s in zip(b.column("terms"), b.column("starts")):
                df = np.diff(np.frombuffer(s.as_py(), "<i8"))
                for i, w in enumerate(t.as_py().split(b"\n")):
                    if w in shared.value:
                        found[w] = found.get(w, 0) + int(df[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["term", "df"])

    rows = mapped(shards.select("terms", "starts"), run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()  # a block's terms
    return {bytes(r.term): r.df for r in rows}


def _best(index: Index, queries: dict[int, list[tuple[bytes, int]]], k: int) -> DataFrame:
    """(item, part, doc_id, score): each task's k best documents for each query of (term, weight) pairs."""
    shards = index.shards
    kind = shards.schema["ids"].dataType.elementType
    shared, arrow = shards.sparkSession.sparkContext.broadcast(queries), to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, object]]] = {}
        wanted = {w for q in shared.value.values() for w, _ in q}
        for b in batches:
            for t, s, d, x, ids in zip(*(b.column(c) for c in ("terms", "starts", "docs", "impacts", "ids"))):
                at = {w: i for i, w in enumerate(t.as_py().split(b"\n")) if w in wanted}
                starts, docs, impact = np.frombuffer(s.as_py(), "<i8"), np.frombuffer(d.as_py(), "<i4"), np.frombuffer(x.as_py(), "<i4")
                ids = ids.values
                scores = np.zeros(len(ids), np.int64)
                for item, query in shared.value.items():
                    scores[:] = 0
                    for w, weight in query:
                        if (i := at.get(w)) is not None:
                            scores[docs[starts[i] : starts[i + 1]]] += weight * impact[starts[i] : starts[i + 1]].astype(np.int64)
                    places = top(scores, k)
                    if len(places):
                        mine = best.setdefault(item, [])
                        mine += zip(scores[places].tolist(), ids.take(pa.array(places)).to_pylist())
                        if len(mine) > 8 * k:
                            best[item] = sorted(mine, key=lambda y: _order(*y))[:k]
        part = TaskContext.get().partitionId()
        for item, mine in best.items():
            mine = sorted(mine, key=lambda y: _order(*y))[:k]
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(mine), pa.int64()), pa.array([part] * len(mine), pa.int32()), pa.array([d for _, d in mine], arrow), pa.array([s for s, _ in mine], pa.int64())], names=["item", "part", "doc_id", "score"])

    return mapped(shards, run, f"item long, part int, doc_id {kind.simpleString()}, score long")


def search(index: Index, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    one_of(items, "item_id", "text")
    spark = items.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([terms(t.as_py()) for t in b.column("text")], pa.list_(pa.binary()))], names=["item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    each = mapped(items.select("item_id", "text"), run, f"item_id {kind}, terms array<binary>").select("item_id", F.explode("terms").alias("term")).distinct()
    listed = each.groupBy("item_id").agg(F.collect_list("term").alias("terms"), F.count("*").alias("n"))
    listed = stored(listed.withColumn("item", F.monotonically_increasing_id()), "items", narrow=True)
    total = listed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_TERMS)
    out = []
    for i in range(blocks):  # each block meets all shards
        mine = listed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        queries = {r.item: [bytes(w) for w in r.terms] for r in mine.select("item", "terms").collect()}
        df = _frequencies(index.shards, {w for q in queries.values() for w in q})
        weights = {w: weight(index.documents, n) for w, n in df.items()}
        weighed = {item: kept for item, q in queries.items() if (kept := [(w, weights[w]) for w in q if weights.get(w, 0) > 0])}
        if weighed:
            out.append(stored(_best(index, weighed, k), "best", narrow=True))
    if not out:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(None).cast(index.shards.schema["ids"].dataType.elementType).alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    found = out[0]
    for x in out[1:]:
        found = found.unionByName(x)
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("r", F.row_number().over(W.partitionBy("item", F.col("part") % MERGE).orderBy(*best))).where(F.col("r") <= k)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)
    return ranked.join(listed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """Builds the index, searches it for all items, and gives the folder back."""
    index = build(docs)
    out = stored(search(index, items, k), "ranked", narrow=True)
    discard(index.shards)
    return out
