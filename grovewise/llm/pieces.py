"""SentencePiece encoding and decoding over a relational lattice.

A text is cut into units that no piece crosses: words with the space marks before them and what follows a line feed, and these between
any two characters that no piece has side by side, as neither a merge nor a path gets across there. Texts are dealt to blocks of bounded
size. Distinct units of all blocks are encoded once: their substrings up to the longest piece are exploded and equi-joined to the piece
table, the edges found are grouped by unit, and a fold over them with Spark's higher-order aggregate picks the segmentation. Then the
texts of a block meet the ids of the block's own units, so no task and no worker holds more than a block's share of them.

The fold depends on the model. For a unigram model it is Viterbi: the best-scoring path to each position. For a BPE model the scores
are merge priorities, whose best path is not what the model encodes; there the fold applies the best available merge, the leftmost of
equals, until none is left. A position's boundary is a bit of a number, so an edge can be merged exactly when its ends are boundaries and
one boundary is inside. Units over 61 characters, whose boundaries don't fit a number, are merged in the worker over the same edges.

Characters without a piece become their UTF-8 bytes.

Cases: NULL and empty texts have no pieces; runs of spaces are units with the word that follows; repeated rows and ids, also NULL ones, are
encoded alike; a very long text is a block of its own; an empty table gives an empty result; the space mark itself, in a text, is a space
to the model, so such texts do not come back unchanged; all other columns pass through, whatever their names, but one named like a
new one is an error. Ties between merges go to the left, ties between paths to the edge that comes first by place.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from grovewise.llm.common import broadcast_if, mapped, one_of, ship, steady, trim

MARK = "▁"
#: Bytes of text to a block; words cut at once; ids decoded at once; shuffle partitions of the distinct units for each partition of the input.
BLOCK, GROUP, DECODED, SPREAD = 16 << 20, 50_000, 500_000, 6
#: Most rows that are sent as one.
PACK = 1000
#: Characters of a unit whose boundaries are bits of a number.
LONGEST = 61
#: By how much a character without a piece scores less than the least piece.
UNKNOWN = 10.0
_RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message: numbers, or bytes."""

    def varint(i: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            x |= (raw[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if raw[i - 1] < 128:
                return x, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = raw[i : i + n], i + n
        yield key >> 3, value


def model_type(path: str) -> str:
    """'unigram' or 'bpe', as the file's trainer_spec (field 2) says in model_type (field 3; unigram if not set)."""
    with open(path, "rb") as f:
        specs = [v for k, v in _fields(f.read()) if k == 2]
    kind = next((v for s in specs for k, v in _fields(s) if k == 3), 1)
    if kind not in (1, 2):
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    return ("unigram", "bpe")[kind - 1]


@dataclass(frozen=True)
class Model:
    """pieces: (piece, id, score) of those that texts can have; spelled: by id, the bytes that decoding writes."""

    pieces: list[tuple[str, int, float]]
    first_byte: int
    bpe: bool
    spelled: list[bytes] | None = None

    @staticmethod
    def load(path: str) -> Model:
        """Reads the file and proves what the units rest on: pieces hold no space mark after another character, and
        none but byte pieces holds a line feed; the normaliser only marks spaces and puts one in front."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [(sp.id_to_piece(i), i, sp.get_score(i)) for i in usable]
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p, _, _ in pieces):
            raise ValueError("a piece crosses the units")
        probe = "  Aéﬁ\n\t b  "
        if sp.decode(sp.encode(probe)) != probe or sp.encode("a", out_type=str)[0][0] != MARK:
            raise ValueError("the model's normaliser changes texts")
        first = next(i for i in range(n) if sp.is_byte(i))
        spelled = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else bytes([i - first]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        return Model(pieces, first, model_type(path) == "bpe", spelled)

    @property
    def pairs(self) -> frozenset[str]:
        """All two characters that some piece has side by side."""
        return frozenset(p[i : i + 2] for p, _, _ in self.pieces for i in range(len(p) - 1))

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)


def bare_words(text: str | None) -> list[str]:
    """The words of a text in order, without the first mark of those that begin with one, which are all but those after a line feed."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if "  " in text or text[0] == " " or text[-1] == " " or " \n" in text:
        return [u[u[0] == MARK :] for line in re.split("(?=\n)", MARK + text.replace(" ", MARK)) for u in _RUN.findall(line)]
    return text.replace("\n", " \n").split(" ")


def whole(bare: str) -> str:
    """A bare word with its mark."""
    return bare if bare[:1] == "\n" else MARK + bare


def words(text: str | None) -> list[str]:
    """The words of a text in order, with their marks; joined, they are the text with marks for spaces and one mark in front."""
    return [whole(w) for w in bare_words(text)]


class Cutter:
    """Cuts many words into their units at once, by the pairs that pieces have."""

    #: Up to so many characters, pairs are looked up in a square table; beyond, in a sorted list.
    DENSE = 5_000

    def __init__(self, pairs: frozenset[str]) -> None:
        chars = sorted({c for p in pairs for c in p})
        self.of, self.k = np.zeros(0x110000, np.int32), len(chars) + 1
        self.of[[ord(c) for c in chars]] = np.arange(1, self.k)
        self.codes = np.array(sorted(int(self.of[ord(p[0])]) * self.k + int(self.of[ord(p[1])]) for p in pairs), np.int64)
        self.table = np.zeros(self.k**2, bool) if self.k <= self.DENSE else None
        if self.table is not None:
            self.table[self.codes] = True

    def has(self, codes: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[codes]
        i = np.searchsorted(self.codes, codes)
        return np.append(self.codes, -1)[i] == codes

    def __call__(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The units of all words, one word after another, and how many each word has; no word is empty."""
        if not words:
            return [], np.zeros(0, np.int64)
        all_words = "".join(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(lens) - lens
        c = self.of[np.frombuffer(all_words.encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.ones(len(c), bool)
        begins[1:] = ~self.has(c[:-1].astype(np.int64) * self.k + c[1:])
        begins[first] = True
        at = np.flatnonzero(begins).tolist()
        return [all_words[i:j] for i, j in zip(at, [*at[1:], len(c)])], np.add.reduceat(begins, first, dtype=np.int64)


#: A unit's place among the sorted units of its block, and a block's number in its partition, as bits of a number.
_PLACE, _BLOCK = 26, 12


class _Blocks:
    """Numbers the blocks of a partition's texts, in the order in which they are read: a block ends with the text that fills it."""

    def __init__(self) -> None:
        self.first, self.size = TaskContext.get().partitionId() << _BLOCK, 0

    def of(self, texts: pa.Array) -> np.ndarray:
        n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        before = self.size + np.cumsum(n) - n
        self.size += int(n.sum())
        return self.first + np.minimum(before // BLOCK, (1 << _BLOCK) - 1)


def sorted_units(bare: list[str], cutter: Cutter) -> list[str]:
    """The distinct units of words, in order."""
    us: set[str] = set()
    for i in range(0, len(bare), GROUP):
        us.update(cutter([whole(w) for w in bare[i : i + GROUP]])[0])
    return sorted(us)


def units(docs: DataFrame, m: Model) -> DataFrame:
    """(unit, places): distinct units of all texts, and (block, place in the block) of each as numbers.

    The shuffle has a fixed number of partitions, in proportion to the input's, as what follows makes each unit's
    lattice in place."""
    pairs = m.pairs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, cutter, block, found = _Blocks(), Cutter(pairs), -1, set()

        def give() -> Iterator[pa.RecordBatch]:
            us = sorted_units(list(found), cutter)
            found.clear()
            if len(us) >= 1 << _PLACE:
                raise ValueError("a text has too many distinct units")
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.string()), pa.array((block << _PLACE) + np.arange(len(us)))], names=["unit", "place"])

        for b in batches:
            for k, t in zip(blocks.of(b.column("text")).tolist(), b.column("text")):
                if k != block:
                    yield from give()
                    block = k
                found.update(bare_words(t.as_py()))
        yield from give()

    few = docs.select("text")
    dealt = mapped(few, run, "unit string, place long").repartition(SPREAD * max(1, few.rdd.getNumPartitions()), "unit")
    return dealt.groupBy("unit").agg(F.collect_list("place").alias("places"))


def packs(docs: DataFrame) -> DataFrame:
    """(block, rows): the rows of each block as compressed Arrow streams, which are a third of the texts to sort and send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, how = _Blocks(), pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
        for b in batches:
            of = blocks.of(b.column("text"))
            at = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            cuts = np.union1d(at, np.arange(0, b.num_rows, PACK)).tolist()
            for i, j in zip(cuts, [*cuts[1:], b.num_rows]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema, options=how) as out:
                    out.write_batch(b.slice(i, j - i))
                yield pa.RecordBatch.from_arrays([pa.array([int(of[i])]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "rows"])

    return mapped(docs, run, "block long, rows binary")


#: An edge as one number, so that edges sort by rank of score, then from left to right.
_AT, _LEN = 31, 10


def lattice(u: DataFrame, m: Model) -> DataFrame:
    """`u` and edges: array<long> of the pieces of two characters or more (one, for paths) at all places, best score first, then leftmost.

    Every unit keeps a row of no edge, which has the other columns. Grouping needs no shuffle where `u` is dealt by unit."""
    n = F.char_length("unit")
    least = 2 if m.bpe else 1  # merges start from characters; paths need their scores
    kept = F.struct(*(c for c in u.columns if c != "unit"), F.lit(0).alias("_"))
    spans = u.select("unit", kept.alias("kept"), F.explode(F.sequence(F.lit(0), F.greatest(n - least, F.lit(0)))).alias("at"))
    lens = F.sequence(F.when(F.col("at") == 0, 1).otherwise(least), F.greatest(F.least(F.lit(m.longest), n - F.col("at")), F.lit(1)))
    spans = spans.select("unit", F.when(F.col("at") == 0, F.col("kept")).alias("kept"), "at", F.explode(lens).alias("len"))
    spans = spans.withColumn("piece", F.substring("unit", F.col("at") + 1, F.col("len")))
    order = {s: r for r, s in enumerate(sorted({-s for _, _, s in m.pieces}))}
    table = [(p, order[-s]) for p, _, s in m.pieces if len(p) >= least]
    pieces = u.sparkSession.createDataFrame(table or [("", 0)], "piece string, rank long")
    edges = spans.join(broadcast_if(pieces, len(table), 1_000_000), "piece", "left").where("rank IS NOT NULL OR len = 1")
    one = F.when(F.col("rank").isNotNull(), F.shiftleft((F.shiftleft("rank", _AT) + F.col("at")), _LEN) + F.col("len"))
    first = F.when((F.col("at") == 0) & (F.col("len") == 1), F.col("kept"))
    grouped = edges.groupBy("unit").agg(F.element_at(F.collect_list(first), 1).alias("kept"), F.sort_array(F.collect_list(one)).alias("edges"))
    return grouped.select("unit", *(F.col(f"kept.{c}").alias(c) for c in u.columns if c != "unit"), "edges")


def _bit(x: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int"))


def _ends(e: Column) -> tuple[Column, Column]:
    at = F.shiftright(e, _LEN).bitwiseAND(F.lit((1 << _AT) - 1)).cast("int")
    return at, at + e.bitwiseAND(F.lit((1 << _LEN) - 1)).cast("int")


def edge_masks(edges: Column) -> Column:
    """array<struct<ends, inside>>: the bits of an edge's ends and those between."""

    def one(e: Column) -> Column:
        at, end = _ends(e)
        return F.struct(_bit(at).bitwiseOR(_bit(end)).alias("ends"), (_bit(end) - _bit(at + 1)).alias("inside"))

    return F.transform(edges, one)


def bpe_fold(masks: Column, n: Column) -> Column:
    """The boundary bits (0..n) after all merges, each of which is the first edge that can be merged.

    One pass over the edges gives just that as long as no edge is met before it can be merged, with more than one boundary inside: edges met
    without both ends, or without a boundary inside, can't be merged later either. Where one is, the fold looks for the first edge at every step."""
    whole, early, none = _bit(F.least(n, F.lit(LONGEST)) + 1) - 1, F.lit(1 << 62), F.lit(0).cast("long")

    def once(b: Column, e: Column) -> Column:
        left = b.bitwiseAND(e["inside"])
        merged = F.when(left.bitwiseAND(left - 1) == 0, b.bitwiseAND(F.bitwise_not(e["inside"]))).otherwise(b.bitwiseOR(early))
        return F.when(b.bitwiseAND(e["ends"]) == e["ends"], merged).otherwise(b)

    def step(b: Column, _: Column) -> Column:
        free = F.filter(masks, lambda e: (b.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(b.bitwiseAND(e["inside"])) == 1))
        return b.bitwiseAND(F.bitwise_not(F.coalesce(F.get(free, F.lit(0))["inside"], none)))

    def result(b: Column) -> Column:
        most = F.least(n - 1, F.size(masks))
        return F.when(b.bitwiseAND(early) == 0, b).otherwise(F.aggregate(F.sequence(F.lit(1), most), whole, step))

    return F.when((F.size(masks) > 0) & (n <= LONGEST), F.aggregate(masks, whole, once, result)).otherwise(whole)


def merged(edges: list[int], n: int) -> list[int]:
    """The boundaries after all merges of a unit of any length: the first edge that can be merged, again and again.

    Edges are met in order. One whose inside has more than one boundary waits; when a boundary falls, the waiting ones around it that can
    then be merged come before all edges that follow."""
    there, ready = bytearray(b"\1") * (n + 1), []
    waiting: dict[int, set[int]] = {}
    at_of = lambda e: (e >> _LEN) & ((1 << _AT) - 1)
    left = iter(edges)
    e = next(left, None)
    while e is not None or ready:
        if ready and (e is None or ready[0] < e):
            now = heapq.heappop(ready)
        else:
            now, e = e, next(left, None)
        at = at_of(now)
        end = at + (now & ((1 << _LEN) - 1))
        if not (there[at] and there[end]):
            continue
        inside = there.count(1, at + 1, end)
        if inside > 1:
            for p in range(at + 1, end):
                waiting.setdefault(p, set()).add(now)
        elif inside == 1:
            p = there.index(1, at + 1, end)
            there[p] = 0
            for w in waiting.pop(p, ()):
                a = at_of(w)
                if there.count(1, a + 1, a + (w & ((1 << _LEN) - 1))) == 1:
                    heapq.heappush(ready, w)
    return [i for i in range(n + 1) if there[i]]


def viterbi_fold(edges: Column, scores: Column, single: float, n: Column) -> Column:
    """array<int>: for each position, where the best-scoring path to it comes from; single characters at a penalty where no piece is."""
    one = lambda e: F.struct(_ends(e)[1].alias("end"), _ends(e)[0].alias("at"), F.get(scores, F.shiftright(e, _AT + _LEN).cast("int")).alias("score"))
    gaps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i + 1).alias("end"), i.alias("at"), F.lit(float(single)).alias("score")))
    ordered = F.array_sort(F.concat(F.transform(edges, one), gaps))
    none = F.struct(F.lit(-1e300).alias("score"), F.lit(0).alias("came"))
    start = F.concat(F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("came"))), F.array_repeat(none, n))

    def step(best: Column, e: Column) -> Column:
        new = F.struct((F.get(best, e["at"])["score"] + e["score"]).alias("score"), e["at"].alias("came"))
        return F.transform(best, lambda old, i: F.when((i == e["end"]) & (new["score"] > old["score"]), new).otherwise(old))

    return F.aggregate(ordered, start, step, lambda best: F.transform(best, lambda x: x["came"]))


def folded(u: DataFrame, m: Model) -> DataFrame:
    """`u` and its segmentations: _bits, the boundary bits; or _path, where each position comes from, or edges to be merged."""
    n = F.char_length("unit")
    x = lattice(u, m)
    if m.bpe:
        x = x.withColumn("_masks", edge_masks(F.when(n <= LONGEST, F.col("edges")))).withColumn("_bits", bpe_fold(F.col("_masks"), n))
        x = x.withColumn("_path", F.when(n > LONGEST, F.col("edges")))
    else:
        by_rank = F.array(*(F.lit(-s) for s in sorted({-s for _, _, s in m.pieces})))
        x = x.withColumn("_scores", by_rank).withColumn("_bits", F.lit(None).cast("long"))
        least = min((s for _, _, s in m.pieces), default=0.0)
        x = x.withColumn("_path", viterbi_fold(F.col("edges"), F.col("_scores"), least - UNKNOWN, n).cast("array<long>"))
    return x.select(*u.columns, "_bits", "_path")


def _cuts(n: int, bits: int | None, path: list[int] | None, bpe: bool) -> list[int]:
    if path is None:
        return [i for i in range(n + 1) if bits >> i & 1]
    if bpe:
        return merged(path, n)
    out = [n]
    while out[-1]:
        out.append(path[out[-1]])
    return out[::-1]


def numbered(b: pa.RecordBatch, table: dict[str, int], first: int, bpe: bool) -> list[list[int]]:
    """Ids of a batch of folded units, by the piece table; characters without a piece become bytes."""
    out = []
    for unit, bits, path in zip(*(b.column(c).to_pylist() for c in ("unit", "_bits", "_path"))):
        at = _cuts(len(unit), bits, path, bpe)
        ids: list[int] = []
        for i, j in zip(at, at[1:]):
            k = table.get(unit[i:j])
            ids += [k] if k is not None else [first + c for c in unit[i:j].encode("utf-8", "surrogatepass")]
        out.append(ids)
    return out


def segmented(u: DataFrame, m: Model) -> DataFrame:
    """`u` and ids, for distinct units in column unit."""
    x = folded(u, m)
    shared = u.sparkSession.sparkContext.broadcast({p: i for p, i, _ in m.pieces})  # bounded by the model
    keep, first, bpe = u.columns, m.first_byte, m.bpe

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array(numbered(b, shared.value, first, bpe), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids], names=[*keep, "ids"])

    return mapped(x, run, StructType([*u.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def answers(u: DataFrame, m: Model) -> DataFrame:
    """(block, ids): for each block, the ids of some of its units, packed; from (unit, places)."""
    x = folded(u, m)
    shared = u.sparkSession.sparkContext.broadcast({p: i for p, i, _ in m.pieces})  # bounded by the model
    first, bpe = m.first_byte, m.bpe

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = numbered(b, shared.value, first, bpe)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            start, flat = np.cumsum(size) - size, np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
            at, places = _lists(b.column("places"))
            order = np.argsort(places)  # by block, then by place
            unit = np.repeat(np.arange(len(ids)), np.diff(at))[order]
            blocks, places = places[order] >> _PLACE, (places[order] & ((1 << _PLACE) - 1)).astype(np.uint32)
            cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
            packed = []
            for i, j in zip(cuts, [*cuts[1:], len(blocks)]):
                k = unit[i:j]
                packed.append(pack(places[i:j], size[k], flat[_ragged(start[k], size[k])]))
            yield pa.RecordBatch.from_arrays([pa.array(blocks[cuts], pa.int64()), pa.array(packed, pa.binary())], names=["block", "ids"])

    return mapped(x, run, "block long, ids binary")


def pack(places: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """Ascending places, the number of ids of each, and all ids, as compressed bytes."""
    head = np.array([len(places), len(ids)], np.uint32)
    steps = np.diff(places, prepend=np.uint32(0)).astype(np.uint32)
    raw = b"".join(x.tobytes() for x in (head, steps, sizes.astype(np.uint32), ids.astype(np.uint32)))
    return zstandard.compress(raw, 3)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint32)
    n = int(raw[0])
    return np.cumsum(raw[2 : 2 + n], dtype=np.int64), raw[2 + n : 2 + 2 * n].astype(np.int64), raw[2 + 2 * n :].astype(np.int32)


def _ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after another."""
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(int(lens.sum()))


def _lists(a: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column without NULLs."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    if isinstance(a, pa.ChunkedArray):  # no chunk at all
        return np.zeros(1, np.int64), np.zeros(0, np.int32)
    at = a.offsets.to_numpy().astype(np.int64)
    return at - at[0], a.values.to_numpy()[at[0] : at[-1]]


class _Places(dict):
    """Numbers strings in the order in which they come."""

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        return i


def ids_of(texts: pa.ChunkedArray, at: np.ndarray, values: np.ndarray, cutter: Cutter) -> pa.Array:
    """The ids of a block's texts; values[at[i] : at[i + 1]] are the ids of its i-th unit."""
    places = _Places()
    rows = [np.fromiter(map(places.__getitem__, w), np.int32, len(w)) for w in (bare_words(t.as_py()) for t in texts)]
    bare, ids, lens = list(places), [], []
    del places
    us = sorted_units(bare, cutter)
    if len(us) != len(at) - 1:
        raise ValueError("the texts are not those whose units were taken")
    known = dict(zip(us, range(len(us))))
    del us
    for i in range(0, len(bare), GROUP):
        us, k = cutter([whole(w) for w in bare[i : i + GROUP]])
        x = np.fromiter(map(known.__getitem__, us), np.int64, len(us))
        size = at[x + 1] - at[x]
        ids.append(values[_ragged(at[x], size)])
        lens.append(np.add.reduceat(size, np.cumsum(k) - k))
    del known, bare
    ids, lens = np.concatenate(ids or [np.zeros(0, np.int32)]), np.concatenate(lens or [np.zeros(0, np.int64)])
    first = np.cumsum(lens) - lens
    ends = np.cumsum([0] + [int(lens[r].sum()) for r in rows])
    if ends[-1] >= 1 << 31:
        raise ValueError("a text has more pieces than a list can hold")
    out = np.empty(ends[-1], np.int32)
    for r, i, j in zip(rows, ends[:-1], ends[1:]):
        out[i:j] = ids[_ragged(first[r], lens[r])]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out))


def encode(docs: DataFrame, m: Model, *keep: str, check: bool = False) -> DataFrame:
    """Columns `keep` of `docs` (all, if none is named) with ids (array<int>), the pieces of its column text in order; check: and lossless,
    whether they decode to the text (space marks in the text as spaces).

    Texts are read twice, and have to be the same both times; a block that has other units then fails the job."""
    one_of(docs, "text")
    new = ["ids", "lossless"][: 1 + check]
    names = list(keep or docs.columns)
    if taken := {c.lower() for c in names} & set(new):
        raise ValueError(f"the input already has {sorted(taken)}")
    ship(docs.sparkSession)
    wanted = [i for i, c in enumerate(docs.columns) if not keep or c in keep]
    names = [docs.columns[i] for i in wanted]
    plain = docs.toDF(*(f"c{i}" if c != "text" else c for i, c in enumerate(docs.columns)))
    out = [plain.columns[i] for i in wanted]
    plain, pairs = steady(plain.select(*dict.fromkeys([*out, "text"])), "texts"), m.pairs
    speller = docs.sparkSession.sparkContext.broadcast(m) if check else None  # as large as the model

    def join(sent: pa.Table, found: pa.Table) -> pa.Table:
        rows = pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in sent.column("rows")).combine_chunks()
        none = np.zeros(0, np.int64)
        place, size, values = (np.concatenate(x) for x in zip((none, none, none.astype(np.int32)), *(unpack(x.as_py()) for x in found.column("ids"))))
        order, at = np.argsort(place), np.cumsum(size) - size
        if (place[order] != np.arange(len(place))).any():
            raise ValueError("units of a block are missing")
        values, size = values[_ragged(at[order], size[order])], size[order]
        ids = ids_of(rows.column("text"), np.append(0, np.cumsum(size)), values, Cutter(pairs))
        cols = [rows.column(c) for c in out] + [ids]
        if check:
            text = pc.fill_null(pc.replace_substring(rows.column("text"), MARK, " "), "")
            cols.append(pc.equal(text, Speller(speller.value)(ids)))
        trim()
        return pa.table(cols, names=[*out, *new])

    each = answers(units(plain, m), m)
    kinds = (ArrayType(IntegerType()), BooleanType())
    schema = StructType([*(plain.schema[c] for c in out), *(StructField(c, k) for c, k in zip(new, kinds))])
    return packs(plain).groupBy("block").cogroup(each.groupBy("block")).applyInArrow(join, schema).toDF(*names, *new)


class Speller:
    """Ids back to text, in bulk."""

    def __init__(self, m: Model) -> None:
        lens = np.array([len(x) for x in m.spelled], np.int64)
        self.lens, self.starts, self.all = lens, np.cumsum(lens) - lens, np.frombuffer(b"".join(m.spelled), np.uint8)
        self.marked = np.zeros(len(lens), bool)
        self.marked[[i for p, i, _ in m.pieces if p[0] == MARK]] = True

    def __call__(self, ids: pa.Array) -> pa.Array:
        at, values = _lists(pc.fill_null(ids, []) if ids.null_count else ids)
        texts: list[bytes] = []
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + DECODED, "right")) - 1)
            texts += self._some(at[i : j + 1] - at[i], values[at[i] : at[j]])
            i = j
        try:
            return pa.array(texts, pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:  # byte pieces that are no UTF-8
            return pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())

    def _some(self, at: np.ndarray, values: np.ndarray) -> list[bytes]:
        lens = self.lens[values]
        size = np.append(0, np.cumsum(lens))[at]
        raw = self.all[_ragged(self.starts[values], lens)].tobytes()
        first = values[np.minimum(at[:-1], len(values) - 1)] if len(values) else np.zeros(len(at) - 1, np.int64)
        skip = (np.diff(at) > 0) & self.marked[first]  # the mark in front
        return [raw[i:j] for i, j in zip((size[:-1] + skip).tolist(), size[1:].tolist())]


def decode(encodings: DataFrame, m: Model) -> DataFrame:
    """`encodings` with decoded, the text that its column ids spells."""
    one_of(encodings, "ids")
    if any(c.lower() == "decoded" for c in encodings.columns):
        raise ValueError("the input already has a column decoded")
    names, place = encodings.columns, encodings.columns.index("ids")
    plain = encodings.toDF(*(f"c{i}" if i != place else "ids" for i in range(len(names))))
    shared = encodings.sparkSession.sparkContext.broadcast(m)  # as large as the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = Speller(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, spell(b.column("ids"))], names=[*b.schema.names, "decoded"])

    return mapped(plain, run, StructType([*plain.schema.fields, StructField("decoded", StringType())])).toDF(*names, "decoded")
