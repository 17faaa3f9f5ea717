"""Language by nearest centroid: TF-IDF n-gram vectors against several clustered centroids per language.

A text's letters, lower-cased in ASCII, are counted as hashed byte bigrams and trigrams, damped by log(1 + count),
weighted by inverse document frequency and normalised. Each language's sample is clustered by spherical k-means. A text takes the language of
the centroid with the largest cosine; it is marked as rejected when that cosine is under what nearly all of the
centroid's own members reach.

Fitting uses a bounded sample of labelled rows: of each language's distinct texts those with the least hashes, `PER_LANGUAGE` of them, or fewer where
languages are many (`SAMPLE` in all, one of each language at least). More than `LANGUAGES` languages are an error, as no model of that size is held by workers. Prediction
covers every row and whole texts.

Cases: texts that are NULL or have no letter (of Unicode's category L) are 'und' with score 0; so is everything when nothing was learned; ties go to the
language first in order, and inside it to its first centroid; repeated rows are predicted alike and learned once; a very long text is one vector, counted in parts;
an empty table gives an empty result; other columns are ignored, and kept ones may have any name but those of the new columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovewise.llm.common import mapped, name_of, one_of, stored

UND = "und"
DIMENSIONS, CENTROIDS, PER_LANGUAGE, SAMPLE, LANGUAGES = 4096, 4, 1000, 8000, 4000
#: The share of a centroid's members that its rejection cosine leaves out.
LEFT_OUT = 0.01
BATCH = 256
_HAS_LETTER = regex.compile(r"\p{L}")
#: Bytes of a text that are counted at once.
PART = 1 << 22
_MAP = np.full(256, 32, np.uint8)
for _c in (*range(65, 91), *range(97, 123)):
    _MAP[_c] = _c | 32
_MAP[128:] = np.arange(128, 256)


def has_letter(text: str | None) -> bool:
    return bool(text) and _HAS_LETTER.search(text) is not None


def counts(text: str) -> np.ndarray:
    """Hashed bigram and trigram counts of the letters; runs of other characters are one space."""
    b = _MAP[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
    out = np.zeros(DIMENSIONS, np.int64)
    for i in range(0, len(b) - 1, PART):  # the last two bytes of a part are the first of the next
        x = b[i : i + PART + 2].astype(np.uint32)
        two = x[:-1] << 8 | x[1:]
        three = two[:-1] << 8 | x[2:]
        out += np.bincount((two[:PART] * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
        out += np.bincount(((three[:PART] + np.uint32(1 << 24)) * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    return out


def normalised(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(c, dtype=np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for i in range(0, len(texts), BATCH):
            some = texts[i : i + BATCH]
            there = [has_letter(t) for t in some]
            x = np.stack([counts(t) if ok else np.zeros(DIMENSIONS, np.int64) for t, ok in zip(some, there)])
            cos = normalised(x, self.idf) @ self.centroids.T if len(self.languages) else np.zeros((len(some), 0))
            for ok, row in zip(there, cos):
                if not ok or not row.size:
                    out.append((UND, 0.0, True))
                else:
                    k = int(row.argmax())
                    out.append((self.languages[self.owner[k]], float(min(1.0, max(0.0, row[k]))), bool(row[k] < self.least[k])))
        return out


def cluster(x: np.ndarray, k: int, steps: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart rows: centroids and each row's centroid."""
    pick = [int((x @ x.mean(0)).argmax())]
    while len(pick) < min(k, len(x)):
        pick.append(int((x @ x[pick].T).max(1).argmin()))
    c = x[pick]
    for _ in range(steps):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == j].sum(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(1)


def build(langs: list[str], c: np.ndarray) -> Model:
    """A model from the labelled rows' counts."""
    names = sorted(set(langs))
    idf = np.log((1 + len(langs)) / (1 + (c > 0).sum(0))).astype(np.float32) + 1
    x, y = normalised(c, idf), np.array(langs)
    cs, owner, least = [np.zeros((0, DIMENSIONS), np.float32)], [], []
    for k, name in enumerate(names):
        rows = x[y == name]
        own, near = cluster(rows, CENTROIDS)
        cos = (rows * own[near]).sum(1)
        cs.append(own)
        owner += [k] * len(own)
        least += [float(np.quantile(cos[near == j], LEFT_OUT)) if (near == j).any() else 0.0 for j in range(len(own))]
    return Model(names, idf, np.concatenate(cs).astype(np.float32), np.array(owner, int), np.array(least))


def sample(labelled: DataFrame) -> DataFrame:
    """(lang, text): of each language's distinct texts with a letter those with the least hashes.

    Only (lang, hash) is shuffled, a row for each distinct text, and a window keeps the first of each task before it meets the others'."""
    one_of(labelled, "lang", "text")
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text").withColumn("h", F.xxhash64(F.lit("sample"), "text"))
    keys = stored(usable.select("lang", "h").distinct(), "language-texts", narrow=True)
    n = keys.select("lang").distinct().count()
    if n > LANGUAGES:
        raise ValueError(f"{n} languages, {LANGUAGES} at most can be learned")
    each = min(PER_LANGUAGE, max(1, SAMPLE // max(1, n)))
    first = keys.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("r") <= each).select("lang", "h")
    chosen = usable.join(F.broadcast(first), ["lang", "h"], "left_semi")  # SAMPLE + LANGUAGES rows at most
    return chosen.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(labelled: DataFrame) -> Model:
    """From (lang, text), on a bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array([np.minimum(counts(y), 65535).astype(np.uint16).tobytes() for y in b.column("text").to_pylist()], pa.binary())], names=["lang", "c"])

    rows = sorted((r.lang, bytes(r.c)) for r in mapped(sample(labelled), run, "lang string, c binary").collect())
    if not rows:
        return Model([], np.ones(DIMENSIONS, np.float32), np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, int), np.zeros(0))
    return build([x for x, _ in rows], np.stack([np.frombuffer(c, np.uint16) for _, c in rows]))


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """(keep..., lang_pred, score, rejected) for every row; only `text` is used."""
    one_of(docs, "text", *keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: languages * CENTROIDS * DIMENSIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = shared.value.predict(b.column("text").to_pylist())
            cols = [b.column(c) for c in keep] + [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"{name_of(c)} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return mapped(docs.select(*map(name_of, dict.fromkeys([*keep, "text"]))), run, f"{fields}, lang_pred string, score double, rejected boolean")
