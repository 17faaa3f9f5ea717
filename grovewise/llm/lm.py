"""Log-bilinear language model, trained in numpy by noise-contrastive estimation (NCE).

The model predicts a word from the two before it: the context vector is the sum of their embeddings, each scaled by position, and
its product with an output's own vector, plus a bias, is the output's score. The vocabulary grows with the corpus: all words that occur at least sqrt(N) / `GROWTH`
times among N, so at most `GROWTH` sqrt(N) of them, an end token, and one class for all other words; inside that class, words follow their smoothed counts, so
every text has a normalised probability.

Vocabulary words are dealt to frequency classes, so that a word's probability is its class's among all classes times its own inside the class, each
normalised exactly by batched products for the contexts that occur, or by products of exponentials that are made once for the most frequent contexts. A class takes words in order of frequency until the roots of their shares add up to one, which makes
both sums together shortest. NCE trains both steps: classes against noise shared by an update, words against noise from their class.

Word counts are taken over the whole training corpus. Texts are dealt to learners, as many as the corpus has tokens for (`EACH` for every row of parameters), whatever its partitions. Each
learner trains on all of its texts from the same start, and the learners' parameters are averaged row by row, by how often a learner has met the row; rounds start from the average.
So what learners send is in proportion to the corpus, and what one has learned doesn't fade as partitions become more.

Counts of the vocabulary, or of the most frequent words if they are more (at most `HEAD`), are broadcast; the other words of a text meet their counts in a join. Vectors
and counts of the vocabulary are held by every worker.

Cases: a NULL text is empty, with the end token only; without training rows all words are unknown and the model is uniform over its vocabulary;
rows may repeat, ids may repeat or be NULL and are of any type; words of equal count rank by their bytes; very long texts are scored in batches; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovewise.llm.common import mapped, one_of, stored

#: Most model words for the root of the number of words, head words that are broadcast with their counts, vector length, noise classes of an update, noise words
#: of a token, tokens per update, tokens scored at once, rows per block of parameters, a learner's tokens for each row of parameters.
GROWTH, HEAD, WIDTH, NOISE, INNER, UPDATE, BATCH, BLOCK, EACH = 40, 100_000, 16, 32, 2, 4096, 65_536, 8192, 128
ROUNDS, RATE = 1, 0.1
#: Scores that are made at once, which fit a core's cache; exponentials that a worker keeps for each place, of the top outputs and of all words inside their classes.
CELLS, KEPT = 80_000, 1 << 23
FLUSH = 200_000


def tokens(text: str | None) -> list[bytes]:
    """Words lower-cased in ASCII, without the end token."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): counts over all texts; partitions add up what they can hold before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
        for b in batches:
            for t in b.column("text"):
                c.update(tokens(t.as_py()))
                if len(c) > FLUSH:
                    yield give()
                    c.clear()
        if c:
            yield give()

    return mapped(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Parameters:
    """Context embeddings (words, end, other, begin), their two position scales, output vectors (top outputs, then words inside their classes), biases."""

    context: np.ndarray
    scale: np.ndarray
    word: np.ndarray
    bias: np.ndarray

    @staticmethod
    def start(p: np.ndarray, contexts: int, width: int = WIDTH, seed: int = 1) -> Parameters:
        """p: shares of the outputs."""
        rng, v = np.random.default_rng(seed), len(p)
        return Parameters(rng.normal(0, 0.1, (contexts, width)).astype(np.float32), np.ones((2, width), np.float32), rng.normal(0, 0.1, (v, width)).astype(np.float32), np.log(p).astype(np.float32))

    def rows(self) -> np.ndarray:
        """All parameters as rows: contexts, scales, outputs; the last column is an output's bias."""
        zero = lambda x: np.zeros((len(x), 1), np.float32)
        return np.vstack([np.hstack([x, b]) for x, b in ((self.context, zero(self.context)), (self.scale, zero(self.scale)), (self.word, self.bias[:, None]))])

    @staticmethod
    def of(rows: np.ndarray, contexts: int) -> Parameters:
        a, b, c = np.split(rows, [contexts, contexts + 2])
        return Parameters(*(x[:, :-1].copy() for x in (a, b, c)), c[:, -1].copy())

    def copy(self) -> Parameters:
        return Parameters(self.context.copy(), self.scale.copy(), self.word.copy(), self.bias.copy())


@dataclass(frozen=True)
class Classes:
    """Word classes as bounds of word ids (from 0 to the number of words), and counts of words, ends and others. Top outputs: classes, end, other."""

    bounds: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of_counts(words: np.ndarray, ends: int, others: int) -> Classes:
        """words: their counts, the most frequent first."""
        counts = np.append(np.asarray(words, np.int64), [ends, others])
        k = np.floor(np.cumsum(np.sqrt((counts[:-2] + 1) / (counts.sum() + len(counts)))) - 1e-9).astype(np.int64)
        return Classes(np.append(np.flatnonzero(np.diff(k, prepend=-1)), len(words)), counts)

    @property
    def n_words(self) -> int:
        return len(self.counts) - 2

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def tops(self) -> np.ndarray:
        """The top output of each id: words, end, other."""
        k = len(self.bounds) - 1
        return np.append(np.repeat(np.arange(k), self.sizes), [k, k + 1])

    @property
    def shares(self) -> np.ndarray:
        """Smoothed shares of the top outputs, then of each word inside its class."""
        c = self.counts + 1.0
        top = np.bincount(self.tops, c)
        return np.concatenate([top / top.sum(), (c / top[self.tops])[:-2]])

    def start(self) -> Parameters:
        return Parameters.start(self.shares, self.n_words + 3)


def stream(ids: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the word before that, for each token of one text that ends with the end token."""
    one = np.empty_like(ids)
    one[0], one[1:] = begin, ids[:-1]
    two = np.empty_like(ids)
    two[:2], two[2:] = begin, ids[:-2]
    return one, two


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; the exponential of a large number is infinite, and its inverse 0."""
    with np.errstate(over="ignore"):
        np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """NCE with top noise shared by an update and words' noise from their class, both by their shares, and Adagrad steps."""

    def __init__(self, p: Parameters, classes: Classes, seed: int):
        self.p, self.rng = p, np.random.default_rng(seed)
        self.tops, self.sizes, self.bounds, self.n_words = classes.tops, classes.sizes, classes.bounds, classes.n_words
        self.n_top = len(self.sizes) + 2
        self.log_share = np.log(INNER * classes.shares[self.n_top :]).astype(np.float32)
        noise = classes.shares[: self.n_top]
        self.cdf, self.log_noise = np.cumsum(noise), np.log(noise * NOISE).astype(np.float32)
        past = lambda x, a: np.full_like(x, a)
        t = self.n_top
        self.past_context, self.past_scale = past(p.context, 1), past(p.scale, 1e-4)
        self.past_top, self.past_top_bias = past(p.word[:t], 1e-4), past(p.bias[:t], 1e-4)
        self.past_word = past(np.empty((len(p.word) - t, p.word.shape[1] + 1), np.float32), 1)
        self.context_hits, self.word_hits = np.zeros(len(p.context), np.int64), np.zeros(self.n_words, np.int64)
        self.seen = 0

    def update(self, w: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """Tokens are taken by word, and so by top output; rows are fetched by `take`, which is several times faster than an index."""
        p, k, width, n = self.p, len(w), self.p.word.shape[1], self.n_top
        order = np.argsort(w)
        w, ones = w[order], np.ones(k, np.float32)
        r1, r2 = p.context.take(one[order], 0), p.context.take(two[order], 0)
        q = r1 * p.scale[0]
        q += r2 * p.scale[1]
        top = self.tops[w]
        noise = np.minimum(np.searchsorted(self.cdf, self.rng.random(NOISE) * self.cdf[-1]), n - 1)
        t, tn = p.word[:n].take(top, 0), p.word[noise]
        g = _sigmoid(-(np.einsum("ij,ij->i", q, t) + (p.bias[:n] - self.log_noise)[top]))
        gn = q @ tn.T
        gn += p.bias[noise] - self.log_noise[noise]
        np.negative(_sigmoid(gn), out=gn)
        dq = gn @ tn
        t *= g[:, None]
        dq += t
        dtop = np.zeros((n, width + 1), np.float32)
        first = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
        dtop[top[first], :width], dtop[top[first], width] = np.add.reduceat(np.multiply(g[:, None], q, out=t), first, axis=0), np.add.reduceat(g, first)
        np.add.at(dtop, noise, np.column_stack([gn.T @ q, ones @ gn]))
        dtop /= k
        self._inner(w, top, q, dq)
        dscale = np.stack([ones @ np.multiply(dq, r, out=r) for r in (r1, r2)]) / k
        # back in the order of the texts: a word is two before a token where it is one before the token before
        back = np.empty_like(order)
        back[order] = np.arange(k)
        dq = dq.take(back, 0)
        near, far = dq * p.scale[0], dq * p.scale[1]
        same = np.append(False, two[1:] == one[:-1])
        near[:-1] += far[1:] * same[1:, None]
        u, rows, hits = self._sum(np.concatenate([one, two[~same]]), np.concatenate([near, far[~same]]))
        past = self.past_context.take(u, 0)
        past += rows * rows
        self.past_context[u] = past
        rows *= RATE / np.sqrt(past)
        p.context[u] += rows
        self.context_hits[u] += hits
        for x, d, past in ((p.scale, dscale, self.past_scale), (p.word[:n], dtop[:, :width], self.past_top), (p.bias[:n], dtop[:, width], self.past_top_bias)):
            past += d * d
            x += RATE * d / np.sqrt(past)
        self.seen += k

    def _inner(self, w: np.ndarray, top: np.ndarray, q: np.ndarray, dq: np.ndarray) -> None:
        """Words inside their classes; adds to dq. Tokens come by word. Classes of one word have nothing to learn.

        A token's noise words are the words of other tokens of its class in the update, by turns of the class's tokens, so noise follows the
        words' own shares and takes no rows but those of the update's words."""
        at = np.flatnonzero(w < self.n_words)
        at = at[self.sizes[top[at]] > 1]
        if not len(at):
            return
        p, n, width = self.p, self.n_top, self.p.word.shape[1]
        ids, q, c = w[at], q.take(at, 0), top[at]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        size = np.diff(np.append(first, len(c)))
        start, size = np.repeat(first, size), np.repeat(size, size)
        place = np.arange(len(at)) - start
        x, bias = p.word.take(n + ids, 0), p.bias[n + ids]
        known = bias - self.log_share[ids]
        g = _sigmoid(np.einsum("ij,ij->i", x, q) + known)
        g -= 1
        rows, back = np.empty((len(at), width + 1), np.float32), g[:, None] * x
        np.multiply(g[:, None], q, out=rows[:, :width])
        rows[:, width] = g
        for u in self.rng.random(INNER):
            turn = (u * size).astype(np.int64)
            to, fro = start + (place + turn) % size, start + (place - turn) % size
            other = x.take(to, 0)
            h = _sigmoid(np.einsum("ij,ij->i", other, q) + known[to])
            other *= h[:, None]
            back += other
            h = h[fro]
            other = q.take(fro, 0)
            other *= h[:, None]
            rows[:, :width] += other
            rows[:, width] += h
        dq[at] -= back
        u = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ids, rows, hits = ids[u], -np.add.reduceat(rows, u, axis=0), np.diff(np.append(u, len(ids)))
        past = self.past_word.take(ids, 0)
        past += rows * rows
        self.past_word[ids] = past
        rows *= RATE / np.sqrt(past)
        p.word[n + ids] += rows[:, :width]
        p.bias[n + ids] += rows[:, width]
        self.word_hits[ids] += hits

    @property
    def hits(self) -> np.ndarray:
        """How often each row of the parameters was met."""
        return np.concatenate([self.context_hits, np.full(2 + self.n_top, self.seen), self.word_hits])

    @staticmethod
    def _sum(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ids, their rows added up, and how many there were."""
        order = np.argsort(ids)
        s = ids[order]
        first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        return s[first], np.add.reduceat(rows.take(order, 0), first, axis=0), np.diff(np.append(first, len(s)))


@dataclass(frozen=True)
class Vocabulary:
    """index: head words to ranks; counts: by rank. The first ranks are the model's words; ids: words, then end, then other; begin is a context only."""

    index: dict[bytes, int]
    counts: np.ndarray
    classes: Classes
    total: int
    types: int
    ends: int
    other_tokens: int
    other_types: int


def vocabulary(counts: DataFrame, train_docs: int) -> Vocabulary:
    """The end token is counted with N and V; words by count, ties by word.

    The head is found by a histogram of counts, 16 bins for each power of two, so that no task orders the words."""
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("b")).agg(F.count("*").alias("v"), F.sum("n").alias("n"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()
    n, types = sum(r.n for r in bins), sum(r.v for r in bins)
    least, head, at = math.sqrt(n) / GROWTH, 0, math.inf
    for r in bins:
        head += r.v
        if head <= HEAD:
            at = r.least
    table = counts.where(F.col("n") >= min(least, at)).select("word", "n").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    k = table.column("n").to_numpy()
    v = int((k >= least).sum())
    other = n - int(k[:v].sum())
    return Vocabulary({w: i for i, w in enumerate(table.column("word").to_pylist())}, k, Classes.of_counts(k[:v], train_docs, other), n + train_docs, types + (train_docs > 0), train_docs, other, types - v)


def learners(v: Vocabulary) -> int:
    return max(1, v.total // (EACH * (2 * v.classes.n_words + len(v.classes.bounds))))


def ranks(words: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    """Ranks of a text's words; -1 where a word is not of the head."""
    return np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))


def text_ids(r: np.ndarray, n_words: int) -> np.ndarray:
    """Model ids of a text's words and its end."""
    return np.append(np.where((r >= 0) & (r < n_words), r, n_words + 1), n_words)


def average(grown: DataFrame, start: np.ndarray) -> np.ndarray:
    """Rows of parameters averaged over partitions, from (block, ids, x, hits); a row that none has met stays."""
    width = start.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for block, ids, x, hits in zip(*(b.column(c).to_pylist() for c in ("block", "ids", "x", "hits"))):
                total, n = sums.setdefault(block, (np.zeros((BLOCK, width)), np.zeros(BLOCK)))
                ids, h = np.frombuffer(ids, np.int32), np.frombuffer(hits, np.int64)
                total[ids] += np.frombuffer(x, np.float32).reshape(-1, width) * h[:, None]
                n[ids] += h
        for block, (total, n) in sums.items():
            ids = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([(total[ids] / n[ids, None]).astype(np.float32).tobytes()], pa.binary())], names=["block", "ids", "x"])

    out = start.copy()
    for r in mapped(grown.repartition("block"), run, "block int, ids binary, x binary").collect():
        out[r.block * BLOCK + np.frombuffer(bytes(r.ids), np.int32)] = np.frombuffer(bytes(r.x), np.float32).reshape(-1, width)
    return out


def train(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> Parameters:
    """Every learner trains on all its texts; parameters are averaged inside Spark."""
    p = v.classes.start()
    spark, docs = docs.sparkSession, docs.select("text").coalesce(learners(v))
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((p, v.index, v.classes))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, r=r) -> Iterator[pa.RecordBatch]:
            p, index, classes = shared.value
            t = Trainer(p.copy(), classes, 1000 * r + TaskContext.get().partitionId())
            begin, kept, size = classes.n_words + 2, [], 0

            def flush() -> None:
                ids, one, two = (np.concatenate(x) for x in zip(*kept))
                for i in range(0, len(ids), UPDATE):
                    t.update(ids[i : i + UPDATE], one[i : i + UPDATE], two[i : i + UPDATE])

            for b in batches:
                for text in b.column("text"):
                    ids = text_ids(ranks(tokens(text.as_py()), index), classes.n_words)
                    kept.append((ids, *stream(ids, begin)))
                    size += len(ids)
                    if size >= 16 * UPDATE:
                        flush()
                        kept, size = [], 0
            if kept:
                flush()
            if t.seen:
                rows, hits = t.p.rows(), t.hits
                for i in range(0, len(rows), BLOCK):
                    ids = np.flatnonzero(hits[i : i + BLOCK])
                    if len(ids):
                        yield pa.RecordBatch.from_arrays([pa.array([i // BLOCK], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (ids.astype(np.int32), rows[i + ids], hits[i + ids])], names=["block", "ids", "x", "hits"])

        p = Parameters.of(average(mapped(docs, run, "block int, ids binary, x binary, hits binary"), p.rows()), len(p.context))
    return p


class Outputs:
    """Logs of sums of exponential scores over some outputs, for contexts that are sums of two embeddings.

    exp(a + b) is exp(a) exp(b), so the exponentials of the first `kept` embeddings of either place are made once, and a token whose words are both among them
    takes a product of two rows. Other tokens, and sums too small for a float, take exponentials of their own. Both ways are exact."""

    def __init__(self, word: np.ndarray, one: np.ndarray, two: np.ndarray, kept: int):
        self.word, self.kept = np.ascontiguousarray(word.T), min(kept, len(one))
        self.step, self.ones = max(1, CELLS // len(word)), np.ones(len(word), np.float32)
        self.one, self.two = (self._scaled(x[: self.kept] @ self.word) for x in (one, two))

    @staticmethod
    def _scaled(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials of rows less their maximum, and the maximum; overwrites s."""
        m = s.max(1)
        s -= m[:, None]
        return np.exp(s, out=s), m

    def log_sums(self, q: np.ndarray) -> np.ndarray:
        """For any contexts. Rows are scaled by their maximum only where the plain sum leaves a float's range."""
        out = np.empty(len(q), np.float32)
        for i in range(0, len(q), self.step):
            s = q[i : i + self.step] @ self.word
            if s.max() < 80:
                sums = np.exp(s) @ self.ones
                if sums.min() > 1e-30:
                    out[i : i + self.step] = np.log(sums)
                    continue
            e, m = self._scaled(s)
            out[i : i + self.step] = m + np.log(e @ self.ones)
        return out

    def log_sums_kept(self, one: np.ndarray, two: np.ndarray, q: np.ndarray) -> np.ndarray:
        """For contexts of kept embeddings, given by their places and as vectors."""
        (a, m), (b, k) = self.one, self.two
        sums = np.empty(len(q), np.float32)
        for i in range(0, len(q), self.step):
            np.einsum("ij,ij->i", a.take(one[i : i + self.step], 0), b.take(two[i : i + self.step], 0), out=sums[i : i + self.step])
        small = np.flatnonzero(sums < 1e-30)
        sums[small] = 1
        out = np.log(sums) + m[one] + k[two]
        if len(small):
            out[small] = self.log_sums(q[small])
        return out


class ClassScorer:
    """Natural log probabilities of ids after contexts."""

    def __init__(self, p: Parameters, classes: Classes):
        n = len(classes.sizes) + 2
        self.tops, self.sizes, self.n_words = classes.tops, classes.sizes, classes.n_words
        # contexts by frequency: others, begins, words, ends (which precede nothing); a last column multiplies the biases
        order = np.append([self.n_words + 1, self.n_words + 2], np.arange(self.n_words + 1))
        self.place = np.argsort(order)
        self.one, self.two = (np.column_stack([p.context[order] * p.scale[i], np.full(len(order), 1 - i, np.float32)]) for i in (0, 1))
        self.word = np.column_stack([p.word, p.bias])
        self.top = Outputs(self.word[:n], self.one, self.two, KEPT // n)
        self.each = min(KEPT // max(1, self.n_words), len(order))
        self.inner = {c: Outputs(self.word[n + a : n + b], self.one, self.two, self.each) for c, (a, b) in enumerate(zip(classes.bounds, classes.bounds[1:])) if b - a > 1}

    def log_p(self, ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        # by class, and tokens of kept embeddings first
        one, two = self.place[one], self.place[two]
        last = np.maximum(one, two)
        group = 2 * self.tops[ids] + (last >= self.each)
        order = np.argsort(group)
        ids, one, two, last, group = (x[order] for x in (ids, one, two, last, group))
        top = group >> 1
        q = self.one.take(one, 0)
        q += self.two.take(two, 0)
        p = np.einsum("ij,ij->i", q, self.word.take(top, 0))
        kept, rest = np.flatnonzero(last < self.top.kept), np.flatnonzero(last >= self.top.kept)
        p[kept] -= self.top.log_sums_kept(one[kept], two[kept], q.take(kept, 0))
        p[rest] -= self.top.log_sums(q.take(rest, 0))
        ends = np.searchsorted(group, np.arange(2 * len(self.sizes) + 1))
        for c, x in self.inner.items():
            a, b, end = ends[2 * c : 2 * c + 3]
            if a < b:
                p[a:b] -= x.log_sums_kept(one[a:b], two[a:b], q[a:b])
            if b < end:
                p[b:end] -= x.log_sums(q[b:end])
        w = np.flatnonzero(ids < self.n_words)
        w = w[self.sizes[top[w]] > 1]
        p[w] += np.einsum("ij,ij->i", q.take(w, 0), self.word.take(len(self.sizes) + 2 + ids[w], 0))
        out = np.empty_like(p)
        out[order] = p
        return out

    def texts(self, ids: list[np.ndarray]) -> np.ndarray:
        """Log10 probabilities of whole texts, scored in batches."""
        begin = self.n_words + 2
        x = [np.concatenate(y) for y in zip(*((i, *stream(i, begin)) for i in ids))]
        p = np.concatenate([self.log_p(*(y[i : i + BATCH] for y in x)) for i in range(0, len(x[0]), BATCH)]).astype(float)
        return np.add.reduceat(p, np.cumsum([0] + [len(i) for i in ids[:-1]])) / math.log(10)


def scored(docs: DataFrame, training: Column, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of (doc_id, text)."""
    one_of(docs, "doc_id", "text")
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text", training.alias("_train"))
    learn = marked.where("_train")
    counts = stored(word_counts(learn), "word-counts")
    v = vocabulary(counts, learn.count())
    p = train(learn, v, rounds)
    tables = spark.sparkContext.broadcast((v, p))
    n, denominator, other = v.total, v.total + v.types + 1, v.other_tokens + v.other_types + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = tables.value
        model, index, n_words = ClassScorer(p, v.classes), v.index, v.classes.n_words
        base, inside = np.log10((v.counts + 1) / denominator), np.log10((v.counts + 1) / other)
        end = math.log10((v.ends + 1) / denominator)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            found, times, ends, open_, size = [], [], [0], [], 0
            for t in b.column("text"):
                w = tokens(t.as_py())
                r = ranks(w, index)
                known = r[r >= 0]
                tail = Counter(w[i] for i in np.flatnonzero(r < 0))
                for c, x in zip(cols, (row, len(w) + 1, len(known) + int(v.ends > 0), end + float(base[known].sum()), float(inside[known[known >= n_words]].sum()))):
                    c.append(x)
                found.extend(tail)
                times.extend(tail.values())
                ends.append(len(found))
                row += 1
                open_.append(text_ids(r, n_words))
                size += len(w) + 1
                if size >= BATCH or len(cols[0]) == b.num_rows:
                    k = len(cols[0])
                    cols[4][k - len(open_) :] = np.add(cols[4][k - len(open_) :], model.texts(open_)).tolist()
                    open_, size = [], 0
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            tails = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(found, pa.binary()), pa.array(times, pa.int64())], names=["word", "k"]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_train")] + [pa.array(c, k) for c, k in zip(cols, kinds)] + [tails], names=["doc_id", "_train", "row", "n_tokens", "known", "base", "own", "tail"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    x = stored(mapped(marked, run, f"doc_id {kind}, _train boolean, row long, n_tokens long, known long, base double, own double, tail array<struct<word:binary,k:bigint>>"), "head-scores")
    rare = x.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.k").join(counts, "word", "left")
    c = F.coalesce("n", F.lit(0)) + 1
    sums = rare.groupBy("row").agg(F.sum(F.col("k") * F.log10(c / denominator)).alias("b"), F.sum(F.col("k") * F.log10(c / other)).alias("s"), F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("m"))
    y = x.drop("tail").join(sums, "row", "left")
    zero = F.lit(0.0)
    return y.select("doc_id", (~F.col("_train")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("m", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", zero)).alias("base_score"), (F.col("own") + F.coalesce("s", zero)).alias("score"))
