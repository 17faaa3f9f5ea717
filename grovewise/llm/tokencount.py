"""Token counts of a byte-level BPE by the whole-token shortcut.

Merges never cross pre-tokens, so a text's count is the sum over its pre-tokens. Before any data is read, the vocabulary is
searched for strings that are one pre-token and that the library encodes as one token; pre-tokens
among them count one. Only the others are merged, each distinct one once per worker and cache.

Special strings in texts are one token each, as the library's default has it; texts that hold some are cut there.
Begin, end and padding tokens are not added, nothing is truncated.

Cases: NULL counts as empty, with no tokens; very long texts are cut into pre-tokens in one pass; repeated rows count
alike; extra columns pass through where they are kept.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from grovewise.llm.common import mapped

#: Fixed value: the pattern that a byte-level pre-tokenizer splits by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a worker keeps for merged pre-tokens; older ones are merged again when needed.
CACHE = 700_000


class Counter:
    """Counts with one tokenizer file (its text)."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(source)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("the shortcut is proven only for byte-level BPE that splits by its pattern")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take in their surroundings are not supported")
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(spec["added_tokens"], key=lambda t: -len(t["content"])))) if spec["added_tokens"] else None
        self.split = regex.compile(PATTERN).findall
        self.whole: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def prove(self) -> Counter:
        """Finds the whole tokens: strings that are their own only pre-token and encode as one token."""
        ids = sorted(self.tokenizer.get_vocab(with_added_tokens=False).values())
        texts = self.tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False)
        fit = [t for t in dict.fromkeys(texts) if t and "�" not in t and self.split(t) == [t] and not (self.special and self.special.search(t))]
        self.whole = {t: 1 for t, n in zip(fit, self.lengths(fit)) if n == 1}
        self.known = dict(self.whole)
        return self

    def lengths(self, strings: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def counts(self, texts: list[str | None]) -> list[int]:
        out = []
        for i in range(0, len(texts), 64):
            cut = [self._cut(t) for t in texts[i : i + 64]]
            new = list(set().union(*(p for p, _ in cut)) - self.known.keys())
            if len(self.known) > CACHE:
                self.known = dict(self.whole)
                new = list(set().union(*(p for p, _ in cut)) - self.known.keys())
            self.known.update(zip(new, self.lengths(new)))
            out += [sum(map(self.known.__getitem__, p)) + k for p, k in cut]
        return out

    def _cut(self, text: str | None) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings."""
        if not text:
            return [], 0
        if self.special is None or not self.special.search(text):
            return self.split(text), 0
        parts = self.special.split(text)
        return [t for p in parts for t in self.split(p)], len(parts) - 1


def token_counts(docs: DataFrame, path: str, limit: int, *keep: str) -> DataFrame:
    """(keep..., n_bytes, n_tokens, over_limit) for every row's `text`, with the tokenizer file at `path` (read on the driver)."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    c = Counter(source).prove()
    shared = docs.sparkSession.sparkContext.broadcast((source, list(c.whole)))  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, whole = shared.value
        counter = Counter(text)
        counter.whole = dict.fromkeys(whole, 1)
        counter.known = dict(counter.whole)
        for b in batches:
            col = b.column("text")
            n = counter.counts(col.to_pylist())
            size = [len(x.encode("utf-8", "surrogatepass")) if x else 0 for x in col.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return mapped(docs.select(*dict.fromkeys([*keep, "text"])), run, f"{fields}, n_bytes long, n_tokens long, over_limit boolean")
