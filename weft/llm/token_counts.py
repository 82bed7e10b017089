"""Greedy word-piece lengths by a longest-match automaton, without building pieces.

The vocabulary is a trie over bytes. Where a word leaves the trie, a node's failure link names the
node of what is left once the pieces that greedy matching would take there are popped, and the
number of those pieces is kept with the node. So a word costs one step per byte plus the links
followed, linear in its length, and its count is a sum of stored numbers.

A word is a run of characters outside 0x20 and 0x09-0x0D and is matched with a space before it, as
the vocabulary's word-initial tokens begin with one. Every single byte is a token, so each word has
a count. Counts of words up to MEMO_LENGTH bytes are remembered per task.

A row needs only itself, so nothing shuffles; the vocabulary (fixed size) is broadcast.

Defined cases: null or empty text has 0 words and 0 tokens; nulls elsewhere, repeated rows and extra
columns do not matter; very long texts are read whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weft.llm._shared import text_or_empty
from weft.llm._vocab import default_path, read_ranks

MEMO, MEMO_LENGTH = 1_000_000, 64


class Automaton:
    def __init__(self, tokens: list[bytes]) -> None:
        self.child: list[dict[int, int]] = [{}]
        ends = [False]
        for token in tokens:
            node = 0
            for b in token:
                node = self.child[node].setdefault(b, len(self.child))
                if node == len(self.child):
                    self.child.append({})
                    ends.append(False)
            ends[node] = True
        if missing := [b for b in range(256) if b not in self.child[0] or not ends[self.child[0][b]]]:
            raise ValueError(f"bytes without a token: {missing[:8]}")
        self.link = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, below in self.child[node].items():
                queue.append(below)
                if ends[below]:
                    self.link[below], self.popped[below] = 0, 1
                    continue
                at, count = self.link[node], self.popped[node]
                while at >= 0 and b not in self.child[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[below], self.popped[below] = self.child[at][b], count

    def count(self, word: bytes) -> int:
        node, total = 0, 0
        for b in word:
            while (below := self.child[node].get(b)) is None:
                total += self.popped[node]
                node = self.link[node]
            node = below
        while node:
            total += self.popped[node]
            node = self.link[node]
        return total


class _Counts(dict):
    """Counts of words, found when first asked for; long words are not kept."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=1)
def _counts(vocabulary: tuple[bytes, ...]) -> _Counts:
    return _Counts(Automaton(list(vocabulary)))


def count_tokens(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """docs with n_words and n_tokens (longs)."""
    tokens = docs.sparkSession.sparkContext.broadcast(tuple(read_ranks(vocabulary or default_path())))
    kept = [c for c in docs.columns if c not in ("n_words", "n_tokens")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _counts(tokens.value)
        for batch in batches:
            n_words, n_tokens = [], []
            for x in batch.column("__text"):
                words = x.as_buffer().to_pybytes().split() if x.is_valid else []
                n_words.append(len(words))
                n_tokens.append(sum(map(counts.__getitem__, words)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=schema.names)

    return docs.withColumn("__text", text_or_empty(text)).select(*kept, "__text").mapInArrow(run, schema)


def token_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"), vocabulary=vocabulary).drop("text")
