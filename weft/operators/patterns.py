"""Many patterns in one pass over texts: an Aho-Corasick automaton over all of them is broadcast.

A text is read once whatever the number of patterns, so the cost of a scan is that of the texts and of what
is found. Patterns are counted, with their characters, before they are broadcast; more than MOST of
either are taken in blocks of bounded size, one pass a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns of a block, and characters of them (an automaton has a node of about 50 bytes a character).
MOST, MOST_CHARS = 200_000, 4 << 20
#: Texts of a batch that are Python strings at once, with what is found in them.
ROWS = 256


class Automaton:
    """Built in each worker when it is first used, from the list that is broadcast."""

    def __init__(self, patterns: list[str]) -> None:
        self.patterns, self._made = patterns, None

    def __getstate__(self) -> list[str]:
        return self.patterns

    def __setstate__(self, patterns: list[str]) -> None:
        self.patterns, self._made = patterns, None

    def found(self, text: str) -> set[int]:
        """The places of the patterns that a text holds."""
        if self._made is None:
            self._made = ahocorasick.Automaton()
            for i, p in enumerate(self.patterns):
                self._made.add_word(p, i)
            self._made.make_automaton()
        return {i for _, i in self._made.iter(text)} if self.patterns else set()


def _scan(shared, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                rows, hits = [], []
                for row, text in enumerate(batch.column("__text").to_pylist()):
                    found = automaton.found(text) if text else ()
                    rows += [row] * len(found)
                    hits += [automaton.patterns[i] for i in found]
                at = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array(hits, pa.string())], names=[*keys, "pattern"])

    return run


def occurrences(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str = "text", pattern: str = "pattern") -> DataFrame:
    """(*keys, pattern): which patterns each row's text holds as substrings, once each. Null and empty ones are
    held by none. Where patterns are many, rows are read once a block of them."""
    wanted = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("pattern")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["n"] // MOST), -(-size["chars"] // MOST_CHARS))
    body = texts.select(*keys, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*(body.schema[k] for k in keys), T.StructField("pattern", T.StringType())])
    out = None
    for i in range(blocks):
        some = [r["pattern"] for r in wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == i).collect()]  # a block is bounded
        one = body.mapInArrow(_scan(texts.sparkSession.sparkContext.broadcast(Automaton(some)), keys), schema)
        out = one if out is None else out.unionByName(one)
    return out
