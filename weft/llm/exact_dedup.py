"""Exact duplicates by a tree-merge of sorted digest runs.

Every scan partition turns its rows into a run: sorted by digest, equal digests collapsed to one
entry with the row that stays and a count. Runs then meet in binomial rounds: in every round FANIN
neighbouring runs exchange their entries, dealt out by digest so that no task holds a whole run,
and a multiway merge (Spark's external merge sort, then one pass) collapses equal digests again.
After log(runs) rounds one entry is left per text. Results go down the same tree: every level's
entries join the entries above them, so even a text that makes up a third of all rows is met by no
task with more than FANIN entries or one run's rows at once.

A digest is trusted only together with the text's length and an independent 64-bit hash; texts
that agree in one but not in all of them stay apart.

Defined cases: null text equals empty text; of repeated doc_ids with equal text just one row is
kept; a null doc_id stays only if its group has no other; an empty table gives an empty result; texts
are hashed whole, however long; columns of docs other than doc_id and the text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._shared import cut, shuffle_partitions, text_or_empty

FANIN = 16
_KEY = ["digest", "n_bytes", "check"]
_ENTRY = "run int, digest binary, n_bytes int, check bigint, best bigint, best_row bigint, n bigint"


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One entry for every stretch of equal keys; batches come sorted by key, the row that stays first."""
    names = ["run", *_KEY, "best", "best_row", "n"]
    held: pa.RecordBatch | None = None  # the last entry, which the next batch may continue
    for batch in batches:
        table = pa.Table.from_batches([x for x in (held, batch) if x is not None and x.num_rows]).combine_chunks()
        if not table.num_rows:
            continue
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for name in ["run", *_KEY]:
            column = table[name].combine_chunks()
            new[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]))
        first = np.flatnonzero(new)
        total = np.add.reduceat(table["n"].to_numpy(), first)
        # the field as it came: the last entry meets the next batch, whose schema says which columns are never null
        out = table.take(first).set_column(names.index("n"), table.schema.field("n"), pa.array(total))
        if out.num_rows > 1:
            yield from out.slice(0, out.num_rows - 1).to_batches()
        held = out.slice(out.num_rows - 1).combine_chunks().to_batches()[0]
    if held is not None:
        yield held


def _merged(entries: DataFrame) -> DataFrame:
    ordered = entries.sortWithinPartitions("run", *_KEY, F.col("best").desc_nulls_last(), "best_row")
    return ordered.mapInArrow(_collapse, _ENTRY)


def exact_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row: doc_id, digest, keep_id, group_size, kept.

    The row with the largest doc_id stays of each group of equal texts.
    """
    body = text_or_empty(text)
    keyed = docs.select("doc_id", F.unhex(F.sha2(body, 256)).alias("digest"), F.octet_length(body).alias("n_bytes"), F.xxhash64(body).alias("check"), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"))
    keyed = cut(keyed)
    entries = keyed.select("run", *_KEY, F.col("doc_id").alias("best"), F.col("row").alias("best_row"), F.lit(1).cast("long").alias("n"))
    runs = max(1, keyed.rdd.getNumPartitions())
    levels = [cut(_merged(entries))]
    while runs > 1:
        parted = levels[-1].withColumn("run", F.floor(F.col("run") / FANIN).cast("int")).repartition(shuffle_partitions(docs), "run", "digest")
        levels.append(cut(_merged(parted)))
        runs = -(-runs // FANIN)
    above = levels.pop()
    while levels:
        below = levels.pop().select("run", *_KEY).withColumn("up", F.floor(F.col("run") / FANIN).cast("int"))
        above = below.join(above.withColumnRenamed("run", "up"), ["up", *_KEY]).drop("up")
    out = keyed.join(above, ["run", *_KEY])
    return out.select("doc_id", "digest", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best_row")).alias("kept"))


def exact_report(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the rows that stay of each group of equal texts, all columns kept. Rows that repeat
    the doc_id and text of one that stays (null ids too) stay with it."""
    kept = exact_groups(docs, text).where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.unhex(F.sha2(text_or_empty(text), 256)) == F.col("__digest"))
    return docs.join(kept, same, "left_semi")


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
