"""Shards of near-equal bytes for indivisible groups, by Karmarkar-Karp differencing.

A group is all rows with one text. Differencing starts from partial partitions that hold one group
each and repeatedly combines the two of largest spread, the heaviest part of one with the lightest
of the other. One task can't hold all groups, so it works up a tree: groups are dealt into buckets
of about BUCKET, and differencing makes PARTS bundles of near-equal bytes of every bucket; bundles
are the groups of the next level, until ROOT of them or fewer are left, which one task divides into
the shards. The root's size is bounded, whatever the data, and a group larger than a shard's share
ends up with little else beside it.

Rows are numbered within shards without gathering a shard: rows are counted by shard and chunk (a
range of hashes), and a row's slot is the total of the chunks before plus its rank in its own.

Up to ROOT groups differencing is done in one piece; above it every level's bundles are as equal as
differencing gets them, and the root again divides them by differencing, so shards stay about as equal
(a test compares both ways).

Defined cases: null text counts as no bytes and groups with empty text; a row's size is its bytes
plus OVERHEAD; repeated rows get slots of their own, ties by checksum and size; very long texts are
groups like others; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._shared import cut, text_or_empty

SHARDS, OVERHEAD = 40, 16
BUCKET, PARTS, ROOT = 8192, 512, 1 << 16
CHUNK_ROWS, LEAST_CHUNKS = 20_000, 8


def differencing(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part of every size, the parts' totals as equal as differencing gets them."""
    n = len(sizes)
    if n == 0:
        return np.zeros(0, np.int64)
    totals: list = [None] * (2 * n - 1)
    made: list = [None] * (2 * n - 1)
    for i, x in enumerate(sizes.tolist()):
        totals[i] = np.zeros(parts, np.int64)
        totals[i][0] = x
    heap = [(-x, i) for i, x in enumerate(sizes.tolist())] if parts > 1 else [(0, i) for i in range(n)]
    heapq.heapify(heap)
    for new in range(n, 2 * n - 1):
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        raw = totals[a] + totals[b][::-1]
        order = np.argsort(-raw, kind="stable")
        totals[new], made[new] = raw[order], (a, b, order)
        totals[a] = totals[b] = None
        heapq.heappush(heap, (int(totals[new][-1] - totals[new][0]), new))
    names: list = [None] * (2 * n - 1)
    names[-1] = np.arange(parts)
    out = np.zeros(n, np.int64)
    for node in range(2 * n - 2, -1, -1):
        if node < n:
            out[node] = names[node][0]
        else:
            a, b, order = made[node]
            place = np.empty(parts, np.int64)
            place[order] = names[node]
            names[a], names[b] = place, place[::-1]
        names[node] = None
    return out


def _divide(parts: int):
    def run(table: pa.Table) -> pa.Table:
        item, size = table["item"].combine_chunks(), table["size"].to_numpy()
        order = np.array(sorted(range(len(size)), key=lambda i: (-size[i], item[i].as_py())))
        part = np.empty(len(size), np.int64)
        part[order] = differencing(size[order], parts)
        bucket = table["bucket"].to_numpy()
        return pa.table({"item": item, "size": size, "part": bucket * parts + part})

    return run


def divide(groups: DataFrame, shards: int) -> DataFrame:
    """(item, part): the shard of each row of groups (item binary, size long), whole items only."""
    levels = []
    items = groups.select("item", "size")
    n = items.count()
    while n > ROOT:
        buckets = -(-n // BUCKET)
        dealt = items.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(buckets)))
        levels.append(cut(dealt.groupBy("bucket").applyInArrow(_divide(PARTS), "item binary, size bigint, part bigint")))
        bundles = levels[-1].groupBy("part").agg(F.sum("size").alias("size"))
        items = cut(bundles.select(F.encode(F.col("part").cast("string"), "UTF-8").alias("item"), "size"))
        n = items.count()
    top = items.withColumn("bucket", F.lit(0).cast("long")).groupBy("bucket").applyInArrow(_divide(shards), "item binary, size bigint, part bigint")
    top = cut(top).select("item", "part")
    for level in reversed(levels):
        named = level.select("item", F.encode(F.col("part").cast("string"), "UTF-8").alias("bundle"))
        top = named.join(top.withColumnRenamed("item", "bundle"), "bundle").select("item", "part")
    return top


def assign_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot."""
    body = text_or_empty(text)
    base = docs.select("doc_id", (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(body, 256)).alias("item"))
    base = cut(base)
    groups = cut(base.groupBy("item").agg(F.sum("size").alias("size")))
    placed = cut(base.join(divide(groups, shards), "item").withColumn("shard", F.col("part").cast("int")).select("doc_id", "size", "text_crc32", "shard"))
    chunks = max(LEAST_CHUNKS, -(-placed.count() // (shards * CHUNK_ROWS)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "text_crc32", "size"))
    ranked = placed.withColumn("rank", rank).join(starts, ["shard", "chunk"])
    return ranked.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot"))


def shard_report(docs: DataFrame) -> DataFrame:
    out = assign_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, text: str = "text") -> None:
    """docs as Parquet, one folder per shard, rows by slot; needs unique doc_ids.

    Files of a shard are split by ranges of slots, so no task writes a whole shard.
    """
    placed = docs.join(assign_shards(docs, shards, text).select("doc_id", "shard", "slot"), "doc_id")
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
