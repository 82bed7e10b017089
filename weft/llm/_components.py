"""Connected components of a graph given as edges, by alternating star contractions.

Edges are kept as (u, v) with u > v. A large star hangs every u on the least neighbour of its v, a
small star hangs the smaller neighbours of every u on the least of them. Rounds go on until nothing
changes, which leaves every node beside the least id it can reach. Each round is two aggregations
and two joins over edges; edges are first thinned to a spanning forest within each partition, so
what is shuffled is bounded by the nodes a partition holds. No group is gathered anywhere: a node
with a great many neighbours only meets their minimum, and joins on it may be split by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._shared import cut, shuffle_partitions


def union(pairs: np.ndarray) -> np.ndarray:
    """(n, 2) pairs as rows (node, least node it is connected with), for nodes that are not least."""
    nodes, flat = np.unique(pairs, return_inverse=True)
    left, right = flat.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[moved], nodes[label[moved]]], 1)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros((0, 2), np.int64)
    for batch in batches:
        if batch.num_rows:
            held = union(np.concatenate([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)]))
    if len(held):
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0]), pa.array(held[:, 1])], names=["u", "v"])


def _round(e: DataFrame) -> DataFrame:
    least = e.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))
    e = e.join(least, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in an edge that is not the least of its component.

    Edges with a null end or two equal ends count for nothing.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    e = cut(e.mapInArrow(_forest, "u bigint, v bigint").repartition(shuffle_partitions(edges), "u").mapInArrow(_forest, "u bigint, v bigint"))
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state or not now["n"]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state, e = now, cut(_round(e))
