"""Clusters around centroids, by Elkan's bounds, in exact integers.

Every vector keeps its cluster, an upper bound of the distance from its centroid and a lower bound of
that from each of the k centroids. When centroids move, bounds move as far; a vector whose upper bound
is below half the distance of its centroid from any other stays without a calculation, and otherwise
only centroids are measured that its bounds and the distances between centroids leave possible.
Upper bounds are rounded up and lower ones down, and a centroid is ruled out only if it is strictly
farther, so ties are always measured; what is measured is exact.

Vectors and bounds are a Parquet table that every round reads and writes anew, without a shuffle. Of a
round only sums of components by cluster leave the tasks (k rows a task, added up in SUMS tasks);
centroids are k rows on the driver and in a broadcast. Two states are on disk at a time.

Defined cases: vectors that are null, of another length than ``dims``, or hold null, non-finite or
out-of-range components (past 2**19, where squared distances no longer fit a long) are left out; with
fewer than k vectors there are as many centroids; equal hashes at the start (repeated vec_ids) are
taken by components, null vec_ids last; repeated rows count each; of ties the smaller number wins; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._shared import discard, scratch, written
from weft.llm._vectors import distances, packed, quantised, unpacked

K, ROUNDS, DIMS, SEED = 40, 5, 64, "2"
#: Tasks that add up the sums of others.
SUMS = 16
_UP, _DOWN = 1 + 2.0**-20, 1 - 2.0**-20
#: sums is null but in the last row of a task: counts and sums of components by cluster.
_STATE = "vec_id bigint, q binary, cluster int, upper double, lower binary, distance bigint, sums binary"


def _parsed(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, q in quantised(batch.column(1)):
                if q.shape[1] == dims:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), packed(q)], names=["vec_id", "q"])

    return run


class Bounds:
    """What a round knows of its centroids: distances between them, halved, and how far each moved."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None) -> None:
        self.at = centroids
        self.half = np.sqrt(distances(centroids, centroids)) * (_DOWN / 2)
        np.fill_diagonal(self.half, np.inf)
        self.alone = self.half.min(1)
        self.moved = None if before is None else np.sqrt(((centroids - before) ** 2).sum(1)) * _UP

    def first(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Cluster, upper and lower bounds of vectors, all distances measured; and how many were."""
        d = distances(q, self.at)
        cluster = d.argmin(1)
        return cluster, np.sqrt(d[np.arange(len(q)), cluster]) * _UP, (np.sqrt(d) * _DOWN).astype(np.float32), d.size

    def again(self, q: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same from those before the centroids moved."""
        cluster, upper = cluster.copy(), (upper + self.moved[cluster]) * _UP
        lower = np.maximum((lower - self.moved) * _DOWN, 0)
        rows = np.flatnonzero(upper >= self.alone[cluster])
        own = cluster[rows]
        exact = ((q[rows] - self.at[own]) ** 2).sum(1)
        upper[rows] = np.sqrt(exact) * _UP
        lower[rows, own] = np.sqrt(exact) * _DOWN
        open_ = (upper[rows, None] >= lower[rows]) & (upper[rows, None] >= self.half[own])
        open_[np.arange(len(rows)), own] = False
        r, j = np.nonzero(open_)
        measured = np.full((len(rows), len(self.at)), np.iinfo(np.int64).max)
        measured[np.arange(len(rows)), own] = exact
        for at in range(0, len(r), 1 << 14):
            some = slice(at, at + (1 << 14))
            measured[r[some], j[some]] = ((q[rows[r[some]]] - self.at[j[some]]) ** 2).sum(1)
        lower[rows[r], j] = np.sqrt(measured[r, j]) * _DOWN
        cluster[rows] = measured.argmin(1)  # of ties the first
        upper[rows] = np.sqrt(measured.min(1, initial=np.iinfo(np.int64).max)) * _UP
        return cluster, upper, (lower * _DOWN).astype(np.float32), len(rows) + len(r)


def _assigned(shared, dims: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: Bounds = shared.value
        k = len(bounds.at)
        sums = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                q = unpacked(some.column("q"), dims)
                if bounds.moved is None:
                    cluster, upper, lower, _ = bounds.first(q)
                else:
                    before = np.frombuffer(b"".join(x.as_py() for x in some.column("lower")), np.float32).reshape(len(q), k)
                    cluster, upper, lower, _ = bounds.again(q, some.column("cluster").to_numpy().astype(np.int64), some.column("upper").to_numpy(), before)
                for j in np.unique(cluster):
                    mine = q[cluster == j]
                    sums[j] += np.r_[len(mine), mine.sum(0)]
                n = len(q)
                distance = pa.array(((q - bounds.at[cluster]) ** 2).sum(1)) if last else pa.nulls(n, pa.int64())
                kept = [pa.nulls(n, pa.binary())] * 2 if last else [some.column("q"), pa.array([x.tobytes() for x in lower], pa.binary())]
                yield _state([some.column("vec_id"), kept[0], pa.array(cluster.astype(np.int32)), pa.array(upper), kept[1], distance, pa.nulls(n, pa.binary())])
        if not last and sums[:, 0].any():
            yield _state([*(pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.int32(), pa.float64(), pa.binary(), pa.int64())), pa.array([sums.tobytes()], pa.binary())])

    return run


def _state(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _STATE.split(", ")])


def _total(column: pa.Array | pa.ChunkedArray, total: np.ndarray) -> np.ndarray:
    for x in column:
        total = total + np.frombuffer(x.as_py(), np.int64).reshape(total.shape)
    return total


def _added(shape: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            total = _total(batch.column(0), total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return run


def moved(centroids: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The floored means of clusters; centroids of empty ones stay. sums: counts, then components."""
    count = sums[:, :1]
    return np.where(count > 0, np.floor_divide(sums[:, 1:], np.maximum(count, 1)), centroids)


def cluster_vectors(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: str = SEED) -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Centroids start as the k vectors with the smallest sha256 of ``seed``:vec_id, in that order.
    """
    spark = vectors.sparkSession
    with scratch(spark, "clusters") as folder:
        kept = written(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_parsed(dims), "vec_id bigint, q binary"), f"{folder}/vectors")
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
        chosen = kept.orderBy(order.asc_nulls_last(), "q").limit(k).toArrow()
        centroids = unpacked(chosen["q"], dims)
        state, before = kept, None
        for i in range(rounds + 1 if len(centroids) else 0):
            last = i == rounds
            shared = spark.sparkContext.broadcast(Bounds(centroids, before))
            old, state = state, written(state.where("sums IS NULL" if i else "true").mapInArrow(_assigned(shared, dims, last), _STATE), f"{folder}/{i}")
            discard(spark, f"{folder}/{i - 1}" if i else f"{folder}/vectors")
            shared.unpersist()
            if not last:
                sums = state.where("sums IS NOT NULL").select("sums").repartition(SUMS).mapInArrow(_added((len(centroids), dims + 1)), "sums binary").toArrow()
                centroids, before = moved(centroids, _total(sums["sums"], np.zeros((len(centroids), dims + 1), np.int64))), centroids
    if not len(centroids):
        return kept.selectExpr("vec_id", "0 AS cluster", *(f"0L AS {c}" for c in ("distance", "cluster_inertia", "inertia")), "'' AS centroid_sha256")
    by_cluster = {r["cluster"]: r["d"] for r in state.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows at most
    total = sum(by_cluster.values())
    rows = [(j, d, total, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, d in by_cluster.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: str = SEED) -> str:
    """The same in DuckDB, a round after the other, all distances measured."""
    nearest = """a{i} AS MATERIALIZED (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
      SELECT vec_id, c, list_sum(list_transform(range(1, {n}), lambda j: (v.q[j] - m.q[j]) * (v.q[j] - m.q[j]))) AS d FROM v, c{i} m) GROUP BY vec_id)"""
    means = """c{j} AS MATERIALIZED (SELECT c{i}.c, coalesce(s.q, c{i}.q) AS q FROM c{i} LEFT JOIN (SELECT c, list(m ORDER BY p) AS q FROM (
      SELECT c, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS m FROM (SELECT c, unnest(range(1, {n})) AS p, unnest(q) AS x FROM v JOIN a{i} USING (vec_id)) GROUP BY c, p) GROUP BY c) s ON s.c = c{i}.c)"""
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
      WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, q FROM v ORDER BY sha256('{seed}:' || vec_id) LIMIT {k})",
    ]
    for i in range(rounds):
        parts += [nearest.format(i=i, n=dims + 1), means.format(i=i, j=i + 1, n=dims + 1)]
    parts.append(nearest.format(i=rounds, n=dims + 1))
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} m ON a.c = m.c"""


CLUSTERS_SQL = _sql()
