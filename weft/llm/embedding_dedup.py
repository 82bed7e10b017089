"""Near-duplicate vectors by sorted projection passes.

In every pass a vector's key is the concatenated signs of its products with random directions.
Vectors are ordered lexicographically by key, each is compared with the WINDOW before it, and pairs
that reach the threshold are verified links. Near vectors share the first bits with a good chance,
so over enough passes with fresh directions few links stay unseen; links of all passes are united
to components. How many passes are enough is found from the number of vectors (passes_for). Passes
move vectors in single precision and compare them with SLACK below the threshold.

A window is a cap, so it only decides which vectors are compared further: inside a component all pairs
are then compared in double precision, in tiles of TILE x TILE vectors that give link counts and the
links that connect the tile's vectors, never all pairs. These links make the components that are
returned. Equal vectors are one class with a multiplicity and take up one place in windows and tiles.
Neighbours on both sides of a boundary between sorted partitions are compared too, however few rows a
partition holds.

Recall: a pair at cosine c shares a first bit with probability s = 1 - acos(c) / pi, and about
n / 2^r of n vectors share r first bits, so a pass finds it with probability s^r at least where
2^r = n / WINDOW. Passes are as many as leave a pair at the threshold unseen with a chance of
1 - RECALL, which grows with n to the power 0.22 at 0.9; vectors are moved that many times.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths never link; repeated rows count as vectors of their own; of ties
the smallest vec_id stays; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._components import components, union
from weft.llm._shared import cut, shuffle_partitions

#: PASSES at least, and more where RECALL of a pair at the threshold needs them.
PASSES, BITS, WINDOW, TILE, RECALL = 16, 128, 32, 2048, 0.999
#: How far below the threshold a product in single precision still counts as a candidate.
SLACK = 1e-4
_ROWS = "pass int, key binary, id bigint, vec binary"


@lru_cache(maxsize=128)
def _directions(seed: int, dims: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, BITS))


def unit(values: np.ndarray) -> np.ndarray | None:
    """values as a unit vector in double precision, or None if it has no direction."""
    x = values.astype(np.float64)
    if not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()):
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def passes_for(n: int, threshold: float, window: int = WINDOW) -> int:
    """Passes that find a pair at the threshold among n vectors with a chance of RECALL."""
    shared = (1 - math.acos(min(threshold, 1.0)) / math.pi) ** max(0.0, math.log2(max(n, 1) / window))
    return PASSES if shared >= 1 else max(PASSES, math.ceil(math.log(1 - RECALL) / math.log1p(-shared)))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vecs, names = [], []
        for x in batch.column(1):
            v = None
            if x.is_valid and x.values.null_count == 0:
                v = unit(x.values.to_numpy(zero_copy_only=False))
            vecs.append(None if v is None else v.tobytes())
            names.append(None if v is None else hashlib.blake2b(x.values.to_numpy(zero_copy_only=False).tobytes(), digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vecs, pa.binary()), pa.array(names, pa.binary())], names=["vec_id", "vec", "name"])


def _keys(passes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(1).to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(raw):
                by_size.setdefault(len(x), []).append(i)
            for size, rows in by_size.items():
                vectors = np.frombuffer(b"".join(raw[i] for i in rows), np.float64).reshape(len(rows), -1)
                ids, vecs = batch.column(0).take(pa.array(rows)), pa.array([x.tobytes() for x in vectors.astype(np.float32)], pa.binary())
                for p in range(passes):
                    bits = np.packbits(vectors @ _directions(p, vectors.shape[1]) > 0, axis=1)
                    head = size.to_bytes(4, "big")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), p, np.int32)), pa.array([head + b.tobytes() for b in bits], pa.binary()), ids, vecs], names=["pass", "key", "id", "vec"])

    return run


def near_pairs(run: np.ndarray, ids: np.ndarray, vecs: list[bytes], fresh: int, window: int, threshold: float) -> np.ndarray:
    """Pairs at most ``window`` apart in order, of one run, that may reach the threshold; the later of
    a pair is at ``fresh`` or after."""
    found = []
    sizes = np.array([len(v) for v in vecs])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = np.frombuffer(b"".join(vecs[i] for i in at), np.float32).reshape(len(at), -1)
        for s in range(1, min(window, len(at) - 1) + 1):
            near = (np.einsum("ij,ij->i", x[s:], x[:-s]) >= threshold - SLACK) & (run[at[s:]] == run[at[:-s]]) & (at[s:] >= fresh)
            found.append(np.stack([ids[at[:-s]][near], ids[at[s:]][near]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


_FOUND = "a bigint, b bigint, edge int, place int, pass int, id bigint, vec binary"


def _found(pairs: np.ndarray = np.zeros((0, 2), np.int64), edge: int = 0, place: int = 0, rows: tuple = ()) -> pa.RecordBatch:
    """Verified pairs, or the rows on one side of an edge between sorted partitions: edge k is that
    after partition k."""
    n, m = len(pairs), len(rows)
    ints = lambda x, kind: pa.array([*x], kind)
    none = [None] * n
    return pa.RecordBatch.from_arrays([
        ints([*pairs[:, 0].tolist(), *[None] * m], pa.int64()), ints([*pairs[:, 1].tolist(), *[None] * m], pa.int64()),
        ints([*none, *[edge] * m], pa.int32()), ints([*none, *range(place, place + m)], pa.int32()),
        ints([*none, *(r[0] for r in rows)], pa.int32()), ints([*none, *(r[1] for r in rows)], pa.int64()), pa.array([*none, *(r[2] for r in rows)], pa.binary()),
    ], names=["a", "b", "edge", "place", "pass", "id", "vec"])


def _windows(window: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, first = TaskContext.get().partitionId(), [], []
        for batch in batches:
            rows = list(zip(batch.column("pass").to_pylist(), batch.column("id").to_pylist(), batch.column("vec").to_pylist(), strict=True))
            if len(first) < window:
                first = (first + rows)[:window]
            for at in range(0, len(rows), 4096):
                both = held + rows[at : at + 4096]
                pairs = near_pairs(np.array([r[0] for r in both]), np.array([r[1] for r in both]), [r[2] for r in both], len(held), window, threshold)
                if len(pairs):
                    yield _found(union(pairs))
                held = both[-window:]
        if held:
            yield _found(edge=here, place=0, rows=tuple(held))
            yield _found(edge=here - 1, place=window, rows=tuple(first))

    return run


def _tails(sizes: dict[int, int], window: int) -> list[tuple[int, int]]:
    """(partition, edge) of the partitions that hold the last ``window`` rows before each edge, but
    those that end there. sizes: rows, up to window, of partitions that have any."""
    out, filled = [], sorted(sizes)
    for i, after in enumerate(filled):
        have = sizes.get(after - 1, 0)
        for part in reversed(filled[:i]):
            if have >= window:
                break
            if part != after - 1:
                out.append((part, after - 1))
                have += sizes[part]
    return out


def _across(window: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by("place")
        fresh = int((t["place"].to_numpy() < window).sum())
        pairs = near_pairs(t["pass"].to_numpy(), t["id"].to_numpy(), t["vec"].to_pylist(), fresh, window, threshold)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def _counted(threshold: float):
    """The links of each vector in a tile, and links that connect its vectors as they are."""

    def run(table: pa.Table) -> pa.Table:
        tile, n, ids = table["tile"].to_numpy(), table["n"].to_numpy(), table["id"].to_numpy()
        size = np.array([len(v.as_py()) for v in table["vec"]])
        same = table["i"][0].as_py() == table["j"][0].as_py()
        links, edges = np.zeros(len(ids), np.int64), np.zeros((0, 2), np.int64)
        for s in np.unique(size):
            at = np.flatnonzero(size == s)
            x = np.frombuffer(b"".join(table["vec"][int(i)].as_py() for i in at), np.float64).reshape(len(at), -1)
            for row in range(0, len(at), 512):
                some = np.arange(row, min(row + 512, len(at)))
                near = x[some] @ x.T >= threshold
                near &= some[:, None] != np.arange(len(at))[None, :] if same else tile[at[some]][:, None] != tile[at][None, :]
                links[at[some]] = near @ n[at]
                found = np.argwhere(near)
                if len(found):
                    edges = union(np.concatenate([edges, np.stack([ids[at[some[found[:, 0]]]], ids[at[found[:, 1]]]], 1)]))
        none = pa.nulls(len(ids), pa.int64())
        counts = pa.table({"id": ids, "links": links, "a": none, "b": none})
        none = pa.nulls(len(edges), pa.int64())
        return pa.concat_tables([counts, pa.table({"id": none, "links": none, "a": edges[:, 0], "b": edges[:, 1]})])

    return run


def embedding_groups(vectors: DataFrame, threshold: float = 0.9, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept. passes: those of passes_for unless given."""
    parsed = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_parse, "vec_id bigint, vec binary, name binary"))
    classes = parsed.where("vec IS NOT NULL AND vec_id IS NOT NULL").groupBy("name").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    named = cut(parsed.drop("vec").join(classes, "name", "left").select("vec_id", "rep", "n"))
    reps = parsed.join(classes.select("name", F.col("rep").alias("vec_id"), "n"), ["name", "vec_id"]).dropDuplicates(["vec_id"])
    reps = cut(reps.select(F.col("vec_id").alias("id"), "vec", "n"))
    keyed = reps.select("id", "vec").mapInArrow(_keys(passes or passes_for(reps.count(), threshold, window)), _ROWS)
    ordered = keyed.repartitionByRange(shuffle_partitions(vectors), "pass", "key", "id").sortWithinPartitions("pass", "key", "id")
    found = cut(ordered.mapInArrow(_windows(window, threshold), _FOUND))
    beside = found.where("edge IS NOT NULL")
    tails = beside.where(F.col("place") < window)
    sizes = {r["edge"]: r["count"] for r in tails.groupBy("edge").count().collect()}
    if further := _tails(sizes, window):
        named_edges = F.broadcast(vectors.sparkSession.createDataFrame(further, "edge int, later int"))
        moved = tails.join(named_edges, "edge").withColumn("place", F.col("place") - (F.col("later") - F.col("edge")) * window)
        beside = beside.union(moved.select("a", "b", F.col("later").alias("edge"), "place", "pass", "id", "vec"))
    across = beside.groupBy("edge").applyInArrow(_across(window, threshold), "a bigint, b bigint")
    near = cut(components(found.where("a IS NOT NULL").select("a", "b").union(across)))
    members = near.union(near.select(F.col("component").alias("id"), "component").distinct()).join(reps, "id")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("g"))
    tiled = members.join(sizes, "component").withColumn("tiles", F.ceil(F.col("g") / TILE).cast("int"))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select("component", "id", "vec", "n", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    compared = cut(tiled.groupBy("component", "i", "j").applyInArrow(_counted(threshold), "id bigint, links bigint, a bigint, b bigint"))
    label = components(compared.where("a IS NOT NULL").select("a", "b"))
    links = compared.where("id IS NOT NULL").groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links")).join(label.withColumnRenamed("id", "rep"), "rep", "left")
    out = named.join(links, "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


#: All pairs in DuckDB.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.other = l.x),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x) USING (vec_id)
"""
