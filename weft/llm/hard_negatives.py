"""Hard negatives by inverted lists: exact searches that visit lists by upper bound.

Every vector is in the list of its nearest centroid (k-means fitted on at most FIT vectors; every row
is indexed), and a list has a radius, rounded up: no member is farther from the centroid m. The product
of an anchor a with any member is then within a·m ± |a| radius (Cauchy-Schwarz). A search wants the
first members with a product between lo and hi. It visits lists by falling upper bound, skips those
whose range is outside [lo, hi], and stops at the first bound strictly below its kth score; equal
bounds are visited, as ties go to the smaller vec_id. Bounds only decide what is visited: scores are
exact integers, and so are the results.

An anchor's positives are one search (its label), its negatives one for each positive (other labels,
window [0.8 s, s]). Each search is two Spark passes: the lists with the highest bounds, up to
FIRST members, which give kth scores, then all lists that these leave. A pass sends anchors to the
lists they visit; a task compares a part of a list (PART members) with a chunk of anchors (CHUNK, of
neighbouring lists) by a matrix product and returns the first few of each search. Lists are
repeated for every chunk that visits them, anchors for every list they visit; never listed are pairs.

Defined cases: rows with a null vec_id, label or vector, and vectors with null, non-finite or
out-of-range components (past 2**19), take no part; of rows that repeat a vec_id the least (label,
length, components as bytes) counts; vectors of different lengths have no product (those of the rarer lengths are in
lists that are always visited); an anchor without positives, and a positive without
negatives in its window, give no rows; a negative or zero positive score makes a window that is empty
or holds 0 only; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm._shared import discard, scratch, written
from weft.llm._vectors import packed, products, quantised, unpacked

#: Vectors that k-means is fitted on, its rounds, and the most lists.
FIT, ROUNDS, LISTS = 16_384, 6, 1024
#: Further lists, for vectors of other lengths than the commonest.
OTHERS = 16
#: Members compared in one task at a time, anchors that meet them, members a search visits at first.
PART, CHUNK, FIRST = 1024, 512, 2048
_LEAST, _MOST = -(2**63), 2**63 - 1


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, q in quantised(batch.column("embedding")):
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), pa.array(np.full(len(rows), q.shape[1], np.int32)), packed(q)], names=["vec_id", "label", "dims", "q"])


def fit(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k centroids of the rows of x, from distinct rows."""
    if not len(x):
        return np.zeros((0, x.shape[1]))
    x = np.unique(x.astype(np.float64), axis=0)
    at = x[np.random.default_rng(0).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = ((at * at).sum(1) - 2 * x @ at.T).argmin(1)
        count = np.bincount(near, minlength=len(at))
        total = np.stack([np.bincount(near, weights=c, minlength=len(at)) for c in x.T], 1)
        at = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], at)
    return at


@dataclass(frozen=True)
class Index:
    """Centroids of the lists, and by list (others behind) radius, members and anchors before it."""

    centroids: np.ndarray
    radius: np.ndarray
    members: np.ndarray
    before: np.ndarray
    first: int = FIRST
    per_chunk: int = CHUNK

    def ranges(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the products of q with the members of every list, rounded outwards."""
        dims, n = self.centroids.shape[1], len(self.centroids)
        low, high = np.full(len(self.radius), np.inf), np.full(len(self.radius), -np.inf)  # nothing to find
        if len(q) == dims:
            x, size = q.astype(np.float64), np.sqrt(np.square(q, dtype=np.float64).sum())
            middle, most = self.centroids @ x, size * self.radius[:n]
            slack = 1e-9 * (np.abs(middle) + most + size * np.sqrt((self.centroids**2).sum(1))) + 1e-6
            low[:n], high[:n] = middle - most - slack, middle + most + slack
        else:
            low[n + len(q) % OTHERS], high[n + len(q) % OTHERS] = -np.inf, np.inf
        there = self.members > 0
        return np.where(there, low, np.inf), np.where(there, high, -np.inf)

    def chunk(self, home: int, vec_id: int) -> int:
        """Anchors of neighbouring lists are in one chunk."""
        mine = int(self.before[home + 1] - self.before[home])
        return int(self.before[home] + vec_id // 100 % max(mine, 1)) // self.per_chunk


def visited(low: np.ndarray, high: np.ndarray, members: np.ndarray, lo: int, hi: int, kth: int | None, first: bool, most: int = FIRST) -> np.ndarray:
    """The lists that a search visits at first, until they have ``most`` members, or all the others that it has to."""
    fits = np.flatnonzero((high >= lo) & (low <= hi))
    fits = fits[np.argsort(-high[fits], kind="stable")]
    n = int(np.searchsorted(np.cumsum(members[fits]), most)) + 1
    if first:
        return fits[:n]
    rest = fits[n:]
    return rest if kth is None else rest[high[rest] >= kth]


def _listed(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, k = centroids.shape[1], len(centroids)
        square = (centroids**2).sum(1)
        for batch in batches:
            size = batch.column("dims").to_numpy()
            home, away = k + size % OTHERS, np.zeros(len(size))
            at = np.flatnonzero(size == dims)
            if len(at) and k:
                x = unpacked(batch.column("q").take(pa.array(at)), dims).astype(np.float64)
                home[at] = near = (square - 2 * x @ centroids.T).argmin(1)
                away[at] = np.sqrt(((x - centroids[near]) ** 2).sum(1)) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "list", "away"])

    return run


#: A search of an anchor for each entry of lo, hi and kth; same: of its own label or of others.
_VISIT = "list int, chunk int, vec_id bigint, label int, dims int, q binary, lo array<bigint>, hi array<bigint>"


def _visits(shared, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                one = {c: batch.column(c)[row].as_py() for c in ("vec_id", "dims", "q", "list", "lo", "hi", "kth")}
                low, high = index.ranges(np.frombuffer(one["q"], np.int32))
                searches = list(zip(one["lo"], one["hi"], one["kth"], strict=True))
                lists = np.unique(np.concatenate([np.zeros(0, np.int64), *(visited(low, high, index.members, *x, True, index.first) for x in searches)]))
                if not first:  # a list that was visited at first was compared with all searches of the anchor
                    rest = np.unique(np.concatenate([np.zeros(0, np.int64), *(visited(low, high, index.members, *x, False, index.first) for x in searches)]))
                    lists = np.setdiff1d(rest, lists)
                if n := len(lists):
                    same = batch.slice(row, 1).select(["vec_id", "label", "dims", "q", "lo", "hi"]).to_struct_array().take(pa.array(np.zeros(n, np.int32))).flatten()
                    yield pa.RecordBatch.from_arrays([pa.array(lists.astype(np.int32)), pa.array(np.full(n, index.chunk(one["list"], one["vec_id"]), np.int32)), *same], names=[c.split()[0] for c in _VISIT.split(", ")])

    return run


def best(score: np.ndarray, label: np.ndarray, mine: int, same: bool, lo: list[int], hi: list[int], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(search, places of its first k) among members that are in order of vec_id."""
    at = np.flatnonzero((label == mine) == same)
    at = at[np.argsort(-score[at], kind="stable")]
    falling = -score[at]
    for i, (low, high) in enumerate(zip(lo, hi, strict=True)):
        begin = 0 if high == _MOST else int(np.searchsorted(falling, -high, "left"))
        some = at[begin : begin + k]
        if len(some := some[score[some] >= low]):
            yield i, some


def _compared(same: bool, k: int):
    def run(members: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor": [], "search": [], "vec_id": [], "score": []}
        members = members.sort_by("vec_id")
        for dims in np.unique(anchors["dims"].to_numpy()) if members.num_rows else ():
            m, a = (t.filter(pa.array(t["dims"].to_numpy() == dims)) for t in (members, anchors))
            if not m.num_rows:
                continue
            ids, label, them = m["vec_id"].to_numpy(), m["label"].to_numpy(), unpacked(m["q"], dims)
            for at in range(0, a.num_rows, 256):
                some = a.slice(at, 256)
                scores = products(unpacked(some["q"], dims), them)
                for vec_id, mine, lo, hi, score in zip(some["vec_id"].to_pylist(), some["label"].to_pylist(), some["lo"].to_pylist(), some["hi"].to_pylist(), scores, strict=True):
                    other = slice(None)
                    if same and (at_self := np.searchsorted(ids, vec_id)) < len(ids) and ids[at_self] == vec_id:
                        other = np.delete(np.arange(len(ids)), at_self)
                    ids_, label_, score_ = ids[other], label[other], score[other]
                    for i, places in best(score_, label_, mine, same, lo, hi, k):
                        n = len(places)
                        out["anchor"].append(np.full(n, vec_id))
                        out["search"].append(np.full(n, i))
                        out["vec_id"].append(ids_[places])
                        out["score"].append(score_[places])
        return pa.table({c: np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for c, x in out.items()})

    return run


_FOUND = "anchor bigint, search bigint, vec_id bigint, score bigint"


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "search").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(lists: DataFrame, searches: DataFrame, shared, same: bool, k: int, path: str) -> DataFrame:
    """The first k of every search: _FOUND and rank."""

    def visit(wanted: DataFrame, first: bool) -> DataFrame:
        visits = wanted.mapInArrow(_visits(shared, first), _VISIT)
        pairs = visits.select("list", "chunk").distinct()
        parts = lists.select("list", "part").distinct()
        members = lists.select("list", "part", "vec_id", "label", "dims", "q").join(pairs, "list")
        anchors = visits.join(parts, "list").withColumnsRenamed({c: f"to_{c}" for c in ("list", "part", "chunk")})
        return members.groupBy("list", "part", "chunk").cogroup(anchors.groupBy("to_list", "to_part", "to_chunk")).applyInArrow(_compared(same, k), _FOUND)

    soon = written(_first(visit(searches.withColumn("kth", F.transform("lo", lambda _: F.lit(None).cast("long"))), True), k), f"{path}-first")
    kth = soon.where(F.col("rank") == k).groupBy(F.col("anchor").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("search", "score"))).alias("kths"))
    known = searches.join(kth, "vec_id", "left").withColumn("kth", F.transform("lo", lambda _, i: F.try_element_at("kths", i.cast("long"))))
    return written(_first(soon.drop("rank").union(visit(known.drop("kths"), False)), k), path)


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = 80, fit_rows: int = FIT, lists: int | None = None) -> DataFrame:
    """Per anchor (vec_id divisible by 100), positive and negative: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score. vectors: vec_id, embedding, label."""
    spark = vectors.sparkSession
    with scratch(spark, "negatives") as folder:
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding").where("vec_id IS NOT NULL AND label IS NOT NULL")
        rows = written(rows.mapInArrow(_parse, "vec_id bigint, label int, dims int, q binary"), f"{folder}/rows")
        if not rows.groupBy("vec_id").count().where("count > 1").isEmpty():
            rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "dims", "q")).alias("r")).select("vec_id", "r.*")
        rows = rows.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
        sizes = rows.groupBy("dims").count()
        total = sizes.agg(F.sum("count")).first()[0] or 0
        dims = getattr(sizes.orderBy(F.desc("count"), "dims").first(), "dims", 0)
        of = 1 << 30
        share = min(of, int(1.2 * of * fit_rows / max(total, 1)) + 1)
        sample = rows.where((F.col("dims") == dims) & (F.pmod(F.xxhash64("vec_id"), F.lit(of)) < share)).select("q").limit(fit_rows).toArrow()
        centroids = fit(unpacked(sample["q"], dims), lists or int(np.clip(np.sqrt(total) / 2, 1, LISTS)))
        indexed = rows.mapInArrow(_listed(centroids), "vec_id bigint, label int, dims int, q binary, list int, away double")
        indexed = written(indexed, f"{folder}/index")
        discard(spark, f"{folder}/rows")
        anchor = F.col("vec_id") % 100 == 0
        n = len(centroids) + OTHERS
        radius, members, before = np.zeros(n), np.zeros(n, np.int64), np.zeros(n + 1, np.int64)
        for r in indexed.groupBy("list").agg(F.max("away").alias("r"), F.count(F.lit(1)).alias("n"), F.count_if(anchor).alias("a")).collect():  # n rows at most
            radius[r["list"]], members[r["list"]], before[r["list"] + 1] = r["r"], r["n"], r["a"]
        shared = spark.sparkContext.broadcast(Index(centroids, radius, members, np.cumsum(before), FIRST, CHUNK))
        parts = F.lit(0) if members.max(initial=0) <= PART else F.ceil(F.element_at(F.lit(members.tolist()), F.col("list") + 1) / PART).cast("int")
        inverted = indexed.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.greatest(parts, F.lit(1))).cast("int"))
        anchors = indexed.where(anchor).select("vec_id", "label", "dims", "list", "q")
        every = anchors.withColumns({"lo": F.array(F.lit(_LEAST)), "hi": F.array(F.lit(_MOST))})
        near = _searched(inverted, every, shared, True, positives, f"{folder}/positives")
        windows = near.groupBy(F.col("anchor").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s"))
        lo = lambda s: F.ceil(s["score"] * percent / F.lit(100).cast("decimal(3,0)")).cast("long")
        wanted = anchors.join(windows, "vec_id").withColumns({"lo": F.transform("s", lo), "hi": F.transform("s", lambda s: s["score"])}).drop("s")
        found = _searched(inverted, wanted, shared, False, negatives, f"{folder}/negatives")
    chosen = near.select("anchor", (F.col("rank") - 1).cast("long").alias("search"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(chosen, ["anchor", "search"]).select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


NEGATIVES_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label AS mine, b.vec_id, b.label, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = mine QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> mine AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
"""
