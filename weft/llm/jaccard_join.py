"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document is the set of its distinct k-word shingles, as 64-bit hashes. Sets are banded by size so
that partners lie in the same or a neighbouring band. In a band, the universe of hashes is cut into
segments, and two sets that are similar enough differ in at most H shingles, so among any segments
with allowances that add up to H + 1 there is one where they differ by less than its allowance: not
at all (allowance 1), or by one shingle at most (allowance 2, met through one-deletion
neighbourhoods of the segment). Every set indexes all segments of its band, and probes its own band
and the one below with the H + 1 cheapest allowances, the cost being the expected number of sets
with the same key: short segments are avoided, and deletions are used in bands of small sets only.

Keys meet by one shuffle of (key, document). A group of g documents leaves g - 1 pairs with its
first document, never all pairs. Of a key that more than HOT documents of one batch have, only the
first of them goes to that shuffle, so no task gathers a hot key; the others learn the key's first
document by a join on (key, first of the batch). Pairs are verified exactly on the shingle hashes of
whole texts. Where that does not connect a whole group, its members are compared in tiles, those
already connected left out (see _groups).

Defined cases: null and empty texts, and texts without words, have no shingles and link with
nothing; a null doc_id links with nothing; rows that repeat a doc_id are separate documents with
one id. Documents with the same set are one class, and only its least doc_id is compared. Very long
texts are read whole; an empty table gives an empty result; other columns aren't read, and stay where
rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm._groups import Alike, connect, ends
from weft.llm._shared import cut, only, shuffle_partitions, text_or_empty
from weft.llm._words import mix, shingles, slabs, words

#: Sets up to this size are indexed with one-deletion neighbourhoods.
SMALL = 48
#: Documents of a batch with one key above which one of them stands for the others.
HOT = 256
#: Shingles of distinct sets for each task that keys meet in, unless there are more shuffle partitions.
PART_SHINGLES = 16_000_000
#: Segments beyond H + 1 that bands of larger sets have, so that short ones can be avoided.
SLACK = 0.08
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Scheme:
    """Bands of sizes and their segments for a threshold of ``percent``."""

    percent: int

    def apart(self, a: int, b: int) -> int:
        """Most shingles by which similar sets of sizes a and b differ."""
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    @lru_cache(maxsize=None)  # noqa: B019  one small object per threshold
    def band(self, n: int) -> int:
        k, low = 0, 1
        while True:
            high = low * 100 // self.percent
            if n <= high:
                return k
            k, low = k + 1, high + 1

    @lru_cache(maxsize=None)  # noqa: B019
    def top(self, band: int) -> int:
        """The largest size in a band."""
        high = 100 // self.percent
        for _ in range(band):
            high = (high + 1) * 100 // self.percent
        return high

    @lru_cache(maxsize=None)  # noqa: B019
    def segments(self, band: int) -> int:
        high = self.top(band)
        most = self.apart(high, high * 100 // self.percent)
        return most + 1 + (0 if high <= SMALL else int(np.ceil(SLACK * most)))


def allowances(counts: np.ndarray, need: int, deletions: bool) -> np.ndarray:
    """0, 1 or 2 for every segment, ``need`` in all, at the least cost.

    A key over c shingles is expected to meet 4**-c as many sets as an empty one; allowance 2 asks
    for c + 1 keys of which the shortest has c - 1 shingles. Costs only grow with the allowance, so
    taking the cheapest steps is the best choice.
    """
    c = counts.astype(np.float64)
    cost = 1e4 * 4.0**-c + 1e-3
    if deletions:
        cost = np.concatenate([cost, np.where(c > 0, (c + 1) * (1e4 * 4.0 ** (1 - c) + 1), np.inf)])
    taken = np.argsort(cost, kind="stable")[:need]
    return np.bincount(taken % len(counts), minlength=len(counts))


def keys_of(values: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a sorted set of hashes, and which of them are probes."""
    n = len(values)
    mixed = mix(values ^ _ODD)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed)])
    own = scheme.band(n)
    keys, probes = [], []
    for band in (own, own - 1):
        high = scheme.top(band) if band >= 0 else 0
        if 100 * high < scheme.percent * n:
            continue
        most = scheme.apart(n, min(high, n * 100 // scheme.percent))
        if most == 0 and (band != own or scheme.apart(n, n * 100 // scheme.percent) == 0):
            continue  # only an equal set is similar, and equal sets are one class
        m = scheme.segments(band)
        segment = ((values >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        bound = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
        tag = mix(np.arange(m, dtype=np.uint64) + np.uint64(band << 32))
        counts, sums = np.diff(bound), total[bound[1:]] - total[bound[:-1]]
        small = high <= SMALL
        allowed = allowances(counts, most + 1 if most else 0, small)
        if band == own:
            keys.append(mix(sums + tag))
            probes.append(allowed > 0)
        else:
            keys.append(mix(sums + tag)[allowed > 0])
            probes.append(np.ones(len(keys[-1]), bool))
        if small:
            at = segment.astype(np.int64)
            less = mix(sums[at] - mixed + tag[at])
            probe = allowed[at] > 1
            less, probe = (less, probe) if band == own else (less[probe], probe[probe])
            keys.append(less)
            probes.append(probe)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(keys), np.concatenate(probes)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted set of shingle hashes) of every text."""
    for row, data, offsets in slabs(column):
        start, _, hashed = words(data, offsets)
        counts = np.bincount(np.searchsorted(offsets, start, "right") - 1, minlength=len(offsets) - 1)
        values, sizes = shingles(hashed, counts, k)
        stop = np.cumsum(sizes)
        for i, (b, n) in enumerate(zip(stop.tolist(), sizes.tolist(), strict=True)):
            yield row + i, np.unique(values[b - n : b])


def _signed(x: np.ndarray | list) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def class_name(s: np.ndarray) -> int:
    return int(np.add.reduce(mix(s)))


def shingle_sets(docs: DataFrame, k: int, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, h1, h2): the size of every document's set and 128 bits that name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, h1, h2 = [], [], []
            for _, s in _sets(batch.column(1), k):
                n.append(len(s))
                h1.append(class_name(s) if len(s) else 0)
                h2.append(int(np.add.reduce(mix(s + _ODD))) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _signed(h1), _signed(h2)], names=["doc_id", "n_shingles", "h1", "h2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("t")).mapInArrow(run, "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint")


_PROBE, _HOT, _BITS = np.uint64(1), np.uint64(2), np.uint64(3)  # low bits of a key as it is shuffled


def _met(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (first document, other) of every key that some document probes, and rows
    (first document, other, key) of those that stand for others of their batch."""
    order = np.lexsort((doc, key & ~_BITS))
    k, d, flags = key[order] & ~_BITS, doc[order], key[order] & _BITS
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    group = np.cumsum(first) - 1
    asked = np.bincount(group, weights=(flags & _PROBE) > 0, minlength=group[-1] + 1 if len(group) else 0) > 0
    lead = d[first][group]
    pairs = np.stack([lead, d], 1)[asked[group] & (lead != d)]
    stands = asked[group] & ((flags & _HOT) > 0)
    return np.unique(pairs, axis=0), np.stack([lead[stands], d[stands], k[stands].view(np.int64)], 1)


def _stand_in(key: np.ndarray, doc: np.ndarray, probe: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys as they are shuffled, which rows are, and for other rows the document that stands for theirs:
    the first of more than ``most`` with a key."""
    key = key & ~_BITS
    order = np.lexsort((doc, key))
    first = np.ones(len(key), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    group = np.cumsum(first) - 1
    size = np.bincount(group, minlength=1)
    asked = np.bincount(group, weights=probe[order], minlength=1) > 0
    hot = (size > most)[group]
    goes = np.ones(len(key), bool)
    goes[order] = first | ~hot
    lead = np.empty_like(doc)
    lead[order] = doc[order][first][group]
    flags = probe.astype(np.uint64)
    flags[order[first & hot]] = _HOT | asked[size > most].astype(np.uint64)
    return key | flags, goes, lead


def candidate_groups(docs: DataFrame, k: int, percent: int, parts: int, text: str = "text") -> DataFrame:
    """Distinct (leader, member): classes of equal sets, by the first 64 bits of their names, that
    share a key, each with the least that shares it."""
    scheme, most = Scheme(percent), HOT

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            keys, probes, owners, held = [], [], [], 0
            for _, s in _sets(batch.column(0), k):
                if not len(s) or (name := class_name(s)) in seen:  # an equal set of this batch speaks for it
                    continue
                seen.add(name)
                a, b = keys_of(s, scheme)
                keys.append(a)
                probes.append(b)
                owners.append(np.full(len(a), np.uint64(name)).view(np.int64))
                held += len(a)
                if held > 1 << 18:
                    yield flush(keys, probes, owners)
                    keys, probes, owners, held = [], [], [], 0
            if held:
                yield flush(keys, probes, owners)

    def flush(keys: list, probes: list, owners: list) -> pa.RecordBatch:
        doc = np.concatenate(owners)
        key, goes, lead = _stand_in(np.concatenate(keys), doc, np.concatenate(probes), most)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(lead, mask=goes)], names=["key", "doc", "lead"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), schema=pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("lead", pa.int64())]))
        stays = held["lead"].combine_chunks()
        other = stays.is_valid().to_numpy(zero_copy_only=False)
        key, doc = held["key"].to_numpy().view(np.uint64), held["doc"].to_numpy()
        pairs, stands = _met(key[~other], doc[~other])
        near = np.stack([stays.filter(pa.array(other)).to_numpy(), doc[other], (key[other] & ~_BITS).view(np.int64)], 1)
        for kind, rows in enumerate((np.c_[pairs, np.zeros(len(pairs), np.int64)], stands, near)):
            if len(rows):
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)), pa.array(np.full(len(rows), kind, np.int32))], names=["leader", "member", "key", "kind"])

    rows = docs.where("doc_id IS NOT NULL").select(text_or_empty(text).alias("t")).mapInArrow(emit, "key bigint, doc bigint, lead bigint")
    spread = F.when(F.col("lead").isNull(), F.shiftrightunsigned("key", 2)).otherwise(F.xxhash64("doc"))
    found = cut(rows.repartition(parts, spread).mapInArrow(meet, "leader bigint, member bigint, key bigint, kind int").distinct())
    stands, near = (found.where(F.col("kind") == kind) for kind in (1, 2))
    through = near.select("key", F.col("leader").alias("stand"), "member").join(stands.select("key", F.col("member").alias("stand"), "leader"), ["key", "stand"])
    return found.where("kind = 0").select("leader", "member").union(through.where("leader != member").select("leader", "member")).distinct()


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have a Jaccard similarity of percent / 100 at least."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def similar_all(sets: list[np.ndarray], percent: int, cells: int = 1 << 23) -> np.ndarray:
    """similar() for all pairs of a list, by products of 0/1 rows over the shared hashes, as many of
    these at a time as make ``cells`` numbers of four bytes."""
    columns = max(64, cells // max(1, len(sets)))
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    often = count[place] > 1
    owner, place = owner[often], column[place[often]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    shared = np.zeros((len(sets), len(sets)), np.float32)  # whole numbers, exact to 2**24 a product
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        b, e = np.searchsorted(place, [low, low + columns])
        rows = np.zeros((len(sets), min(columns, int(column[-1]) + 1 - low)), np.float32)
        rows[owner[b:e], place[b:e] - low] = 1
        shared += rows @ rows.T
    near = np.empty(shared.shape, bool)
    for i in range(len(sets)):
        both = shared[i].astype(np.int64)
        near[i] = 100 * both >= percent * (sizes[i] + sizes - both)
    return near


def _shingled(docs: DataFrame, ids: DataFrame, k: int, text: str) -> DataFrame:
    """(doc, values): the sets of the documents whose id is in ids, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [s.tobytes() for _, s in _sets(batch.column(1), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.binary())], names=["doc", "values"])

    body = docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty(text).alias("t"))
    return only(body, ids, "doc").mapInArrow(run, "doc bigint, values binary")


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    named = cut(shingle_sets(docs, k, text))
    classes = cut(named.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")))
    named = cut(named.join(classes, ["n_shingles", "h1", "h2"], "left").select("doc_id", "n_shingles", "rep"))
    reps = classes.where("rep IS NOT NULL").select(F.col("h1").alias("h"), "rep", F.col("n_shingles").alias("n"))
    parts = max(shuffle_partitions(docs), (classes.agg(F.sum("n_shingles")).first()[0] or 0) // PART_SHINGLES)
    groups = candidate_groups(docs, k, percent, parts, text)
    groups = groups.join(reps.toDF("member", "b", "nb"), "member").join(reps.toDF("leader", "a", "na"), "leader").where("a != b")
    groups = cut(groups.select("a", "b", (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).alias("fit")).distinct())
    sets = cut(_shingled(docs, ends(groups), k, text))
    alike = Alike(lambda one, two: np.array([similar(a, b, percent) for a, b in zip(one, two, strict=True)], bool), lambda sets: similar_all(sets, percent))
    found = connect(groups.select("a", "b"), groups.where("fit").select("a", "b"), sets, alike, listed=False).withColumnRenamed("id", "rep")
    out = named.join(found, "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id"))


def jaccard_report(docs: DataFrame) -> DataFrame:
    return jaccard_groups(docs, k=4, percent=85)


def keep_one_per_group(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """docs without those that another one of their group, with a smaller doc_id, stands for."""
    dropped = jaccard_groups(docs, k, percent, text).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


#: The contract's query in DuckDB: pairs by shared shingles, components by reachability.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0b\f\r]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS grams FROM w),
u AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c FROM u a JOIN u b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared WHERE 100 * c >= 85 * (nx + ny - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM s UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON r.other = b.x)
SELECT s.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
