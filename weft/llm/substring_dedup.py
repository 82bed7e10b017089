"""Repeated passages by recompression.

A text is a string of words. Recompression names its runs of equal words, and then, round by round, pairs
of neighbours: a name's hash puts it on the left or the right side for that round, and a left one followed
by a right one becomes a pair. Names are hashes of what they name, so equal words get equal names in every
task, and a pair is formed or not whatever stands around it: of an occurrence of a passage only the
outermost name at either end can be drawn into a pair with its surroundings in a round. Popping those
(a leading right name, a trailing left name, the outer runs) leaves the names that every occurrence has.
A pair has at most ``longest`` words, so that passages of ``window`` words keep some.

So every window has an anchor, the longest name (of ties the least hash, then the first) that is left in it
in the last round that leaves any: equal windows have equal anchors at equal places. Consecutive windows
of one anchor are a segment, about one for seven words, and what is exchanged is a segment: its
anchor's name, a hash of all its words, and hashes of a few words at either side of the anchor.

1. Segments meet by name. Those with all words equal to an earlier one's are repeated. A name that is
   left with one kind of segment is done with. Where it has several, these are the ends of a
   passage, or chance: segments that share the words at a side with another are asked for their windows
   (a window has at least that many words at one of the sides). Asking for more changes no result.
2. Those windows are hashed to 128 bits and meet; all but the first of equal ones are repeated.

The words that repeated windows cover go. Nothing is left out: an equal window is in an equal segment, or
in two that share a side. Windows of at most two runs keep no name and are segments by themselves.
Equality is trusted to 100 bits of hashes and more.

Scale: about 26 bytes a segment are shuffled (a third of the text). Tasks keep one of equal segments of a
batch, so a passage that is in every document meets itself once a batch. Of a name with more than COMMON
different segments in a batch only a mark is sent, and the windows of all its segments, here and wherever the
mark is met, are asked for; so are those of a part of the names that has more segments than ROOM. No
task thus gathers a hot name; what is asked for meets in sums that are combined within tasks first. Text moves twice, and only that of documents with windows asked for, and with words
to remove.

Defined cases: null text has no words and stays null; an empty table gives an empty result; texts are taken
whole, however long; of equal windows the one with the least (doc_id, start) stays. Rows that repeat a doc_id,
and rows without one (after all others), are documents of their own in the order of a hash of their
texts; columns of docs other than doc_id and the text aren't read by the report, and ``drop_repeated_passages``
keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._shared import BROADCAST_IDS, discard, scratch, shuffle_partitions, written
from weft.llm._words import SLAB, mix, slabs, words

WINDOW, ROUNDS = 20, 4
#: Segments of a batch that are compared within the task at a time, parts of the names for every shuffle
#: partition, and segments of a part that are held at a time.
HELD, PARTS, ROOM = 250_000, 8, 2_000_000
#: Different segments of one name in a batch from which on it is common, and the number of windows of a
#: segment that says so.
COMMON, MARK = 64, 255
_U = np.uint64
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
_SALTS = (_U(0), _U(0x9E3779B97F4A7C15))
_BITS = np.array([0, 8, 16, 24, 32], _U)


def longest(window: int) -> int:
    """Words of the longest pair; at each side of it a window has (window - longest) // 2 at least, or more
    at the other."""
    return max(1, 2 * window // 5)


class Passages:
    """Hashes of any words in a row: of those from start, n of them."""

    def __init__(self, hashed: np.ndarray, salt: np.uint64 = _SALTS[0]) -> None:
        up, self.back = (np.multiply.accumulate(np.r_[_U(1), np.full(len(hashed), b, _U)]) for b in (_BASE, _BACK))
        self.total = np.r_[_U(0), np.cumsum(mix(hashed ^ salt) * up[:-1])]

    def of(self, start: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        return mix((self.total[start + n] - self.total[start]) * self.back[start] + np.asarray(n).astype(_U))


class Names:
    """Names that stand beside each other: hash, first word, words and text of each."""

    def __init__(self, hashed: np.ndarray, text: np.ndarray) -> None:
        """The runs of equal words."""
        new = np.r_[True, (hashed[1:] != hashed[:-1]) | (text[1:] != text[:-1])][: len(hashed)]
        self.start = np.flatnonzero(new)
        self.of_word = np.cumsum(new) - 1
        self.words = np.diff(np.r_[self.start, len(hashed)])
        self.name, self.text = hashed[self.start].copy(), text[self.start]
        runs = self.words > 1
        self.name[runs] = mix(self.name[runs] * _U(_BASE) + self.words[runs].astype(_U))

    def sides(self, number: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Which names are on the left side in a round, and which on the right; long ones are on none."""
        right = mix(self.name + mix(np.array([number], _U))) >> _U(63) == 1
        short = self.words < most
        return short & ~right, short & right

    def pair(self, left: np.ndarray, right: np.ndarray, most: int) -> np.ndarray:
        """Names the pairs; returns the new place of every old one."""
        first = np.zeros(len(self.name), bool)
        first[:-1] = left[:-1] & right[1:] & (self.words[:-1] + self.words[1:] <= most) & (self.text[:-1] == self.text[1:])
        second = np.r_[False, first[:-1]]
        at = np.flatnonzero(first)
        self.name[at] = mix(self.name[at] * _U(_BASE) + mix(self.name[at + 1]))
        self.words[at] += self.words[at + 1]
        self.name, self.start, self.words, self.text = (x[~second] for x in (self.name, self.start, self.words, self.text))
        return np.r_[np.arange(len(second)) - np.cumsum(second), len(self.name)]


def anchors(hashed: np.ndarray, text: np.ndarray, window: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window: its first word, its anchor's first word and number of words, and name.

    text: the number of each word's text. Windows that keep no name have an anchor of no words.
    """
    most = longest(window)
    names = Names(hashed, text)
    at = np.flatnonzero(text[window - 1 :] == text[: max(0, len(text) - window + 1)])
    low, high = names.of_word[at] + 1, names.of_word[at + window - 1]  # without the outer runs
    start, size, name = at.copy(), np.zeros(len(at), np.int64), np.zeros(len(at), _U)

    def settle(some: np.ndarray, number: int) -> None:
        rank = (names.name >> _U(8)) | ((_U(255) - np.minimum(names.words, 255).astype(_U)) << _U(56))
        best, end = low[some], high[some]
        for step in range(1, int((end - best).max(initial=0))):
            other = low[some] + step
            better = np.flatnonzero(other < end)
            better = better[rank[other[better]] < rank[best[better]]]
            best[better] = other[better]
        start[some], size[some], name[some] = names.start[best], names.words[best], mix(names.name[best] + _U(number))

    open_ = np.flatnonzero(low < high)
    for number in range(1, rounds + 1):
        left, right = names.sides(number, most)
        l, h = low[open_], high[open_]
        l, h = l + right[l], h - left[h - 1]
        kept = l < h
        settle(open_[~kept], number)
        open_ = open_[kept]
        moved = names.pair(left, right, most)
        low[open_], high[open_] = moved[l[kept]], moved[h[kept]]
    settle(open_, rounds + 1)
    return at, start, size, name


#: A segment: 40 bits of its name, a hash of its words, 24 bits of those of the words at each side of the
#: anchor (0: too few there), its document's place, its first word and its number of windows.
_SEGMENT = np.dtype([("name", _U), ("words", _U), ("before", np.uint32), ("after", np.uint32), ("place", np.int64), ("start", np.uint32), ("windows", np.uint8)])


def segments(hashed: np.ndarray, counts: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """The segments of texts, given the hashes of all words, the number of each text's, and its place."""
    if len(hashed) < window:
        return np.zeros(0, _SEGMENT)
    text = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    at, start, size, name = anchors(hashed, text, window)
    if not len(at):
        return np.zeros(0, _SEGMENT)
    alone = size == 0
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (start[1:] != start[:-1]) | (size[1:] != size[:-1]) | (name[1:] != name[:-1]) | (text[at[1:]] != text[at[:-1]])] | alone
    begin = np.flatnonzero(new)
    out = np.zeros(len(begin), _SEGMENT)
    n = np.diff(np.r_[begin, len(at)])
    at, start, size, name = at[begin], start[begin], size[begin], name[begin]
    of = text[at]
    hashes = Passages(hashed)
    out["words"] = hashes.of(at, n + window - 1)
    out["name"] = np.where(size == 0, mix(out["words"]), name)
    side = (window - longest(window)) // 2
    end = (first + counts)[of]
    for column, there, begins in (("before", start - side >= first[of], start - side), ("after", start + size + side <= end, start + size)):
        there &= size > 0
        out[column][there] = np.maximum(hashes.of(begins[there], side) >> _U(40), _U(1))
        out[column][size > longest(window)] = 1  # a long run leaves less than that at its sides
    out["place"], out["start"], out["windows"] = places[of], at - first[of], n
    return out


def first_of_equal(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments without those equal to an earlier one, in order of name; and the latter."""
    order = np.lexsort((rows["start"], rows["place"], rows["words"], rows["name"]))
    rows = rows[order]
    new = np.r_[True, (rows["name"][1:] != rows["name"][:-1]) | (rows["words"][1:] != rows["words"][:-1])][: len(rows)]
    return rows[new], rows[~new]


def asked(rows: np.ndarray) -> np.ndarray:
    """Of segments that are all different, in order of name, those that share the words at a side of their
    anchor with another of their name."""
    hit = np.zeros(len(rows), bool)
    for column in ("before", "after"):
        order = np.lexsort((rows[column], rows["name"]))
        name, side = rows["name"][order], rows[column][order]
        same = (name[1:] == name[:-1]) & (side[1:] == side[:-1]) & (side[1:] > 0)
        hit[order[1:]] |= same
        hit[order[:-1]] |= same
    common = rows["name"][rows["windows"] == MARK]
    return rows[(hit | np.isin(rows["name"], common)) & (rows["windows"] != MARK)]


def without_common(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments that are all different, in order of name, with those of each name that has more than ``most`` made one mark of it; and
    these segments, whose windows are asked for."""
    new = np.r_[True, rows["name"][1:] != rows["name"][:-1]][: len(rows)]
    size = np.diff(np.r_[np.flatnonzero(new), len(rows)])
    common = np.repeat(size > most, size)
    kept = rows[~common | new].copy()
    kept["windows"][common[~common | new]] = MARK
    return kept, rows[common]


def merged(place: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of words by place, those that overlap or touch made one."""
    order = np.lexsort((start, place))
    place, start, end = place[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(place):
        return place, start, end
    number = np.cumsum(np.r_[True, place[1:] != place[:-1]])
    reach = np.maximum.accumulate(end + (number << 40)) - (number << 40)  # within its place
    new = np.r_[True, (number[1:] != number[:-1]) | (start[1:] > reach[:-1])]
    begin = np.flatnonzero(new)
    return place[begin], start[begin], reach[np.r_[begin[1:], len(place)] - 1]


def pack(rows: np.ndarray) -> bytes:
    """Segments in order of place, column by column in as few bytes as they need."""
    rows = rows[np.argsort(rows["place"], kind="stable")]
    steps = np.diff(rows["place"])
    width = next(w for w in (1, 2, 4, 8) if w == 8 or steps.max(initial=0) < 1 << 8 * w)
    start = next(w for w in (2, 4) if w == 4 or rows["start"].max(initial=0) < 1 << 16)
    columns = [steps.astype(f"<u{width}"), rows["words"], rows["start"].astype(f"<u{start}"), rows["windows"]]
    columns += [((rows[c].astype(_U)[:, None] >> _BITS[:n]) & _U(255)).astype(np.uint8).T for c, n in (("name", 5), ("before", 3), ("after", 3))]
    head = np.array([len(rows), rows["place"][0], width, start], np.int64)
    return b"".join(x.tobytes() for x in (head, *columns))


def unpack(data: bytes) -> np.ndarray:
    n, place, width, start = np.frombuffer(data, np.int64, 4).tolist()
    out, at = np.zeros(n, _SEGMENT), 32

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(data, kind, count, at)
        at += x.nbytes
        return x

    out["place"] = place + np.r_[0, np.cumsum(take(f"<u{width}", n - 1).astype(np.int64))]
    out["words"], out["start"], out["windows"] = take("<u8", n), take(f"<u{start}", n), take("<u1", n)
    for c, m in (("name", 5), ("before", 3), ("after", 3)):
        out[c] = (take("<u1", n * m).reshape(m, n).astype(_U) << _BITS[:m, None]).sum(0, dtype=_U)
    return out


#: kind 0: a document (n words, hash of its words joined); 1: words start to end are repeated; 2: the
#: windows from start to end are asked for; 3: segments of a part of the names.
_ROW = "kind int, part int, place bigint, start int, end int, n bigint, sha string, rows binary"


def _row(count: int, kind: int, **columns) -> pa.RecordBatch:
    kinds = {"kind": pa.int32(), "part": pa.int32(), "place": pa.int64(), "start": pa.int32(), "end": pa.int32(), "n": pa.int64(), "sha": pa.string(), "rows": pa.binary()}
    columns["kind"] = np.full(count, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(count, t) for c, t in kinds.items()], names=[*kinds])


def _spans(place: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int, parts: int = 1) -> pa.RecordBatch:
    return _row(len(place), kind, part=(place % parts).astype(np.int32), place=place, start=start.astype(np.int32), end=end.astype(np.int32))


def _covered(rows: np.ndarray, window: int, parts: int = 1) -> pa.RecordBatch:
    """The words that repeated segments cover."""
    return _spans(*merged(rows["place"], rows["start"], rows["start"] + rows["windows"] + (window - 1)), 1, parts)


def _digest(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def _scanned(window: int, parts: int, most: int, common: int):
    """Documents and their segments, repeats within a batch taken out."""

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([np.zeros(0, _SEGMENT), *held])
        held.clear()
        if not len(rows):
            return
        part = (rows["name"] >> _U(40)) % _U(parts)
        rows["name"] &= _U((1 << 40) - 1)
        rows["name"] |= part << _U(40)
        rows, again = first_of_equal(rows)
        if len(again):
            yield _covered(again, window, parts)
        rows, hot = without_common(rows, common)
        if len(hot):
            yield _spans(hot["place"], hot["start"], hot["start"] + hot["windows"], 2, parts)
        ids, begin = np.unique(rows["name"] >> _U(40), return_index=True)
        yield _row(len(ids), 3, part=ids.astype(np.int32), rows=[pack(x) for x in np.split(rows, begin[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, places = [], batch.column("place").to_numpy()
            for row, data, offsets in slabs(batch.column("t")):
                begin, _, hashed = words(data, offsets, lower=False)
                counts = np.diff(np.searchsorted(begin, offsets))
                mine = places[row : row + len(counts)]
                raw = data.tobytes()
                sha = [_digest(raw[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield _row(len(counts), 0, part=(mine % parts).astype(np.int32), place=mine, n=counts, sha=sha)
                held.append(segments(hashed, counts, mine, window))
                if sum(map(len, held)) > most:
                    yield from flush(held)
            yield from flush(held)

    return run


def _met(window: int, room: int):
    """What segments of the same names tell; other rows pass. Rows come sorted by part. Of a part that has more
    different segments than there is room for, the windows of all are asked for."""

    def told(blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        held, crowded, n = np.zeros(0, _SEGMENT), False, 0
        some: list[np.ndarray] = []
        for blob in chain(blobs, [None]):
            if blob is not None:
                some.append(unpack(blob))
                n += len(some[-1])
                if n < room:
                    continue
            held, again = first_of_equal(np.concatenate([held, *some]))
            some, n = [], 0
            if len(again):
                yield _covered(again[again["windows"] != MARK], window)
            crowded = crowded or len(held) > room // 2
            if crowded or blob is None:
                wanted = held[held["windows"] != MARK] if crowded else asked(held)
                yield _spans(wanted["place"], wanted["start"], wanted["start"] + wanted["windows"], 2)
                held = held[:0]
            n = len(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blobs() -> Iterator[tuple[int, bytes]]:
            for batch in batches:
                there = batch.column("rows").is_valid().to_numpy(zero_copy_only=False)
                if not there.all():
                    passed.append(batch.filter(pa.array(~there)))
                yield from zip(batch.column("part").filter(pa.array(there)).to_pylist(), (x.as_py() for x in batch.column("rows").drop_null()), strict=True)

        passed: list[pa.RecordBatch] = []
        for _, group in groupby(blobs(), key=lambda x: x[0]):
            for out in told(x for _, x in group):
                yield out
                while passed:
                    yield passed.pop()
        yield from passed

    return run


def _hashed(window: int):
    """The windows asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in slabs(batch.column("t")):
                begin, _, hashed = words(data, offsets, lower=False)
                first = np.searchsorted(begin, offsets[:-1])
                at, place = [], []
                for i, spans in enumerate(batch.column("spans").slice(row, len(first)).to_pylist()):
                    for s in spans:
                        at.append(np.arange(s["start"], s["end"]) + first[i])
                        place.append(np.full(len(at[-1]), i))
                at, of = np.concatenate(at), np.concatenate(place)
                one, two = (Passages(hashed, salt).of(at, window).view(np.int64) for salt in _SALTS)
                places = batch.column("place").slice(row, len(first)).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(places[of]), pa.array((at - first[of]).astype(np.int32))], names=["one", "two", "place", "start"])

    return run


def remaining(text: str, spans: list[dict]) -> tuple[list[bytes], int]:
    """The words of a text outside spans (start, end), and how many are inside."""
    found = text.encode().split()
    cover = np.zeros(len(found) + 1, np.int32)
    for s in spans:
        cover[s["start"]] += 1
        cover[s["end"]] -= 1
    kept = [found[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
    return kept, len(found) - len(kept)


def _placed(docs: DataFrame, path: str) -> tuple[DataFrame, bool]:
    """docs with a place that orders documents, and whether that is the doc_id, as where each has one of
    its own."""
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    if ids.groupBy("id").count().where("count > 1 OR id IS NULL").isEmpty():
        return docs.withColumn("__place", F.col("doc_id").cast("long")), True
    ordered = docs.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    return written(ordered.withColumn("__place", F.monotonically_increasing_id()), path), False


def _with_spans(placed: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of placed that have spans, with these in a list."""
    lists = spans.groupBy(F.col("place").alias("__place")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    ids = spans.select(F.col("place").alias("__place")).distinct()
    if ids.count() <= BROADCAST_IDS:
        placed = placed.join(F.broadcast(ids), "__place", "left_semi")
    return placed.join(lists.hint("merge"), "__place")


def _repeats(placed: DataFrame, window: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents: place, n, sha; spans that are repeated: place, start, end)."""
    if not 2 <= window < MARK:
        raise ValueError("windows have 2 to 254 words")
    partitions = shuffle_partitions(placed)
    parts = PARTS * partitions
    body = placed.select(F.col("__place").alias("place"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    scanned = body.mapInArrow(_scanned(window, parts, HELD, COMMON), _ROW)
    found = written(scanned.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(_met(window, ROOM), _ROW).drop("part", "rows"), f"{folder}/found")
    wanted = found.where("kind = 2").select("place", "start", "end")
    texts = _with_spans(placed, wanted).select(F.col("__place").alias("place"), F.col("text").cast("string").alias("t"), "spans")
    windows = written(texts.mapInArrow(_hashed(window), "one bigint, two bigint, place bigint, start int"), f"{folder}/windows")
    first = windows.groupBy("one", "two").agg(F.min(F.struct("place", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = windows.join(first, ["one", "two"]).where("struct(place, start) > first").select("place", "start", (F.col("start") + window).alias("end"))
    return found.where("kind = 0").select("place", "n", "sha"), found.where("kind = 1").select("place", "start", "end").union(later)


def passage_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the words kept, joined by one space)."""
    with scratch(docs.sparkSession, "passages") as folder:
        placed, by_id = _placed(docs.select("doc_id", "text"), f"{folder}/placed")
        documents, spans = _repeats(placed, window, folder)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = [remaining(t.as_py() or "", s.as_py()) for t, s in zip(batch.column("text"), batch.column("spans"), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array([n for _, n in done], pa.int64()), pa.array([_digest(kept) for kept, _ in done], pa.string())], names=["place", "n_removed", "left"])

        spans = written(spans, f"{folder}/spans")
        discard(docs.sparkSession, f"{folder}/windows")
        changed = _with_spans(placed, spans).select(F.col("__place").alias("place"), "text", "spans").mapInArrow(run, "place bigint, n_removed bigint, left string")
        out = documents.join(changed, "place", "left")
        out = out.withColumn("doc_id", F.col("place")) if by_id else out.join(placed.select("doc_id", F.col("__place").alias("place")), "place")
        return out.select("doc_id", F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left", "sha").alias("kept_sha256"))


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all rows and columns, with repeated passages taken out of their texts (the words that are left
    are joined by one space where any went), and n_removed: how many words."""
    with scratch(docs.sparkSession, "passages") as folder:
        placed, _ = _placed(docs, f"{folder}/placed")
        spans = written(_repeats(placed, window, folder)[1], f"{folder}/spans")
        lists = spans.groupBy(F.col("place").alias("__place")).agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    kept = [c for c in docs.columns if c != "n_removed"]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("n_removed", T.LongType())])
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = [], []
            for t, spans in zip(batch.column("text"), batch.column("__spans"), strict=True):
                words_, gone = remaining(t.as_py(), spans.as_py()) if spans.is_valid and t.is_valid else ([], 0)
                texts.append(b" ".join(words_).decode() if gone else t.as_py())
                n.append(gone)
            columns = [batch.column(c) for c in kept]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64())], names=schema.names)

    return placed.join(lists.hint("merge"), "__place", "left").select(*kept, "__spans").mapInArrow(run, schema)


PASSAGES_SQL = r"""
WITH t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, array_to_string(ws[p : p + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM t))
  QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, p + j AS i FROM later, (SELECT unnest(range(20)) AS j)),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS s FROM (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS i FROM t) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""
