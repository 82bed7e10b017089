"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

Two words are as similar as the subsequences of three characters they share, gaps allowed within
five characters and discounted, so an insult with characters inserted or endings changed stays near
its plain form. Words carry marks at both ends; characters that are neither letters nor digits are
left out, and runs of single letters ("i d i o t") count as a word too.

Landmarks are training words that tell toxic from other documents, chosen one after the other so
that each adds something the others don't. A document is described by how near its words come to
every landmark, mapped by the inverse square root of the landmarks' own kernel matrix (Nystroem),
and a linear machine with squared hinge loss separates the documents; a logistic curve on margins
out of fold turns margins into scores.

Training reads at most TRAIN_ROWS labelled documents, those with the least hash of their id, whole.
Word counts of these are aggregated by Spark; the driver gets the CANDIDATES best words and the
training documents' feature rows, both bounded by parameters. Scoring is one pass without a
shuffle, with the model (a few megabytes, fixed by LANDMARKS) broadcast.

Defined cases: null and empty texts get the score of a document near no landmark; rows without a
label, or with a null label, don't train; of rows that repeat a doc_id the least text trains, with the
greatest label; if the labels have only one class, every score is the share of that class, and 0 if
there are none; repeated rows score alike, and so do texts with the same words; an empty table gives
an empty result; very long texts are read whole, their words in blocks; columns of docs named score
or predicted are replaced, others are kept.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm._shared import cut, text_or_empty

TRAIN_ROWS, CANDIDATES, LANDMARKS = 12_000, 2_000, 160
#: Characters of a piece that the kernel sees at once (longer words are several pieces), the
#: discount of each character skipped, the power that similarities are raised to, and the least
#: similarity that counts.
PIECE, DECAY, POWER, FLOOR = 24, 0.7, 2, 0.06
#: Buckets of the hashed subsequences; words that a task remembers, similarities that it remembers of
#: them (six bytes each), and words that it looks up at once.
BUCKETS, MEMO, ENTRIES, BLOCK = 1 << 20, 300_000, 2_000_000, 1 << 15
_SPACED = re.compile(r"(?:(?<!\w)\w[\s.*_-]{1,2}){2,}\w(?!\w)")
_REST = re.compile(r"[\W_]+")


def words_of(text: str) -> set[str]:
    """The distinct words of a text that hold a letter or digit, as the kernel sees them."""
    low = text.lower()
    found = set(low.split())
    for run in _SPACED.findall(low):
        found.add(_REST.sub("", run))
    return found


def pieces(word: str) -> list[str]:
    plain = word if word.isalnum() else _REST.sub("", word)
    if len(plain) <= PIECE:
        return [plain] if plain else []
    return [plain[i : i + PIECE] for i in range(0, len(plain) - PIECE // 2, PIECE // 2)]


def _codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, bucket, weight) of every gapped subsequence, repeated ones apart."""
    raw = np.array(parts, f"U{PIECE}").view(np.uint32).reshape(len(parts), PIECE)
    length = (raw > 0).sum(1)
    c = np.zeros((len(parts), PIECE + 2 + 4), np.uint64)
    c[:, 0] = 1
    c[:, 1 : PIECE + 1] = raw
    c[np.arange(len(parts)), length + 1] = 2
    width, c = c.shape[1], c.reshape(-1)
    who, where, weight = [], [], []
    end = np.flatnonzero(c)
    for k in range(2, 5):
        end_k = end[end % width >= k]
        row = end_k // width
        ends = (c[end_k - k] << np.uint64(42)) ^ c[end_k]
        for j in range(1, k):
            mixed = ends ^ (c[end_k - k + j] << np.uint64(21))
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            who.append(row)
            where.append((mixed >> np.uint64(44)).astype(np.int64))
            weight.append(np.full(len(row), DECAY ** (k - 2), np.float32))
    return np.concatenate(who), np.concatenate(where), np.concatenate(weight)


def _least_norm(parts: list[str]) -> np.ndarray:
    """What the norm of a piece can't be below: its norm with repeated subsequences apart."""
    n = np.arange(PIECE + 1) + 2
    of = np.sqrt(sum((k - 1) * np.maximum(n - k, 0) * DECAY ** (2 * k - 4) for k in range(2, 5)))
    return of[np.fromiter(map(len, parts), np.int64, len(parts))]


def subsequences(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, bucket, weight) of every different gapped subsequence, and the norm of every piece."""
    who, where, weight = _codes(parts)
    flat = who * BUCKETS + where
    order = np.argsort(flat)
    flat = flat[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    total = np.add.reduceat(weight[order].astype(np.float64), first)
    who, where = flat[first] // BUCKETS, flat[first] % BUCKETS
    norm = np.sqrt(np.bincount(who, weights=total**2, minlength=len(parts)))
    return who, where, total.astype(np.float32), norm


@dataclass
class Landmarks:
    """Similarities of pieces to chosen words."""

    words: list[str]
    slot: np.ndarray = field(init=False)  # of a bucket; 0: in no word
    start: np.ndarray = field(init=False)  # where the entries of a slot start
    mark: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        who, where, weight, norm = subsequences(self.words)
        order = np.argsort(where, kind="stable")
        used, first = np.unique(where[order], return_index=True)
        self.slot = np.zeros(BUCKETS, np.int32)
        self.slot[used] = np.arange(1, len(used) + 1)
        self.start = np.concatenate([[0], first, [len(where)]])
        self.mark, self.value = who[order], (weight / norm[who])[order]

    def near(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that come near any landmark, and a row for each of these with a column for each
        landmark; what is below FLOOR is 0."""
        rows, values = [np.zeros(0, np.int64)], [np.zeros((0, len(self.words)), np.float32)]
        least = 0.999 * FLOOR ** (1 / POWER)
        for at in range(0, len(parts), 1024):
            some = parts[at : at + 1024]
            who, where, weight = _codes(some)
            slot = self.slot[where]
            hit = np.flatnonzero(slot)
            slot = slot[hit]
            counts = self.start[slot + 1] - self.start[slot]
            entry = np.repeat(self.start[slot] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            flat = np.repeat(who[hit], counts) * len(self.words) + self.mark[entry]
            made = np.bincount(flat, weights=np.repeat(weight[hit], counts) * self.value[entry], minlength=len(some) * len(self.words)).reshape(len(some), -1)
            near = np.flatnonzero(made.max(1, initial=0) >= least * _least_norm(some))
            if len(near):
                norm = subsequences([some[i] for i in near])[3]
                close = np.minimum(made[near] / norm[:, None], 1) ** POWER
                close[close < FLOOR] = 0
                rows.append(at + near)
                values.append(close.astype(np.float32))
        return np.concatenate(rows), np.concatenate(values)

    def similar(self, parts: list[str]) -> np.ndarray:
        """A row for every piece, a column for each landmark."""
        out = np.zeros((len(parts), len(self.words)), np.float32)
        rows, values = self.near(parts)
        out[rows] = values
        return out


def choose(words: list[str], toxic: np.ndarray, every: np.ndarray, weight: np.ndarray, rate: float, candidates: int, most: int) -> list[str]:
    """Landmarks among the first ``candidates`` words, by how many documents hold them.

    A word speaks for those near it, which is how a family of inflected words is found: its score
    is the excess of toxic documents over ``rate`` around it, in standard deviations. The words
    after the candidates are a sample of all words, ``weight`` how many words each stands for.
    """
    near = np.empty((len(words), candidates), np.float32)
    for at in range(0, candidates, 128):  # a table of subsequences for a few landmarks at a time
        near[:, at : at + 128] = Landmarks(words[:candidates][at : at + 128]).similar(words)
    excess = near.T @ ((toxic - rate * every) * weight)
    spread = (near**2).T @ (rate * (1 - rate) * every * weight)
    left = np.where(np.maximum(excess, 0) ** 2 > 9 * (spread + 1), excess / np.sqrt(spread + 1), 0)
    chosen: list[int] = []
    while len(chosen) < most and left.max(initial=0) > 0:
        best = int(np.argmax(left))
        chosen.append(best)
        left = left * (1 - near[best]) ** 2
        left[best] = 0
    return [words[i] for i in chosen]


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # over the similarities to landmarks
    bias: float
    slope: float
    shift: float

    def score(self, features: np.ndarray) -> np.ndarray:
        margin = (features * self.weights).sum(1) + self.bias  # the same for a row whatever its batch
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def _newton(x: np.ndarray, y: np.ndarray, loss, penalty: float, steps: int = 40) -> np.ndarray:
    """Minimises the mean of loss(y * (x w)) plus the penalty; loss gives derivatives one and two."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-9  # the last column is the bias
    for _ in range(steps):
        one, two = loss(y * (x @ w))
        step = np.linalg.solve((x * two[:, None]).T @ x / len(y) + np.diag(ridge), x.T @ (y * one) / len(y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(features: np.ndarray, toxic: np.ndarray, landmarks: list[str], folds: int = 3) -> Model:
    gram = Landmarks(landmarks).similar(landmarks).astype(np.float64)
    value, vector = np.linalg.eigh((gram + gram.T) / 2)
    root = vector / np.sqrt(np.maximum(value, 0.05)) @ vector.T
    y = np.where(toxic > 0, 1.0, -1.0)
    balance = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    x = np.c_[features @ root, np.ones(len(y))]
    hinge = lambda part: lambda m: (-2 * balance[part] * np.maximum(0, 1 - m), 2 * balance[part] * (m < 1) + 1e-6)
    fold = np.arange(len(y)) % folds
    margins = np.zeros(len(y))
    for f in range(folds):
        part, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(set(y[part].tolist())) == 2:
            margins[rest] = x[rest] @ _newton(x[part], y[part], hinge(part), 1e-3)
    w = _newton(x, y, hinge(np.arange(len(y))), 1e-3)

    def logistic(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(np.clip(m, -60, 60)))
        return -p, p * (1 - p) + 1e-6

    slope, shift = _newton(np.c_[margins, np.ones(len(y))], y, logistic, 1e-3)
    if slope <= 0:
        slope, shift = 1.0, 0.0
    return Model(landmarks, root @ w[:-1], float(w[-1]), float(slope), float(shift))


class Describer:
    """Features of texts: for each landmark the greatest similarity of any word.

    Words met are remembered with the landmarks that they are near and how near, six bytes each;
    when there are MEMO words or ENTRIES of these, those that came once are forgotten, and all if
    that is not enough.
    """

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = Landmarks(landmarks)
        self.memo: dict[str, int] = {}
        self.start = np.zeros(MEMO + 2, np.int64)  # by word, in order of learning
        self.mark, self.value = np.zeros(ENTRIES, np.uint16), np.zeros(ENTRIES, np.float32)
        self.met = np.zeros(MEMO, np.int32)
        self.known = 0

    def _forget(self) -> None:
        stay = np.flatnonzero(self.met[: self.known] > 1)
        stay = stay[np.argsort(-self.met[stay], kind="stable")][: MEMO // 2]
        counts = self.start[stay + 1] - self.start[stay]
        stay = stay[: np.searchsorted(np.cumsum(counts), ENTRIES // 2, "right")]
        counts = counts[: len(stay)]
        entry = np.repeat(self.start[stay] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        self.mark[: len(entry)], self.value[: len(entry)] = self.mark[entry], self.value[entry]
        self.start[1 : len(stay) + 1] = np.cumsum(counts)
        place = np.full(self.known, -1)
        place[stay] = np.arange(len(stay))
        self.memo = {w: to for w, i in self.memo.items() if (to := int(place[i])) >= 0}
        self.known = len(stay)
        self.met[:] = 0

    def _learn(self, new: list[str]) -> bool:
        """Whether there was room for the words."""
        if self.known + len(new) > MEMO:
            return False
        cut_up = [pieces(w) for w in new]
        owner = np.repeat(np.arange(len(new)), [len(p) for p in cut_up])
        at, near = self.landmarks.near([p for ps in cut_up for p in ps])
        found, place = np.unique(owner[at], return_inverse=True)
        best = np.zeros((len(found), near.shape[1]), np.float32)
        np.maximum.at(best, place, near)
        row, mark = np.nonzero(best)
        begin = self.start[self.known]
        if begin + len(row) > ENTRIES:
            return False
        self.mark[begin : begin + len(row)], self.value[begin : begin + len(row)] = mark, best[row, mark]
        counts = np.zeros(len(new), np.int64)
        counts[found] = np.bincount(row, minlength=len(found))
        self.start[self.known + 1 : self.known + 1 + len(new)] = begin + np.cumsum(counts)
        self.memo.update(zip(new, range(self.known, self.known + len(new)), strict=True))
        self.known += len(new)
        return True

    def _raise(self, out: np.ndarray, text: np.ndarray, words: list[str]) -> None:
        """Raises rows of out, by text, to the similarities of words."""
        new = list({w for w in words if w not in self.memo})
        if new and not self._learn(new):
            self._forget()
            if not self._learn(list({w for w in words if w not in self.memo})):
                self.memo.clear()
                self.known = 0
                half = len(words) // 2  # one word has room
                for part in (slice(half), slice(half, None)) if half else (slice(None),):
                    self._raise(out, text[part], words[part])
                return
        at = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        self.met[: self.known] += np.bincount(at, minlength=self.known).astype(np.int32)
        counts = self.start[at + 1] - self.start[at]
        entry = np.repeat(self.start[at] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        np.maximum.at(out.reshape(-1), np.repeat(text, counts) * out.shape[1] + self.mark[entry], self.value[entry])

    def features(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.landmarks.words)), np.float32)
        split = [words_of(t) for t in texts]
        text = np.repeat(np.arange(len(texts)), [len(w) for w in split])
        words = [w for found in split for w in found]
        for at in range(0, len(words), BLOCK):
            self._raise(out, text[at : at + BLOCK], words[at : at + BLOCK])
        return out


@lru_cache(maxsize=1)
def _describer(landmarks: tuple[str, ...]) -> Describer:
    return Describer(list(landmarks))


def _texts(column: pa.Array, size: int = 1 << 20) -> Iterator[list[str]]:
    held, n = [], 0
    for x in column:
        held.append(x.as_py() or "")
        n += len(held[-1])
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model | float:
    """A model of labels (doc_id, label), or the share of toxic ones where there is only one class."""
    chosen = labels.where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    body = docs.select("doc_id", text_or_empty(text).alias("t"))
    sample = body.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("t").alias("t"))
    sample = cut(sample.select("y", "t"))  # bounded by rows, whatever ids repeat
    n = {r["y"] > 0: r["count"] for r in sample.groupBy("y").count().collect()}
    if len(n) < 2:
        return float(True in n)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, t in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist(), strict=True):
                found = sorted({p for w in words_of(t) for p in pieces(w)})
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([int(y > 0)] * len(found), pa.int32())], names=["w", "y"])

    counts = sample.mapInArrow(spell, "w string, y int").groupBy("w").agg(F.sum("y").alias("toxic"), F.count(F.lit(1)).alias("all"))
    rate = n[True] / (n[True] + n[False])
    counts = cut(counts)
    excess = F.col("toxic") - rate * F.col("all")
    best = counts.where("toxic > 0").orderBy((excess / F.sqrt(rate * F.col("all") + 1)).desc(), "w").limit(CANDIDATES).collect()
    some = counts.orderBy(F.xxhash64("w")).limit(CANDIDATES).collect()
    found = [*best, *some]
    stands = max(1.0, (counts.count() - len(best)) / max(1, len(some)))
    marks = choose([r["w"] for r in found], np.array([r["toxic"] for r in found], float), np.array([r["all"] for r in found], float), np.r_[np.ones(len(best)), np.full(len(some), stands)], rate, len(best), landmarks)
    if not marks:
        return rate

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describer = _describer(tuple(marks))
        for batch in batches:
            row = 0
            for part in _texts(batch.column("t")):
                made = describer.features(part)
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(row, len(part)), pa.array([r.tobytes() for r in made], pa.binary()), pa.array([zlib.crc32(t.encode()) for t in part], pa.int64())], names=["y", "x", "o"])
                row += len(part)

    kind = T.StructType([sample.schema["y"], T.StructField("x", T.BinaryType()), T.StructField("o", T.LongType())])
    got = sorted(sample.mapInArrow(describe, kind).collect(), key=lambda r: (r["o"], r["y"]))
    features = np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(len(got), -1).astype(np.float64)
    return fit(features, np.array([r["y"] for r in got]), marks)


def score(docs: DataFrame, model: Model | float, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1, toxic above) and predicted (1 from 0.5 on).

    columns: those of docs that are kept, if not all; no others go through Python but the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in columns or docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    body = docs.withColumn(text, F.col(text).cast("string")).select(*dict.fromkeys([*kept, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            row = 0
            for part in _texts(batch.column(text)):
                if isinstance(model, float):
                    made = np.full(len(part), model)
                else:
                    made = model.score(_describer(tuple(model.landmarks)).features(part).astype(np.float64))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, len(part)) for c in kept), pa.array(made), pa.array((made >= 0.5).astype(np.int32))], names=schema.names)
                row += len(part)

    return body.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train_by_contract(docs: DataFrame, labels: DataFrame) -> Model | float:
    return train(docs, labels.where(~held_out()))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train_by_contract(docs, labels)
    return score(docs, model, columns=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")
