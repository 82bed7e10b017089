"""Byte-level BPE by a sentencepiece model that is serialised straight from a rank file.

Every byte is mapped to a printable character, so a token of bytes is a string. The model holds
those strings as BPE pieces, each scored by its negative rank, with identity normalisation: merging
the best-scored neighbours first is then what merging by rank does. A text is split by the
tokenizer's pattern, every match is encoded by itself, and decoding maps the pieces' characters
back to bytes.

A row needs only itself, so nothing shuffles. The model (about a megabyte, fixed by the vocabulary)
is broadcast. Encoded matches are remembered per task, up to MEMO short ones.

Defined cases: null text counts as empty and has no tokens; nulls elsewhere, repeated rows and
further columns do not matter, but those named like a result are replaced; very long texts are encoded
whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weft.llm._shared import text_or_empty
from weft.llm._vocab import default_path, read_ranks

#: Matches that a task remembers, the longest of them, and characters encoded at a time.
MEMO, MEMO_LENGTH, CHUNK = 400_000, 48, 1 << 20
#: Ids of the model are ranks plus one: sentencepiece needs an unknown piece, which has id 0.
SHIFT = 1


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> str:
    """The character of every byte: itself if printable in Latin-1, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(rest)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: bytes | float | int) -> bytes:
    """One protobuf field: length-delimited, 32-bit float or varint."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model of the tokens, in the order of their ranks.

    Field numbers are those of sentencepiece_model.proto: ModelProto pieces 1, trainer_spec 2,
    normalizer_spec 3; SentencePiece piece 1, score 2, type 3; TrainerSpec model_type 3,
    vocab_size 4, unk/bos/eos/pad ids 40 to 43; NormalizerSpec name 1, flags 3 to 5.
    """
    table = byte_characters()
    absent = (1 << 64) - 1  # -1 as a varint
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))]
    for rank, token in enumerate(tokens):
        pieces.append(_field(1, _field(1, token.decode("latin-1").translate(table).encode()) + _field(2, float(-rank))))
    trainer = _field(3, 2) + _field(4, len(tokens) + SHIFT) + _field(40, 0) + b"".join(_field(n, absent) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes texts to ids and ids to bytes, remembering the ids of short matches."""

    def __init__(self, model: bytes, pattern: str) -> None:
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.matches = regex.compile(pattern).findall
        self.table = byte_characters()
        back = {c: b for b, c in enumerate(self.table)}
        self.bytes_of = [bytes(back[c] for c in self.processor.id_to_piece(i + SHIFT)) for i in range(self.processor.get_piece_size() - SHIFT)]
        self.whole = {token: i for i, token in enumerate(self.bytes_of)}
        self.memo: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[bytes]:
        raw = [p.encode() for p in parts]
        found = self.processor.encode([b.decode("latin-1").translate(self.table) for b in raw], num_threads=1)
        # a match that is a token as a whole is that token, whatever its merges give
        ids = [[self.whole[b]] if b in self.whole else [i - SHIFT for i in merged] for b, merged in zip(raw, found, strict=True)]
        return [np.array(x, "<u4").tobytes() for x in ids]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of every text its ids, as little-endian unsigned 32-bit integers."""
        split = [self.matches(t) for t in texts]
        met = set().union(*split)
        if len(self.memo) + len(met) > MEMO:
            self.memo.clear()
        short = [p for p in met if len(p) <= MEMO_LENGTH and p not in self.memo]
        self.memo.update(zip(short, self._ids(short), strict=True))
        long = [p for p in met if len(p) > MEMO_LENGTH]
        known = _Either(self.memo, dict(zip(long, self._ids(long), strict=True))) if long else self.memo
        return [b"".join(map(known.__getitem__, parts)) for parts in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Either:
    """Two dictionaries read as one, without copying the large one."""

    def __init__(self, large: dict, small: dict) -> None:
        self.large, self.small = large, small

    def __getitem__(self, key: str) -> bytes:
        return self.small[key] if len(key) > MEMO_LENGTH else self.large[key]


@lru_cache(maxsize=1)
def _codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def _chunks(texts: pa.Array) -> Iterator[list[str]]:
    """Consecutive texts, about CHUNK characters at a time."""
    held, size = [], 0
    for x in texts:
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None, ids: bool = True) -> DataFrame:
    """docs with n_tokens, token_ids (unless ``ids`` is false), ids_sha256 and decoded_sha256.

    The digests are of the ids as little-endian unsigned 32-bit integers and of the bytes that the
    ids decode to; round_trip says whether those are the text's bytes.
    """
    model = docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary or default_path())))
    split_by = pattern or default_pattern()
    added = [T.StructField("n_tokens", T.LongType()), *[T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))] * ids, T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    names = {f.name for f in added}
    kept = [c for c in docs.columns if c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, split_by)
        for batch in batches:
            row = 0
            for part in _chunks(batch.column("__text")):
                coded = codec.encode(part)
                bodies = [codec.decode(x) for x in coded]
                columns = [batch.column(c).slice(row, len(part)) for c in kept]
                columns.append(pa.array([len(x) // 4 for x in coded], pa.int64()))
                if ids:
                    flat = np.frombuffer(b"".join(coded), "<i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in coded)]), pa.int32()), pa.array(flat)))
                columns += [pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array([hashlib.sha256(x).hexdigest() for x in bodies]), pa.array([a == b.encode() for a, b in zip(bodies, part, strict=True)])]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])
                row += len(part)

    return docs.withColumn("__text", text_or_empty(text)).select(*kept, "__text").mapInArrow(run, schema)


def decode(coded: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """coded with ``decoded``, the bytes that its token_ids stand for; null ids decode to none."""
    model = coded.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary or default_path())))
    split_by = pattern or default_pattern()
    schema = T.StructType([*(f for f in coded.schema if f.name != "decoded"), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value, split_by)
        for batch in batches:
            out = [codec.decode(np.asarray(x.as_py() or [], "<u4").tobytes()) for x in batch.column("token_ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in schema if f.name != "decoded"), pa.array(out, pa.binary())], names=schema.names)

    return coded.mapInArrow(run, schema)


def bpe_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256, round_trip."""
    return encode(docs.select("doc_id", "text"), vocabulary=vocabulary, ids=False).drop("text")
