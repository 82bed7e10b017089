"""BPE against tiktoken, token counts against plain greedy matching."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from weft.llm import byte_bpe, token_counts
from weft.llm._vocab import default_path, read_ranks

RNG = random.Random(4)
ODD = [9, 10, 13, 28, 31, 32, 32, 39, 65, 97, 98, 133, 160, 173, 233, 769, 0x661, 0x2028, 0x200B, 0x2160, 0x3000, 0x4E2D, 0x1F600]
TEXTS = ["", None, "don't stop", " " * 500, "a" * 3000, "ab" * 1500, "<|endoftext|>", "x" * 200 + " " + "é" * 100] + ["".join(chr(RNG.choice(ODD)) for _ in range(80)) for _ in range(300)]


@pytest.fixture(scope="module")
def tokens():
    return read_ranks(default_path())


def test_ids_equal_tiktoken_and_decode(spark, tokens):
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    for r in byte_bpe.encode(docs).collect():
        text = TEXTS[r.doc_id] or ""
        want = plain.encode_ordinary(text)
        assert r.token_ids == want and r.n_tokens == len(want) and r.round_trip
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_decoding_ids(spark, tokens):
    coded = spark.createDataFrame([([464, 3290],), ([],), (None,)], "token_ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(coded).collect()] == [tokens[464] + tokens[3290], b"", b""]


def test_bpe_of_no_rows(spark):
    assert byte_bpe.bpe_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def greedy(word: bytes, vocabulary: set[bytes], longest: int) -> int:
    n = at = 0
    while at < len(word):
        end = min(len(word), at + longest)
        while word[at:end] not in vocabulary:
            end -= 1
        at, n = end, n + 1
    return n


def test_counts_equal_greedy_matching(spark, tokens):
    vocabulary, longest = set(tokens), max(map(len, tokens))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in token_counts.token_report(docs).collect():
        words = (TEXTS[r.doc_id] or "").encode().split()
        assert (r.n_words, r.n_tokens) == (len(words), sum(greedy(b" " + w, vocabulary, longest) for w in words))


def test_automaton_needs_every_byte():
    with pytest.raises(ValueError):
        token_counts.Automaton([b"a"])


def test_empty_tables_and_more_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x")], "doc_id long, text string, n_words long, ids_sha256 string")
    for report in (byte_bpe.bpe_report, token_counts.token_report):
        assert report(docs.limit(0)).count() == 0 and report(docs).count() == 1
