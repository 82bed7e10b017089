"""Draws of a simulation: the first 32 bits of MD5, of many short messages at once.

A draw is the MD5 of "seed:run:said". Messages of one text differ only in their first bytes, so the words of a text
are laid out once for each number of digits that a run may have, and what a run adds is put over them. Columns of
8,192 messages go through the rounds together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SHIFT = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_ADD = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages that go through the rounds together.
TOGETHER = 8192
#: Runs that the bits of a long hold, and rows that are drawn for at once.
BITS, DRAWN = 64, 4096


def _block(state: list[np.ndarray], words: list[np.ndarray], last: bool) -> list[np.ndarray]:
    """The state after one block of 16 words; of the last block only the first word is asked for, which is set three rounds before the end."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(61 if last else 64):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        a += f
        a += words[k]
        a += _ADD[i]
        s = _SHIFT[i // 16][i % 4]
        np.left_shift(a, np.uint32(s), out=t)
        a >>= np.uint32(32 - s)
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    if last:  # the first word has moved on to the second
        return [state[0] + b]
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def _laid(data: np.ndarray, offsets: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, blocks): the texts as columns of words behind ``head`` free bytes, ended as MD5 wants it, and how many blocks each has."""
    size = np.diff(offsets) + head
    blocks = (size + 72) // 64
    wide = 64 * int(blocks.max())
    out = np.zeros((len(size), wide), np.uint8)
    row = np.repeat(np.arange(len(size)), size - head)
    at = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], size - head) + head
    out[row, at] = data[offsets[0] : offsets[-1]]
    each = np.arange(len(size))
    out[each, size] = 0x80
    words = out.view("<u4")
    words[each, 16 * blocks - 2], words[each, 16 * blocks - 1] = (8 * size) & 0xFFFFFFFF, (8 * size) >> 32
    return np.ascontiguousarray(words.T), blocks


def draws(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, run: np.ndarray, seed: int) -> np.ndarray:
    """The first eight hexadecimal digits, as a number, of the MD5 of "seed:run:text" for texts by their rows."""
    out = np.zeros(len(row), np.uint32)
    if not len(row):
        return out
    which = run - run.min()
    heads = [f"{seed}:{r}:".encode() for r in range(int(run.min()), int(run.max()) + 1)]
    length = np.array([len(h) for h in heads], np.int64)
    for head in np.unique(length[np.unique(which) if len(which) < 1000 else slice(None)]):
        words, blocks = _laid(data, offsets, int(head))
        first = np.zeros((len(heads), 4 * -(-int(head) // 4)), np.uint8)
        for i in np.flatnonzero(length == head):
            first[i, :head] = np.frombuffer(heads[i], np.uint8)
        first = np.ascontiguousarray(first.view("<u4").T)
        mine = np.flatnonzero(length[which] == head)
        for n in np.unique(blocks):
            some = mine[blocks[row[mine]] == n]
            for at in range(0, len(some), TOGETHER):
                part = some[at : at + TOGETHER]
                of, heading = row[part], which[part]
                state = [np.full(len(part), x, np.uint32) for x in _START]
                for block in range(n):
                    message = [words[k].take(of) for k in range(16 * block, 16 * block + 16)]
                    for k in range(16 * block, min(16 * block + 16, len(first))):
                        message[k - 16 * block] |= first[k].take(heading)
                    state = _block(state, message, block == n - 1)
                out[part] = state[0].byteswap()
    return out


def passed(group: np.ndarray, left: np.ndarray, bar: np.ndarray, bunch: np.ndarray, data: np.ndarray, offsets: np.ndarray, seed: int) -> np.ndarray:
    """For each group (rows by group, from 0) the runs, as bits, that any of its rows passes on: a row passes one of its
    runs ``left`` if the draw is at most its bar. Rows of a group go one after another, each only for runs not passed by then."""
    got = np.zeros(int(group.max(initial=-1)) + 1, np.uint64)
    rows = np.arange(len(group))
    while True:
        need = left[rows] & ~got[group[rows]]
        rows, need = rows[need != 0], need[need != 0]
        if not len(rows):
            return got
        first = np.r_[True, group[rows[1:]] != group[rows[:-1]]]
        now, need = rows[first], need[first]
        rows = rows[~first]
        bits = np.unpackbits(need.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        # texts of these rows only
        size = offsets[now + 1] - offsets[now]
        stop = np.cumsum(size)
        place = np.repeat(offsets[now] - (stop - size), size) + np.arange(int(stop[-1]))
        drawn = draws(data[place], np.r_[0, stop], at, bunch[now][at] * BITS + bit, seed)
        hit = drawn <= bar[now][at]
        bits[at, bit] = hit
        got[group[now]] |= np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def passing(seed: int):
    """Rows (node_id, bunch, runs, bar, said), those of a node beside each other as far as they can be, to (node_id, bunch,
    runs): what is passed on, perhaps in several rows a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, DRAWN) for b in batches for at in range(0, b.num_rows, DRAWN)):
            ids, said = batch.column("node_id"), batch.column("said").cast(pa.large_string())
            bunch = batch.column("bunch").to_numpy().astype(np.int64)
            code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            new = np.r_[True, (code[1:] != code[:-1]) | (bunch[1:] != bunch[:-1])]
            offsets = np.frombuffer(said.buffers()[1], np.int64)[said.offset : said.offset + len(said) + 1]
            data = np.frombuffer(said.buffers()[2] or b"", np.uint8)
            got = passed(np.cumsum(new) - 1, batch.column("runs").to_numpy().view(np.uint64), batch.column("bar").to_numpy(), bunch, data, offsets, seed)
            first = np.flatnonzero(new)
            some = got != 0
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(first[some])), pa.array(bunch[first[some]].astype(np.int32)), pa.array(got[some].view(np.int64))], names=["node_id", "bunch", "runs"])

    return run
