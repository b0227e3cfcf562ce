"""Which of very many words do texts hold, anywhere in them: one pass over the text, whatever the number of words.

A word of n bytes is told by the digests of its first and last 2**k bytes, the largest power that
fits. Digests of all windows of 1, 2, 4, ... bytes come from one another by doubling, in array
operations. A bitmap of fixed size holds the asked beginnings and the asked words; where it lets both
through, the bytes themselves are given, and the join on them that follows drops what is none of the
words. So neither its size nor equal digests change a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap, as a power of two (8 MB).
FILTER_BITS = 26
#: Bytes of text worked on at once, besides the longest word.
BYTES = 1 << 18
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
SHIFT = np.uint64(31)


def joined(x: np.ndarray, y: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well spread digests of pairs of digests, in order."""
    z = x * ODD
    z += y
    z ^= z >> SHIFT
    z += np.uint64(salt)
    z *= MIX
    z ^= z >> SHIFT
    return z


def windows(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(k, digests of the windows of 2**k bytes by where they start), up to the length of the data."""
    one = np.arange(256, dtype=np.uint64)
    k, got = 0, joined(one, one)[data]
    while len(got):
        yield k, got
        step = 1 << k
        k, got = k + 1, joined(got[:-step], got[step:])


def whole(got: np.ndarray, k: int, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Digests of the `n` bytes from `at`, by the windows `got` of 2**k bytes; 2**k <= n < 2**(k + 1)."""
    return joined(joined(got[at], got[at + n - (1 << k)], 1), np.broadcast_to(np.asarray(n, dtype=np.uint64), at.shape))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of texts without nulls, in one stretch from 0."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts, each of about `BYTES`."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES, side="right")) - 1)
        yield at, to
        at = to


def asked_bits(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bits, lengths): the bits of all beginnings and words, and the lengths in bytes."""
    offsets, data = buffers(words)
    bits, lengths = [], np.unique(np.diff(offsets))
    for a, b in slices(offsets):
        start, n = offsets[a:b] - offsets[a], np.diff(offsets[a : b + 1])
        for k, got in windows(data[offsets[a] : offsets[b]]):
            if 1 << k > n.max():
                break
            own = n >> k == 1
            bits += [got[start[own]], whole(got, k, start[own], n[own])]
    shift = np.uint64(64 - FILTER_BITS)
    return np.unique(np.concatenate(bits) >> shift) if bits else np.zeros(0, dtype=np.uint64), lengths[lengths > 0]


def broadcast_words(words: DataFrame, word: str):
    """A broadcast (bitmap, lengths) of the words: at most 2**(FILTER_BITS - 6) rows are collected, and one a length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits, lengths = asked_bits(b.column(0))
            at = np.concatenate([(bits >> np.uint64(6)).astype(np.int64), -lengths])
            one = np.concatenate([np.left_shift(np.uint64(1), bits & np.uint64(63)).view(np.int64), np.zeros(len(lengths), dtype=np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(one)], ["at", "bit"])

    got = words.select(word).mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    at, bits = got.column("at").to_numpy(), got.column("bits").to_numpy()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bitmap[at[at >= 0]] = bits[at >= 0]
    return words.sparkSession.sparkContext.broadcast((bitmap.tobytes(), sorted((-at[at < 0]).tolist())))


def passes(bitmap: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which of the digests the bitmap (of bytes) lets through."""
    bit = digests >> np.uint64(64 - FILTER_BITS)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def finds(data: np.ndarray, offsets: np.ndarray, bitmap: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length) of what the bitmap takes for words."""
    by_level: dict[int, list[int]] = {}
    for n in lengths:
        by_level.setdefault(n.bit_length() - 1, []).append(n)
    out = []
    longest = lengths[-1] if lengths else 0
    for a in range(0, len(data), BYTES):
        for k, got in windows(data[a : a + BYTES + longest - 1]):
            if 1 << k > longest:
                break
            if k not in by_level:
                continue
            at = np.flatnonzero(passes(bitmap, got[:BYTES]))
            row = np.searchsorted(offsets, at + a, side="right") - 1
            room = offsets[row + 1] - a - at
            for n in by_level[k]:
                fits = np.flatnonzero(room >= n)
                fits = fits[passes(bitmap, whole(got, k, at[fits], n))]
                out.append((row[fits], at[fits] + a, np.full(len(fits), n)))
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none)


def cut_out(data: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Array:
    """The `n` bytes from each start, as texts."""
    ends = np.cumsum(n)
    at = np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def candidates(texts: DataFrame, on: list[str], text: str, word: str, words) -> DataFrame:
    """(on, word): stretches of the texts that may be words of the broadcast `words`; each that is one is among them."""
    schema = texts.select(*on, F.col(text).alias(word)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, lengths = words.value
        bitmap = np.frombuffer(bits, dtype=np.uint8)
        for b in batches:
            offsets, data = buffers(b.column(len(on)))
            for a, z in slices(offsets):
                own = data[offsets[a] : offsets[z]]
                row, start, n = finds(own, offsets[a : z + 1] - offsets[a], bitmap, lengths)
                rows = pa.array(row + a)
                got = pa.table([*(b.column(i).take(rows) for i in range(len(on))), cut_out(own, start, n)], [*on, word])
                yield from got.group_by([*on, word], use_threads=False).aggregate([]).select([*on, word]).to_batches()

    return texts.select(*on, text).mapInArrow(run, schema)
