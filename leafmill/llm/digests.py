"""Digests in array operations, and bitmaps of digests that filter a pass over a corpus.

A bitmap has a fixed size, whatever the number of digests, and works as a runtime filter does:
it lets all asked digests through and some others by chance, which the join on the digest that
follows drops. Its size changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, as a power of two (8 MB).
FILTER_BITS = 26
#: Rows and bytes of text worked on at once.
ROWS, BYTES = 2_000, 4_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """Well spread digests of sums; other salts give other digests."""
    x = (x ^ np.uint64(salt * 0x2545F4914F6CDD1D & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_digest(word: str) -> int:
    """The value of SQL's xxhash64 for one text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42)


def parts(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of a bounded number of rows and, but for single texts, of bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + ROWS]), BYTES, side="right")))
        yield texts.slice(at, n)
        at += n


def broadcast_filter(digests: DataFrame):
    """A broadcast bitmap of the digests (bigint) in column `d`: 2**FILTER_BITS bits."""
    bit = F.shiftrightunsigned("d", 64 - FILTER_BITS)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(d, {64 - FILTER_BITS}) & 63 as int))")
    words = digests.select(F.shiftright(bit, 6).alias("at"), one.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    got = words.toArrow()  # at most 2**(FILTER_BITS - 6) rows
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    bits[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return digests.sparkSession.sparkContext.broadcast(bits.tobytes())


def bitmap(broadcast) -> np.ndarray:
    return np.frombuffer(broadcast.value, dtype=np.uint64)


def passes(bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Which of the digests the bitmap lets through."""
    bit = digests >> np.uint64(64 - FILTER_BITS)
    return (bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
