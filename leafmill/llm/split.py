"""Splitting oversized texts at natural boundaries, by agglomerative merging.

A text longer than the limit is cut into atomic segments at every natural boundary. Adjacent
pairs wait in a heap; the weakest boundary is merged first, of equals the pair with the
smallest combined size, then the leftmost, as long as the combined size plus the overlap fits
the limit. What remains are the strongest cuts. Every piece but the first begins `overlap`
characters before its cut. Characters are code points.

Boundaries from strong to weak: blank line, line end, sentence end, clause end, space; inside a
word longer than a piece, before any character that isn't a combining mark, joiner or the
second half of a line end. No boundary lies in the first `overlap` characters, so that every
overlap is full.

Null and empty texts, and texts within the limit, are one piece: themselves. Joining all
pieces without their overlaps gives back the stored text.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 150

_GAP = r"[^\S\r\n]+(?![\r\n])"
_BOUNDARY = re.compile(
    r"(?P<blank>(?:\r\n|\n|\r)[^\S\r\n]*(?:(?:\r\n|\n|\r)[^\S\r\n]*)+)|(?P<line>\r\n|\n|\r)"
    rf"|(?P<sentence>[.!?…。！？][\"'»”)\]]*{_GAP})|(?P<clause>[,;:—|]{_GAP})|(?P<space>[^\S\r\n]+)"
)
_STRENGTH = {"blank": 5, "line": 4, "sentence": 3, "clause": 2, "space": 1}


def _hard_cut(text: str, at: int, low: int) -> int:
    """The last place at or before `at`, above `low`, that splits no character cluster."""
    k = at
    while k > low and (unicodedata.combining(text[k]) or text[k] in "‍️" or text[k - 1] == "‍" or text[k - 1 : k + 1] == "\r\n"):
        k -= 1
    return k if k > low else at


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Where `text` is cut, by merging the weakest boundaries first; [] if it fits."""
    n, room = len(text), limit - overlap
    if n <= limit:
        return []
    ends, strengths = [], []
    for m in _BOUNDARY.finditer(text):
        if overlap <= m.end() < n:
            ends.append(m.end())
            strengths.append(_STRENGTH[m.lastgroup])
    # atomic segments that are themselves too large get hard cuts
    starts, levels, last = [0], [9], 0
    for end, level in [*zip(ends, strengths, strict=True), (n, 9)]:
        while end - last > room:
            last = _hard_cut(text, last + room, max(last, overlap))
            starts.append(last)
            levels.append(0)
        if end < n:
            starts.append(end)
            levels.append(level)
        last = end
    count = len(starts)
    stop = [*starts[1:], n]
    left, right = [i - 1 for i in range(count)], [i + 1 for i in range(count)]
    alive = [True] * count
    # an entry stands for the boundary at the start of segment i
    heap = [(levels[i], stop[i] - starts[i - 1], i, starts[i - 1], stop[i]) for i in range(1, count)]
    heapq.heapify(heap)
    while heap:
        level, size, i, begin, end = heapq.heappop(heap)
        if not alive[i]:
            continue
        p = left[i]
        if starts[p] != begin or stop[i] != end:  # a neighbour has grown since: take the new size
            size = stop[i] - starts[p]
            if size + overlap <= limit:
                heapq.heappush(heap, (level, size, i, starts[p], stop[i]))
            continue
        if size + overlap > limit:
            continue
        alive[i], stop[p], right[p] = False, stop[i], right[i]
        if right[i] < count:
            left[right[i]] = p
    return [starts[i] for i in range(1, count) if alive[i]]


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece, overlaps included."""
    cuts = cut_points(text, limit, overlap)
    return [(max(0, a - overlap) if a else 0, b) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]


def split_texts(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, only_oversized: bool = False) -> DataFrame:
    """(key, piece_no, start_at, piece): the pieces of every row's text.

    Rows delivered again with the same key and text count once. Only oversized texts go
    through Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(k, i, s, t[s:e]) for k, t in zip(b["_key"], b["_text"], strict=True) for i, (s, e) in enumerate(pieces_of(t, limit, overlap))]
            yield pd.DataFrame(out, columns=["_key", "piece_no", "start_at", "piece"])

    schema = f"_key {kind}, piece_no int, start_at int, piece string"
    long = rows.where(F.length("_text") > limit).dropDuplicates(["_key", "_text"]).mapInPandas(run, schema)
    if not only_oversized:
        short = rows.where(F.col("_text").isNull() | (F.length("_text") <= limit)).dropDuplicates(["_key", "_text"])
        long = long.unionByName(short.select("_key", F.lit(0).alias("piece_no"), F.lit(0).alias("start_at"), F.col("_text").alias("piece")))
    return long.withColumnRenamed("_key", key)
