"""Encoding of a corpus by a byte-level BPE vocabulary.

Texts are split into words by the vocabulary's pattern. Each batch inserts its distinct,
not yet known words into a trie in byte order, which is a depth-first walk: going from one
word to the next, the states on the shared prefix stay and only the new suffix is worked
out. The state of a node is the last token of the encoding of its prefix. It is the one
token that ends the prefix and is compatible with the state where it starts: a pair is
compatible if merging in rank order would leave it standing. Following the states backwards
from a word's end gives its tokens.

Null and empty texts have an empty list. A special token's string in a text is ordinary
text. Texts of any length are encoded whole; rows are never moved between partitions.
"""

from __future__ import annotations

import os
import unicodedata
from base64 import b64decode
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files.
VOCABULARY_FOLDER = "/opt/tokenizers"
# Fixed value: the public word pattern of this family of vocabularies.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encodings a Python worker keeps; beyond, it starts again with an empty store.
KEPT_WORDS = 500_000


class WordTrie:
    """Encodes words by propagating last-token states over shared prefixes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        for piece, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(piece) > 1 and (two := self._split(piece, rank)):
                self.parts[rank] = two
                self.merged[two] = rank

    def _split(self, piece: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge is `piece`: merge in rank order, below its own rank."""
        ids = [self.ranks[piece[i : i + 1]] for i in range(len(piece))]
        at = [piece[i : i + 1] for i in range(len(piece))]
        while len(ids) > 2:
            best = min((r, i) for i in range(len(at) - 1) if (r := self.ranks.get(at[i] + at[i + 1], rank)) < rank) if any(self.ranks.get(at[i] + at[i + 1], rank) < rank for i in range(len(at) - 1)) else None
            if best is None:
                return None
            i = best[1]
            at[i : i + 2] = [at[i] + at[i + 1]]
            ids[i : i + 2] = [best[0]]
        return ids[0], ids[1]

    def compatible(self, a: int, b: int) -> bool:
        """Whether `a` then `b` stay two tokens: undo merges, latest first, and look whether an
        earlier one would have joined the parts that meet."""
        got = self.known.get((a, b))
        if got is None:
            got = self.known[a, b] = self._compatible(a, b)
        return got

    def _compatible(self, a: int, b: int) -> bool:
        top = 1 << 40  # merges of a rank below this one may still act across the border
        while True:
            if self.merged.get((a, b), top) < top:
                return False
            undo_left = a in self.parts and (a > b or b not in self.parts)
            if undo_left:
                top, a = a, self.parts[a][1]
            elif b in self.parts:
                top, b = b + 1, self.parts[b][0]
            else:
                return True

    def encode(self, words: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        """Encodings of distinct words, given in any order."""
        out: dict[bytes, tuple[int, ...]] = {}
        ranks, longest = self.ranks, self.longest
        state: list[int] = []  # state[i]: last token of the first i + 1 bytes
        before = b""
        for word in sorted(words):
            shared = len(os.path.commonprefix((before, word)))
            del state[shared:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = ranks.get(word[start:end])
                    if token is not None and (start == 0 or self.compatible(state[start - 1], token)):
                        state.append(token)
                        break
            ids, end = [], len(word)
            while end:
                ids.append(state[end - 1])
                end -= len(self.bytes_of[ids[-1]])
            out[word] = tuple(reversed(ids))
            before = word
        return out


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to ids, from lines of base64 and rank."""
    return {b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


@lru_cache(maxsize=65536)
def _unassigned(char: str) -> bool:
    return unicodedata.category(char) == "Cn"


def words_of(text: str, pattern: regex.Pattern) -> list[str]:
    """The pattern's words. Characters without a Unicode category in the tables of this Python
    count as symbols, as they do in the vocabulary's own library."""
    if text.isascii():
        return pattern.findall(text)
    strange = {c for c in set(text) if c > "ԯ" and _unassigned(c)}
    if not strange:
        return pattern.findall(text)
    plain = text.translate({ord(c): "�" for c in strange})
    return [text[m.start() : m.end()] for m in pattern.finditer(plain)]


def token_ids(df: DataFrame, key: str, text: str, ranks_path: str | None = None, pattern: str = WORD_PATTERN) -> DataFrame:
    """(key, ids): the token ids of every row's text."""
    path = ranks_path or os.path.join(VOCABULARY_FOLDER, "byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, split, store = WordTrie(read_ranks(raw.value)), regex.compile(pattern), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [words_of(t, split) if t else [] for t in part.column(1).to_pylist()]
                new = set(chain.from_iterable(texts)) - store.keys()
                if len(store) + len(new) > KEPT_WORDS:
                    store.clear()
                    new = set(chain.from_iterable(texts))
                coded = trie.encode({w.encode("utf-8", "surrogatepass") for w in new})
                store.update((w, coded[w.encode("utf-8", "surrogatepass")]) for w in new)
                rows = [list(chain.from_iterable(map(store.__getitem__, ws))) for ws in texts]
                ends = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
                flat = np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=int(ends[-1]))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["_key", "ids"])

    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, f"_key {key_type}, ids array<int>").withColumnRenamed("_key", key)
