"""Texts cut off at a field limit or in transfer.

1. Per source, histograms of text length in characters and in bytes are tested for spikes: a
   length that many times more texts have than the lengths around it, beyond chance, is a field
   limit; at the source's greatest length weaker evidence will do. A byte limit that falls
   inside a character leaves up to three bytes less.
2. A text at a spike without terminal punctuation is flagged (`limit`), unless its ending is
   complete.
3. A text elsewhere without terminal punctuation is flagged (`transfer`) only on evidence from
   the corpus that its ending is not complete (a transfer that broke off leaves no spike).

An ending is complete if it is a table row closed by its bar; or, away from spikes, a line that
the rest of the corpus holds as a whole line (list entry, heading, reference, signature) at least
about a third as often as all longer lines beginning with it; or if the last words are mostly followed by the end of a sentence
or line wherever else they occur, by the longest context of up to seven words that occurs
elsewhere (one word alone only if it is long and frequent) (messages without full stops). Figures are alike in all of these.

The evidence is one pass over the corpus in Arrow batches: digests of line beginnings and of
word contexts are worked out by array operations and counted per batch. Only digests that some
open ending asks for leave the pass: a bitmap of fixed size, made from all asked
digests, filters them (`digests`).

Null, empty and blank texts are never cut. A text that ends in a replacement character was cut
inside a character, an open ending followed by white space before the next word. All counts are over all rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from leafmill.llm.digests import ODD, bitmap, broadcast_filter, mixed, parts, passes, word_digest
from leafmill.session import counted_side, cut

#: A spike has so many times the texts of the mean length around it (within SPIKE_AROUND, a
#: tenth of a text at least), and chance would give it with at most this probability: anywhere,
#: and at the greatest length of the source.
SPIKE_TIMES, SPIKE_AROUND, SPIKE_MEAN, SPIKE_CHANCE, SPIKE_CHANCE_AT_MOST = 8.0, 50, 0.1, 1e-6, 1e-2
#: Words of context that tell whether an ending is complete.
CONTEXT = 7
#: Longest line that may be a list entry, heading, reference or signature.
SHORT_LINE = 80

_SPACES = " \t\n\x0b\x0c\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_STOPS, _AFTER_STOP, _CLOSERS = ".!?…。！？।؟", "\"'»”’)]*_", ")]»”\""


def rstripped(text: Column) -> Column:
    return F.rtrim(text, F.lit(_SPACES))


def closed(text: Column) -> Column:
    """Whether a text without white space at its end ends in terminal punctuation."""
    return F.right(F.rtrim(text, F.lit(_AFTER_STOP)), F.lit(1)).isin(*_STOPS) | F.right(text, F.lit(1)).isin(*_CLOSERS)


def length_spikes(rows: DataFrame) -> DataFrame:
    """(source, unit, size): lengths in `chars` or `bytes` at which a source's texts pile up.

    `rows` has source, chars, bytes. The histogram is aggregated before it is looked at, and
    each length is compared with those within `SPIKE_AROUND` of it. Chance is bounded by
    Chernoff's bound of the Poisson tail, so the test needs no least count.
    """
    sizes = rows.select("source", F.explode(F.map_from_arrays(F.array(F.lit("chars"), F.lit("bytes")), F.array("chars", "bytes"))).alias("unit", "size"))
    histogram = sizes.groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("source", "unit")
    around = whole.orderBy("size").rangeBetween(-SPIKE_AROUND, SPIKE_AROUND)
    # a limit leaves nothing above it: the mean is over the lengths below and above separately
    others = F.sum("n").over(around) - F.col("n")
    tested = histogram.withColumn("others", others).withColumn("mean", F.greatest(others / F.lit(SPIKE_AROUND), F.lit(SPIKE_MEAN))).withColumn("greatest", F.max("size").over(whole))
    surprise = F.col("n") * F.log(F.col("n") / F.col("mean")) - F.col("n") + F.col("mean")
    # a greatest length without others near it may be the only length there is
    lenient = (F.col("size") == F.col("greatest")) & (F.col("others") > 0)
    enough = F.when(lenient, F.lit(-math.log(SPIKE_CHANCE_AT_MOST))).otherwise(F.lit(-math.log(SPIKE_CHANCE)))
    return tested.where((F.col("n") >= SPIKE_TIMES * F.col("mean")) & (surprise >= enough)).select("source", "unit", "size")


# --- digests, by array operations ---------------------------------------------------------------

_BARE = re.compile(r"^[\"'(«“\[*_]+|[.,;:!?…\"')»”\]*_]+$")
_ENDED = re.compile(rf"[{re.escape(_STOPS)}][{re.escape(_AFTER_STOP)}]*$|[{re.escape(_CLOSERS)}]$")
_BREAK, _TABLE_ROW = "\x01", "\x02"
_LINES_SALT, _WORDS_SALT = 0x51ED27, 0xA24BAED4
#: Words whose digests are kept between batches.
_KEPT = 200_000


def _plain(texts: pa.Array) -> pa.Array:
    """Lower case, figures alike."""
    return pc.replace_substring_regex(pc.utf8_lower(texts), pattern=r"\pN+", replacement="9")


def _prefix_digests(lines: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places of the lines of that length or longer, digests of their first characters)."""
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(lines) else np.zeros(0, dtype=np.int64)
    state, at = np.zeros(len(lines), dtype=np.uint64), np.arange(len(lines))
    for k in range(min(SHORT_LINE, int(sizes.max(initial=0)))):
        at = at[sizes[at] > k]
        state[at] = state[at] * ODD + points[starts[at] + k] + np.uint64(1)
        yield k + 1, at, mixed(state[at], _LINES_SALT + k)


class _Words:
    """Digest, end of sentence and length of each distinct word; kept between batches."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, bool, int]] = {}

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.known) > _KEPT:
            self.known.clear()
        out = []
        for w in words:
            got = self.known.get(w)
            if got is None:
                bare = _BARE.sub("", w)
                got = self.known[w] = (word_digest(bare), _ENDED.search(w) is not None, len(bare))
            out.append(got)
        digests, ended, long = zip(*out, strict=True) if out else ((), (), ())
        return np.array(digests, dtype=np.uint64), np.array(ended, dtype=bool), np.array(long, dtype=np.int64)


def _in_words(texts: pa.Array, cache: _Words) -> dict[str, np.ndarray]:
    """The words of plain texts in order, as parallel arrays; lines of tables are left out."""
    if pc.any(pc.match_substring(texts, "|")).as_py():
        texts = pc.replace_substring_regex(texts, pattern=r"(?m)^[^\S\n\r]*\|[^\n\r]*", replacement=_TABLE_ROW)
        texts = pc.replace_substring(texts, pattern="|", replacement=" ")
    texts = pc.replace_substring_regex(texts, pattern=r"\r\n|\r|\n", replacement=f" {_BREAK} ")
    lists = pc.utf8_split_whitespace(texts)
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    digests, ended, long = cache.of(names)
    # 0: nothing, 1: line break, 2: table row, 3: word
    kinds = np.array([0 if w == "" else 1 if w == _BREAK else 2 if w == _TABLE_ROW else 3 for w in names], dtype=np.int8)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    kept = kinds[codes] > 0 if len(codes) else np.zeros(0, dtype=bool)
    codes, rows = codes[kept], rows[kept]
    kind = kinds[codes]
    n = len(codes)
    at = np.arange(n)
    first = np.concatenate([[True], rows[1:] != rows[:-1]]) if n else np.zeros(0, dtype=bool)
    # place in the line: words since the last break or beginning of the text
    border = np.where(kind < 3, at, np.where(first, at - 1, -1))
    place = at - np.maximum.accumulate(border) - 1 if n else at
    following = np.concatenate([kind[1:] < 3, [True]]) | np.concatenate([first[1:], [True]]) if n else kept
    # the last of a text that isn't a mere line break
    solid = at[kind > 1]
    tails = solid[np.concatenate([rows[solid[1:]] != rows[solid[:-1]], [True]])] if len(solid) else solid
    return {"digest": digests[codes], "ended": ended[codes], "long": long[codes], "row": rows, "word": kind == 3, "place": place, "last": following, "tail": np.isin(at, tails)}


def _context_digests(w: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of words, places of words with so many in the line up to them, digests of these)."""
    at, state = np.nonzero(w["word"])[0], w["digest"].copy()
    for k in range(CONTEXT):
        if k:
            at = at[w["place"][at] >= k]
            state[at] += w["digest"][at - k] * np.uint64(pow(int(ODD), k, 2**64))
        yield k + 1, at, mixed(state[at], _WORDS_SALT + k)


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open endings with the digests they ask for; the column `line` goes."""
    cache = _Words()
    for b in batches:
        lines = b.column("line")
        shapes, contexts, longs = [], [], []
        for part in parts(lines):
            plain = _plain(part)
            trimmed = pc.utf8_trim_whitespace(plain).to_pylist()
            shape: list[int | None] = [None] * len(trimmed)
            for k, at, d in _prefix_digests([t[: SHORT_LINE + 1] for t in trimmed]):
                for i, x in zip(at, d.view(np.int64), strict=True):
                    if len(trimmed[i]) == k:
                        shape[i] = int(x)
            mine: list[list[int]] = [[] for _ in trimmed]
            long = [0] * len(trimmed)
            w = _in_words(plain, cache)
            for k, at, d in _context_digests(w):
                ends = w["tail"][at]
                for i, j, x in zip(w["row"][at[ends]], at[ends], d[ends].view(np.int64), strict=True):
                    mine[i].append(int(x))
                    long[i] = int(w["long"][j])
            shapes += shape
            contexts += mine
            longs += long
        kept = [n for n in b.schema.names if n != "line"]
        made = [pa.array(shapes, pa.int64()), pa.array(contexts, pa.list_(pa.int64())), pa.array(longs, pa.int32())]
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), *made], names=[*kept, "shape", "contexts", "long"])


TOLD = "kind int, digest bigint, a bigint, b bigint"


def _telling(bits):
    """One pass over texts: (0, line digest, equal lines, longer lines) and (1, context digest,
    times, ends), for the digests that the filter `bits` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_bits, cache = bitmap(bits), _Words()

        def summed(kind: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            d, a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
            one, back = np.unique(d, return_inverse=True)
            sums = [np.bincount(back, weights=x, minlength=len(one)).astype(np.int64) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(one), kind, np.int32)), pa.array(one.view(np.int64)), *map(pa.array, sums)], names=["kind", "digest", "a", "b"])

        for batch in batches:
            lines_found, words_found = [], []
            for part in parts(batch.column(0)):
                plain = _plain(part)
                lines = pc.utf8_trim_whitespace(pc.split_pattern_regex(plain, pattern=r"\r\n|\r|\n").flatten())
                # one character more tells a longer line from an equal one
                counted = pc.value_counts(pc.utf8_slice_codeunits(lines, 0, SHORT_LINE + 1))
                held, n = counted.field(0).to_pylist(), counted.field(1).to_numpy(zero_copy_only=False)
                sizes = np.array([len(x) for x in held], dtype=np.int64)
                for k, at, d in _prefix_digests(held):
                    hit = passes(asked_bits, d)
                    if hit.any():
                        equal = sizes[at[hit]] == k
                        lines_found.append((d[hit], np.where(equal, n[at[hit]], 0), np.where(equal, 0, n[at[hit]])))
                w = _in_words(plain, cache)
                ends = w["ended"] | w["last"]
                # how an open text would have gone on isn't known
                known = ~(w["tail"] & ~w["ended"])
                for _, at, d in _context_digests(w):
                    hit = passes(asked_bits, d) & known[at]
                    words_found.append((d[hit], np.ones(int(hit.sum())), ends[at[hit]].astype(np.float64)))
            yield summed(0, lines_found)
            yield summed(1, words_found)

    return run


def cut_texts(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, reason): texts that were cut; `reason` is `limit` or `transfer`."""
    col = F.col(f"`{text}`")
    rows = documents.where(rstripped(col) != "").select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), col.alias("text"))
    sized = rows.select("*", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    spikes = length_spikes(sized.select("source", "chars", "bytes"))

    # open endings
    end = rstripped(F.col("text"))
    ends = sized.select("key", "source", "chars", "bytes", F.substring_index(F.substring_index(end, "\n", -1), "\r", -1).alias("line"), (end.endswith("�") | (end != F.col("text"))).alias("broken"))
    flat = F.ltrim(F.col("line"), F.lit(_SPACES))
    ends = ends.where(~closed(F.col("line")) & ~(flat.startswith("|") & flat.endswith("|") & (F.length(flat) > 1)))
    kinds = StructType([*(ends.schema[n] for n in ("key", "source", "chars", "bytes", "broken")), StructField("shape", LongType()), StructField("contexts", ArrayType(LongType())), StructField("long", IntegerType())])
    open_ends = cut(ends.select("key", "source", "chars", "bytes", "broken", "line").mapInArrow(_asking, kinds))

    at = spikes.select(F.col("source").alias("limit_source"), "unit", F.col("size").alias("limit_size"))
    limits = at.groupBy("limit_source").agg(
        F.collect_set(F.when(F.col("unit") == "chars", F.col("limit_size"))).alias("limit_chars"),
        F.collect_set(F.when(F.col("unit") == "bytes", F.col("limit_size"))).alias("limit_bytes"),
    )
    spiked = F.coalesce(F.array_contains("limit_chars", F.col("chars")), F.lit(False)) | F.coalesce(
        F.exists("limit_bytes", lambda b: (F.col("bytes") <= b) & (F.col("bytes") > b - 4)), F.lit(False)
    )
    placed = open_ends.join(limits, F.col("source").eqNullSafe(F.col("limit_source")), "left").select("key", "source", "broken", "shape", "contexts", "long", spiked.alias("spiked"))

    # one pass over the corpus for all evidence
    bits = broadcast_filter(open_ends.select(F.explode(F.array_compact(F.concat("contexts", F.array("shape")))).alias("d")))
    told = cut(rows.select("text").mapInArrow(_telling(bits), TOLD).groupBy("kind", "digest").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))

    # evidence 1: other lines equal to the ending, against all lines that begin with it and go on
    begins = placed.where("shape is not null").groupBy("shape").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.when(~F.col("broken") & ~F.col("spiked"), F.col("key"))).alias("texts"))
    lines = told.where("kind = 0").select(F.col("digest").alias("shape"), F.col("a").alias("equal"), F.col("b").alias("longer"))
    # the ending is no evidence of itself, nor are its text delivered again and endings at spikes
    others = F.col("equal") - F.col("rows") + F.col("texts") - 1
    seen = lines.join(begins, "shape").where((others >= 2) & (others >= 0.3 * F.col("longer"))).select("shape", F.lit(True).alias("entry"))
    judged = placed.join(counted_side(seen), "shape", "left").where(F.col("entry").isNull() | F.col("broken") | F.col("spiked"))

    # evidence 2: what follows the same last words elsewhere
    asked = judged.select("key", "long", F.posexplode("contexts").alias("k", "digest"))
    words = told.where("kind = 1").select("digest", F.col("a").alias("times"), F.col("b").alias("ends"))
    answers = asked.join(counted_side(words), "digest").groupBy("key").agg(F.max(F.struct("k", "times", "ends", "long")).alias("best"))

    known = judged.select("key", "source", "broken", "spiked").join(answers, "key", "left")
    share = F.col("best.ends") / F.col("best.times")
    trusted = (F.col("best.k") >= 1) | ((F.col("best.long") >= 4) & (F.col("best.times") >= 20))
    strong = (share >= 0.9) & (F.col("best.k") >= 1)
    known = cut(known.select("key", "source", "broken", "spiked", share.alias("share"), strong.alias("strong"), trusted.alias("trusted"), "best"))
    # a source that writes without full stops has mostly complete open endings: weaker evidence will do
    habit = known.where(~F.col("spiked")).groupBy(F.col("source").alias("habit_source")).agg(F.avg(F.coalesce(F.col("strong"), F.lit(False)).cast("double")).alias("habit"))
    known = known.join(habit, F.col("source").eqNullSafe(F.col("habit_source")), "left")
    enough = F.greatest(F.lit(0.05), 0.5 * (1.0 - F.coalesce("habit", F.lit(0.0))))
    # at a limit only strong evidence lets an ending pass as complete
    complete = F.when(F.col("spiked"), (F.col("share") >= 0.95) & (F.col("best.k") >= 2) & (F.col("best.times") >= 5)).otherwise(F.col("trusted") & (F.col("share") >= enough))
    flagged = known.where(F.col("broken") | ~F.coalesce(complete, F.lit(False)))
    return flagged.select(F.col("key").alias(key), F.col("source").alias(source), F.when(F.col("spiked"), "limit").otherwise("transfer").alias("reason"))


def cut_shares(documents: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(source, texts, cut_texts, share): how often each source cuts; blank texts don't count."""
    every = documents.where(rstripped(F.col(f"`{text}`")) != "").groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("texts"))
    some = cut_texts(documents, key, text, source).groupBy(F.col(source).alias("s")).agg(F.count(F.lit(1)).alias("cut_texts"))
    both = every.join(some, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").na.fill(0, ["cut_texts"])
    return both.withColumn("share", F.round(F.col("cut_texts") / F.col("texts"), 6)).withColumnRenamed("source", source)
