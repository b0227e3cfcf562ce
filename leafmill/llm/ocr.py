"""Repair of text recognised from scanned pages.

Layout: running headers (the document's title, also shortened or reordered, or its short
name) and page-number lines are told apart from body text; words divided at line ends are
joined, and keep their hyphen if the corpus writes it.

Noisy channel. A form may be a misreading of another form of the corpus if both have the same
spelling once confusable characters are alike (`spread`, an equality join) and an alignment
shows which confusions it takes, whatever their number. The probability of each confusion is
estimated from all records by expectation maximisation: misreadings over opportunities. A count
is a true count only beyond what misreadings of other forms explain (`beyond`); this holds for
words and, inside a lattice, for bigrams, so a word that the corpus really writes keeps its
likelihood and a repeated misreading has none. All of a form's possible meanings are options
beside the form as it stands; the sequence with the greatest product of confusion probabilities
and bigram likelihood is decoded by Viterbi. Words without options cut a line's lattice into
parts that are decoded apart with the same result, so each distinct part of the corpus is
decoded once.

Counts are over all records. What grows with the corpus meets in joins; two bitmaps of fixed
size let only words with options, and only bigrams that a lattice asks for, leave the passes over the text.

Null and empty texts have no noise and stay as they are. A record delivered again counts once. A
null title, short name or page only means that such a line can't be recognised.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.digests import ODD, bitmap, broadcast_filter, mixed, parts, passes, word_digest
from leafmill.session import counted_side, cut

#: Prior probability of one confusion, worth `PRIOR_WEIGHT` opportunities; steps of the estimate.
CONFUSION_P, PRIOR_WEIGHT, STEPS = 0.001, 1000.0, 3
#: Misreadings of one word may differ from their expected number by so many standard deviations,
#: where the rate itself varies from word to word by so many times its size (figures: in few places).
DEVIATIONS, VARIES, FIGURES_VARY = 3.0, 3.0, 30.0
#: Weight of the unigram in the bigram estimate.
SMOOTH = 5.0
NUMBER = "<num>"

# Fixed values: "seen=meant" character confusions of scanned print.
CONFUSIONS = "c=e l=i @=a †=t 0=o 5=s 1=l |=l ii=u cl=d rn=m 9=g li=h ſ=f ſ=s 6=b vv=w m=rn h=li 8=b 3=e $=s €=e i=l e=c"
# Letters seen for figures inside numbers.
FIGURES = "O=0 o=0 Q=0 D=0 l=1 I=1 i=1 |=1 Z=2 z=2 S=5 s=5 B=8 b=6 G=6 q=9 g=9"
# Marks that divide a word at a line end.
HYPHENS = "-¬­‐"

_PAIRS = [tuple(p.split("=")) for p in CONFUSIONS.split()]
_FIGURE = dict(p.split("=") for p in FIGURES.split())
_NUMBER = re.compile(r"[\d.,·]*\d[\d.,·]*")
_ODD_NUMBER = re.compile(r"(?=[^\d]*\d)[\dOoQDlIi|ZzSsBbGqg]+(?:[.,·][\dOolI|ZSB]+)?")
_CORE = re.compile(r"^[^\w@†ſ|$€]*(.*?)[^\w@†ſ$€]*$", re.S)
_BREAK = re.compile(rf"(\w[\w@†ſ|'’-]*)([{HYPHENS}])[ \t]*$")
BREAK = "\u0001"


def skeleton(text: str) -> str:
    """A spelling in which confusable characters are the same."""
    t = text.lower()
    for a, b in (("ii", "u"), ("cl", "d"), ("rn", "m"), ("li", "h"), ("vv", "w")):
        t = t.replace(a, b)
    return t.translate(_SKELETON)


_SKELETON = str.maketrans("@†051|i9ſ6ce", "atoslllgfbee")
_SMALL_WORDS = frozenset(("for", "of", "the"))


@lru_cache(maxsize=10_000)
def _names(title: str, short_name: str) -> tuple[frozenset[str], str]:
    """Skeletons of a title's words and of a short name."""
    return frozenset(w for w in _LETTERS.findall(skeleton(title)) if w not in _SMALL_WORDS), "".join(_LETTERS.findall(skeleton(short_name)))


@lru_cache(maxsize=200_000)
def _skeleton_words(token: str) -> tuple[str, ...]:
    return tuple(_LETTERS.findall(skeleton(token)))


@lru_cache(maxsize=200_000)
def _of_title(title: str, short_name: str, word: str) -> bool:
    """Whether a word is one of the title's, perhaps misread."""
    names, _ = _names(title, short_name)
    return word in names or any(near(word, n) for n in names)


def _spells(tokens: list[str], short: str) -> bool:
    """Whether the tokens' letters and figures are the short name, also spaced out."""
    letters = ""
    for t in tokens:
        letters += "".join(_skeleton_words(t))
        if not short.startswith(letters):
            return False
    return letters == short


def near(a: str, b: str) -> bool:
    """Whether two words differ by few enough edits to be the same misread word."""
    room = 0 if len(b) < 4 else 1 if len(b) < 8 else 2
    if abs(len(a) - len(b)) > room:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] <= room


@lru_cache(maxsize=200_000)
def core_of(token: str) -> str:
    """A token without the punctuation around it."""
    return _CORE.match(token)[1]


@lru_cache(maxsize=200_000)
def normal(core: str) -> str:
    """The form under which a token is counted: figures are one form, unless letters stand among them."""
    return NUMBER if _NUMBER.fullmatch(core) else core if _ODD_NUMBER.fullmatch(core) else core.lower()


_PAGE_LINE = re.compile(r"[\W_]*(?:page|p|pg|pag|página)?[\s.:]*(?<!\d)(\d+)(?!\d)(?:\s*(?:of|/|de|sur)\s*\d+)?[\W_]*", re.I)
_PAGE_BEFORE = re.compile(r"^[\W_]*(?:page|p)?[\s.]*(\d+)(?:\s+of\s+\d+)?(?:\s{2,}|\s*[|–-]+\s*)", re.I)
_PAGE_AFTER = re.compile(r"(?:\s{2,}|\s*\|\s*|\s*\.{3,}\s*|\s+[–-]\s*)[\W_]*(?:page|p)?[\s.]*(\d+)(?:\s+of\s+\d+)?[\W_]*$", re.I)
_BARE = re.compile(r"\s*[\d.,]+\s*")
_LINE_END = re.compile(r"\r\n|\n|\r")
_LETTERS = re.compile(r"[^\W_]+")


def _without_page(line: str, page: str | None) -> str:
    """A header line without the page number that stands apart from it."""
    for pattern in (_PAGE_BEFORE, _PAGE_AFTER) if page is not None and page in line else ():
        if (m := pattern.search(line)) and m[1] == page:
            line = line[: m.start()] + " " + line[m.end() :]
    return line.strip()


def read_layout(text: str, page: int | None, title: str | None, short_name: str | None) -> tuple[list[list[str]], bool, bool]:
    """(body lines as tokens, a header was there, a page number was there).

    A word divided at a line end is one token: its halves, joined by the control character
    `BREAK` after the first half's hyphen, at the place of the first. Blank lines are [].
    """
    lines = _LINE_END.split(text)
    names, short = _names(title or "", short_name or "")
    number = str(int(page)) if page is not None and page == page else None
    header = pageno = False
    body: list[str] = []
    for k, line in enumerate(lines):
        flat = line.strip()
        if not flat or flat[0] == "|":
            body.append(line)
            continue
        is_header = False
        if names or short:
            rest = _without_page(flat, number)
            tokens = rest.split()
            if short and _spells(tokens, short):
                is_header = True
            elif names and rest and rest[-1] not in ".,;" and (rest[0].isupper() or not rest[0].isalpha()):
                # most lines end at their first word
                if all(w in _SMALL_WORDS or _of_title(title or "", short_name or "", w) for t in tokens for w in _skeleton_words(t)):
                    words = [w for t in tokens for w in _skeleton_words(t) if w not in _SMALL_WORDS]
                    is_header = 2 * len(words) >= len(names) and sum(not w.isdigit() for w in words) >= 2 and any(w in names for w in words)
            if is_header:
                header = True
                pageno |= rest != flat.strip()
                continue
        if number is not None and number in flat and (m := _PAGE_LINE.fullmatch(flat)) and m[1] == number:
            # a bare number between bare numbers is a table column's
            column = _BARE.fullmatch(line) and ((k and _BARE.fullmatch(lines[k - 1])) or (k + 1 < len(lines) and _BARE.fullmatch(lines[k + 1])))
            if not column:
                pageno = True
                continue
        body.append(line)
    out: list[list[str]] = []
    held: str | None = None
    for line in body:
        if not line.strip():
            if held is None:
                out.append([])
            continue
        tokens = line.replace("|", " | ").split() if line.lstrip()[:1] == "|" else line.split()
        if held is not None:
            out[-1][-1] = held + BREAK + tokens.pop(0)
            held = None
            if not tokens:
                continue
        if tokens[-1][-1] in HYPHENS and line.lstrip()[:1] != "|" and _BREAK.search(line):
            held = tokens[-1]
        out.append(tokens)
    return out, header, pageno


def break_forms(token: str) -> tuple[str, str]:
    """(joined, hyphenated) counted forms of a divided word."""
    a, b = token.split(BREAK, 1)
    b = b.replace(BREAK, "")
    return core_of(a[:-1] + b).lower(), core_of(a[:-1] + "-" + b).lower()


# --- the channel -------------------------------------------------------------------------------

#: Confusable characters to one; then characters to the pairs that they are confused with.
_ALIKE = ("c3€i1|@†05$ſf968", "eeelllatossssgbb")
_WIDE = (("d", "el"), ("h", "ll"), ("u", "ll"), ("m", "rn"), ("w", "vv"))


def spread(form: Column) -> Column:
    """A spelling that is the same for all forms that confusions may turn into each other."""
    out = F.translate(F.lower(form), *_ALIKE)
    for one, two in _WIDE:
        out = F.replace(out, F.lit(one), F.lit(two))
    return out


def confusions(seen: str, meant: str) -> tuple[str, ...] | None:
    """The fewest confusions ("seen=meant") that turn `meant` into `seen`; None if none do."""
    low = seen.lower()
    best: dict[tuple[int, int], tuple[int, tuple[str, ...]]] = {(0, 0): (0, ())}
    for i in range(len(seen) + 1):
        for j in range(len(meant) + 1):
            if (here := best.get((i, j))) is None:
                continue
            steps = [(i + 1, j + 1, None)] if i < len(seen) and j < len(meant) and low[i] == meant[j] else []
            steps += [(i + len(a), j + len(b), f"{a}={b}") for a, b in _PAIRS if low.startswith(a, i) and meant.startswith(b, j)]
            for x, y, name in steps:
                made = here if name is None else (here[0] + 1, (*here[1], name))
                if (x, y) not in best or made[0] < best[x, y][0]:
                    best[x, y] = made
    got = best.get((len(seen), len(meant)))
    return got[1] if got else None


def figures_meant(form: str) -> tuple[str, tuple[str, ...]] | None:
    """(number, confusions) that a form with letters among its figures may stand for."""
    if _NUMBER.fullmatch(form) or not _ODD_NUMBER.fullmatch(form):
        return None
    odd = [c for c in form if c in _FIGURE]
    if len(form) > 4 and 2 * len(odd) > len(form):
        return None
    return "".join(_FIGURE.get(c, c) for c in form), tuple(f"#{c}={_FIGURE[c]}" for c in odd)


_FORM = re.compile(r"[^\W\d_]+(?:[-'’/][^\W\d_]*)*")


def is_word(form: str) -> bool:
    """Whether a form may be meant: letters, perhaps with hyphens, apostrophes or bars inside."""
    return _FORM.fullmatch(form) is not None


def _beyond(n, explained, varies):
    return n - (explained + DEVIATIONS * (explained + (varies * explained) ** 2) ** 0.5 + 1.0)


def beyond(n: float, explained: float, varies: float = VARIES) -> float:
    """The part of a count that `explained` expected misreadings can't make up."""
    return max(0.0, _beyond(n, explained, varies))


def viterbi(options: list[list[tuple[str, float]]], bigrams: dict[tuple[str, str], float], counts: dict[str, float], total: float, first: str | None) -> list[int]:
    """Index of the best option at each place; an option is (counted form, cost in confusions of `CONFUSION_P`)."""

    def word_p(w: str) -> float:
        return (counts.get(w, 0.0) + 0.1) / (total + 1.0)

    def step(a: str | None, w: str) -> float:
        if a is None:
            return math.log(word_p(w))
        return math.log((bigrams.get((a, w), 0.0) + SMOOTH * word_p(w)) / (counts.get(a, 0.0) + SMOOTH))

    cost = math.log(CONFUSION_P)
    best = [(step(first, w) + k * cost, None) for w, k in options[0]]
    trail = [best]
    for before, here in itertools.pairwise(options):
        best = [max((p[0] + step(a, w), i) for i, (p, (a, _)) in enumerate(zip(trail[-1], before, strict=True))) for w, _ in here]
        best = [(s + k * cost, i) for (s, i), (_, k) in zip(best, here, strict=True)]
        trail.append(best)
    at = max(range(len(best)), key=lambda i: (best[i][0], -i))
    picks = []
    for row in reversed(trail):
        picks.append(at)
        at = row[at][1]
    return picks[::-1]


def _meant(seen: str, form: str) -> str:
    """The replacement for `seen` whose counted form is `form`."""
    if form == NUMBER:
        return "".join(_FIGURE.get(c, c) for c in seen)
    if seen[:1].isupper():
        return form.upper() if seen.isupper() and len(seen) > 2 else form[:1].upper() + form[1:]
    return form


def _paragraphs(lines: list[tuple[bool, list[str]]]) -> str:
    """Lines of words to paragraphs; table lines stay lines."""
    out: list[str] = []
    fresh = True
    for is_table, words in lines:
        if not words:
            fresh = True
            continue
        text = " ".join(words)
        if is_table:
            out.append(("\n" if out and not fresh else "\n\n" if out else "") + text)
            fresh = False
        elif fresh or (out and out[-1].lstrip("\n").startswith("|")):
            out.append(("\n\n" if out else "") + text)
        else:
            out.append(" " + text)
        fresh = False
    return "".join(out)




REC = ["rec_table", "rec_id"]
ROW = [*REC, "version"]
LAYOUT = "rec_table string, rec_id string, version bigint, stream string, header boolean, pageno boolean"


@lru_cache(maxsize=200_000)
def _streamed(token: str) -> str:
    """What a token leaves in the stream: a number or divided word as it stands, else the form of its core."""
    if BREAK in token:
        return token
    core = core_of(token)
    return core if _NUMBER.fullmatch(core) else normal(core)


def _make_layout(whole: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["rec_table", "rec_id", "version", "stream", "header", "pageno", *(["text"] if whole else [])]
        for b in batches:
            out = []
            for table, id_, version, text, page, title, short in zip(b["rec_table"], b["rec_id"], b["version"], b["text"], b["page"], b["title"], b["short_name"], strict=True):
                lines, header, pageno = read_layout(text, None if pd.isna(page) else int(page), title, short)
                stream = " ".join(filter(None, map(_streamed, itertools.chain.from_iterable(lines))))
                out.append((table, id_, version, stream, header, pageno, *(["\n".join(" ".join(x) for x in lines)] if whole else [])))
            yield pd.DataFrame(out, columns=names)

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in parts(b.column(0)):
            counted = pc.value_counts(pc.split_pattern(part, " ").flatten())
            yield pa.RecordBatch.from_arrays([counted.field(0), counted.field(1)], names=["token", "n"])


def _halves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame([(t, *break_forms(t)) for t in b["token"]], columns=["token", "joined", "hyphened"])


PAIRS = "word string, n bigint, cand string, cn bigint, confs array<string>"


def _aligned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(w, n, c, cn, list(got)) for w, n, c, cn in zip(b["word"], b["n"], b["cand"], b["cn"], strict=True) if (got := confusions(w, c))]
        yield pd.DataFrame(out, columns=["word", "n", "cand", "cn", "confs"])


def _figures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(w, n, *got) for w, n in zip(b["word"], b["n"], strict=True) if (got := figures_meant(w))]
        yield pd.DataFrame([(w, n, meant, list(confs)) for w, n, meant, confs in out], columns=["word", "n", "meant", "confs"])


IS_NUMBER = "^[0-9.,·]*[0-9][0-9.,·]*$"
IS_WORD = "^\\p{L}[\\p{L}\\p{M}]*(?:[-'’/][\\p{L}\\p{M}]*)*$"


def confusable(seen: DataFrame, counts: DataFrame, more: DataFrame) -> DataFrame:
    """(word, n, cand, cn, confs): forms and what they may be misreadings of.

    `seen` has token, n; `counts` w, n; `more` w: further forms to ask for.
    """
    asked = counts.select("w").union(more.select("w")).distinct().join(counts, "w", "left").select(F.col("w").alias("word"), F.coalesce("n", F.lit(0)).alias("n")).where(F.col("word") != NUMBER)
    meant = counts.where(F.col("w").rlike(IS_WORD)).select(F.col("w").alias("cand"), F.col("n").alias("cn"), spread(F.col("w")).alias("s"))
    near_ones = asked.withColumn("s", spread(F.col("word"))).join(meant, "s").where((F.col("word") != F.col("cand")) & (F.lower("word") != F.col("cand")))
    letters = near_ones.select("word", "n", "cand", "cn").mapInPandas(_aligned, PAIRS)
    odd = asked.where(F.col("word").rlike("[0-9]") & ~F.col("word").rlike(IS_NUMBER)).mapInPandas(_figures, "word string, n bigint, meant string, confs array<string>")
    figures = odd.join(seen.select(F.col("token").alias("meant"), F.col("n").alias("cn")), "meant").select("word", "n", F.lit(NUMBER).alias("cand"), "cn", "confs")
    return letters.union(figures)


def _probability(probabilities: dict[str, float]) -> Column:
    known = F.create_map(*(F.lit(x) for kv in probabilities.items() for x in kv))
    return F.aggregate("confs", F.lit(1.0), lambda p, c: p * F.try_element_at(known, c))


def _true_count(n: Column, explained: Column, figures: Column) -> Column:
    v = F.when(figures, FIGURES_VARY).otherwise(VARIES)
    return F.greatest(n - (explained + DEVIATIONS * F.sqrt(explained + F.pow(v * explained, F.lit(2.0))) + 1.0), F.lit(0.0))


def _expected(pairs: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """`pairs` with `l`, its expected misreadings, and by word `explained`, all expected ones, and `true`."""
    each = pairs.withColumn("l", F.col("cn") * _probability(probabilities))
    word = Window.partitionBy("word")
    told = each.withColumn("explained", F.sum("l").over(word)).withColumn("figures", F.max(F.col("cand") == NUMBER).over(word))
    return told.withColumn("true", _true_count(F.col("n"), F.col("explained"), F.col("figures")))


def estimate_confusions(pairs: DataFrame, seen: DataFrame) -> dict[str, float]:
    """P(seen|meant) of each confusion, over the whole corpus; one entry a known confusion."""
    names = {f"{a}={b}": b for a, b in _PAIRS} | {f"#{a}={b}": b for a, b in _FIGURE.items()}
    number = F.col("token").rlike(IS_NUMBER)
    wholes = seen.where(~F.contains("token", F.lit(BREAK)))

    def places(of: str, digits: bool) -> Column:
        times = (F.length("token") - F.length(F.replace("token", F.lit(of), F.lit("")))) / F.lit(len(of))
        return F.coalesce(F.sum(F.when(number == digits, F.col("n") * times)), F.lit(0.0))

    meant = sorted(set(names.values()))
    row = wholes.agg(*(places(m, m.isdigit()).alias(f"m{i}") for i, m in enumerate(meant))).first()
    chances = {m: float(row[f"m{i}"]) for i, m in enumerate(meant)}
    p = dict.fromkeys(names, CONFUSION_P)
    for _ in range(STEPS):
        share = F.col("n") * F.col("l") / F.nullif(F.col("true") + F.col("explained"), F.lit(0.0))
        misread = _expected(pairs, p).select(F.explode("confs").alias("c"), share.alias("e")).groupBy("c").agg(F.sum("e").alias("e"))
        found = {r["c"]: r["e"] or 0.0 for r in misread.collect()}  # at most one row a known confusion
        p = {k: (found.get(k, 0.0) + PRIOR_WEIGHT * CONFUSION_P) / (chances[m] + PRIOR_WEIGHT) for k, m in names.items()}
    return p


def _coded(part: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct tokens, code of each token, row of each token)."""
    lists = pc.split_pattern(part, " ")
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), rows


@lru_cache(maxsize=200_000)
def _form_digest(token: str) -> int:
    return word_digest(normal(token))


SEGMENTS = "rec_table string, rec_id string, version bigint, at int, segment string"


def _segments(bits):
    """Runs of tokens with options, or divided ones, between the forms on their sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = bitmap(bits)
        for b in batches:
            base = 0
            keys, places, texts = [], [], []
            for part in parts(b.column("stream")):
                names, codes, rows = _coded(part)
                hit = passes(asked, np.array([_form_digest(t) for t in names], dtype=np.uint64)) if names else np.zeros(0, dtype=bool)
                active = (hit | np.array([BREAK in t for t in names], dtype=bool))[codes] if names else hit
                n = len(codes)
                fresh = np.concatenate([[True], rows[1:] != rows[:-1]]) if n else active
                starts = np.nonzero(active & (fresh | ~np.concatenate([[False], active[:-1]])))[0] if n else codes
                stops = np.nonzero(active & (np.concatenate([fresh[1:], [True]]) | ~np.concatenate([active[1:], [False]])))[0] if n else codes
                firsts = np.nonzero(fresh)[0]
                begin = firsts[np.searchsorted(firsts, starts, side="right") - 1] if n else codes
                for i, j, f in zip(starts.tolist(), stops.tolist(), begin.tolist(), strict=True):
                    run_ = [names[c] if BREAK in names[c] else normal(names[c]) for c in codes[i : j + 1].tolist()]
                    before = "" if fresh[i] else normal(names[codes[i - 1]])
                    after = "" if j + 1 == n or fresh[j + 1] else normal(names[codes[j + 1]])
                    keys.append(base + int(rows[i]))
                    places.append(i - f)
                    texts.append(" ".join([before, *run_, after]))
                base += len(part)
            took = pa.array(keys, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(took) for c in ROW), pa.array(places, pa.int32()), pa.array(texts, pa.string())], names=[*ROW, "at", "segment"])

    return run


_BIGRAM_SALT = 0x1B873593


def _bigram_digest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * ODD + b, _BIGRAM_SALT)


def _bigrams(bits):
    """(d, n): how often the bigrams that the filter lets through stand in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = bitmap(bits)
        for b in batches:
            for part in parts(b.column(0)):
                names, codes, rows = _coded(part)
                if len(codes) < 2:
                    continue
                digests = np.array([_form_digest(t) for t in names], dtype=np.uint64)
                whole = np.array([BREAK not in t and t != "" for t in names], dtype=bool)
                a, c = codes[:-1], codes[1:]
                d = _bigram_digest(digests[a], digests[c])
                d = d[passes(asked, d) & (rows[:-1] == rows[1:]) & whole[a] & whole[c]]
                one, n = np.unique(d, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(n.astype(np.int64))], names=["d", "n"])

    return run


def _options(items) -> list[list[tuple[str, float]]]:
    """The lattice of a segment: the form as it stands first, then what it may mean."""
    return [[(x["form"], 0.0), *((o["cand"], o["cost"]) for o in (x["options"] if x["options"] is not None else ()))] for x in items if x["form"] != ""]


def _needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bigrams, with their digests, that the lattices ask for."""
    for b in batches:
        out = []
        for segment, items in zip(b["segment"], b["items"], strict=True):
            pairs = {(x, y) for p, q in itertools.pairwise(_options(items)) if len(p) > 1 or len(q) > 1 for x, _ in p for y, _ in q}
            out += [(segment, x, y, _form_digest(x), _form_digest(y)) for x, y in pairs]
        made = pd.DataFrame(out, columns=["segment", "a", "b", "x", "y"])
        d = _bigram_digest(made["x"].to_numpy(dtype=np.uint64), made["y"].to_numpy(dtype=np.uint64)).view(np.int64)
        yield made[["segment", "a", "b"]].assign(d=d)


def true_bigrams(options: list[list[tuple[str, float]]], counts: dict[tuple[str, str], float]) -> dict[tuple[str, str], float]:
    """Bigram counts of a lattice beyond what misreadings of its other bigrams explain."""
    out: dict[tuple[str, str], float] = {}
    for left, right in itertools.pairwise(options):
        for i, (x, _) in enumerate(left):
            for j, (y, _) in enumerate(right):
                n = counts.get((x, y), 0.0)
                # only a form as it stands may be a misreading, of its options
                xs, ys = left if i == 0 else [(x, 0.0)], right if j == 0 else [(y, 0.0)]
                others = [(p[0], q[0], p[1] + q[1]) for p in xs for q in ys if (p[0], q[0]) != (x, y)]
                if n and others:
                    explained = sum(counts.get((p, q), 0.0) * CONFUSION_P**k for p, q, k in others)
                    n = beyond(n, explained, FIGURES_VARY if any(NUMBER in o[:2] for o in others) and NUMBER not in (x, y) else VARIES)
                out[x, y] = n
    return out


DECIDED = "segment string, hyphen boolean, misread boolean, changes array<struct<at int, joined boolean, form string>>, choices int, against int"


def _make_decode(total: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for segment, items, grams, counts in zip(b["segment"], b["items"], b["grams"], b["counts"], strict=True):
                options = _options(items)
                bi = {(g["a"], g["b"]): float(g["n"]) for g in grams} if grams is not None else {}
                uni = {c["w"]: float(c["n"]) for c in counts} if counts is not None else {}
                picks = viterbi(options, true_bigrams(options, bi), uni, total, None)
                chosen = iter(zip(options, picks, strict=True))
                changes, choices, against = [], 0, 0
                for k, x in enumerate(items):
                    if x["form"] == "":
                        continue
                    o, pick = next(chosen)
                    divided = BREAK in x["token"]
                    if len(o) > 1:
                        choices += 1
                        against += pick != max(range(len(o)), key=lambda i, o=o: (uni.get(o[i][0], 0.0), -i))
                    if pick or divided:
                        changes.append({"at": k - 1, "joined": bool(x["joined"]) if divided else None, "form": o[pick][0] if pick else None})
                out.append((segment, any(c["joined"] for c in changes), any(c["form"] is not None for c in changes), changes, choices, against))
            yield pd.DataFrame(out, columns=["segment", "hyphen", "misread", "changes", "choices", "against"])

    return run


def laid_out(records: DataFrame, guidelines: DataFrame, whole: bool = False) -> DataFrame:
    """Records with a text, read once: stream of forms, header and page number; with `whole`, also the body."""
    names = guidelines.groupBy("doc_id").agg(F.max(F.struct("title", "short_name")).alias("g")).select("doc_id", "g.title", "g.short_name")
    rows = records.where(F.length("text") > 0).select(*REC, "doc_id", "page", "text", F.xxhash64("text").alias("version")).dropDuplicates([*REC, "text"])
    rows = rows.join(names, "doc_id", "left").select(*ROW, "text", "page", "title", "short_name")
    return cut(rows.mapInPandas(_make_layout(whole), LAYOUT + (", text string" if whole else "")))


def decided_segments(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments by record, what was decided for each distinct segment)."""
    seen = cut(parsed.select("stream").mapInArrow(_tally, "token string, n bigint").where("token <> ''").groupBy("token").agg(F.sum("n").alias("n")))
    divided = F.contains("token", F.lit(BREAK))
    counts = seen.where(~divided).groupBy(F.when(F.col("token").rlike(IS_NUMBER), F.lit(NUMBER)).otherwise(F.col("token")).alias("w")).agg(F.sum("n").alias("n"))
    total = float(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    halves = cut(seen.where(divided).select("token").mapInPandas(_halves, "token string, joined string, hyphened string"))

    # the channel
    more = halves.select(F.col("joined").alias("w")).union(halves.select("hyphened"))
    pairs = cut(confusable(seen, counts, more))
    p = estimate_confusions(pairs, seen)
    known = cut(_expected(pairs, p))
    true = known.groupBy("word").agg(F.max("true").alias("true"))
    meant = counts.join(true, F.col("w") == F.col("word"), "left").select("w", F.coalesce("true", F.col("n").cast("double")).alias("n"))
    cost = F.log(_probability(p)) / F.lit(math.log(CONFUSION_P))
    kept = known.join(meant.where("n > 0").select(F.col("w").alias("cand"), F.col("n").alias("cand_true")), "cand")
    options = cut(kept.select("word", "cand", cost.alias("cost"), "cand_true"))

    # divided words: which of the two forms the corpus writes, misread halves included
    best = options.groupBy("word").agg(F.max("cand_true").alias("best"))

    def strength(name: str) -> DataFrame:
        told = halves.select("token", F.col(name).alias("w")).join(counts, "w", "left").join(best.withColumnRenamed("word", "w"), "w", "left")
        return told.select("token", F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("best", F.lit(0.0))).alias(name[:1] + "n"))

    joins = strength("joined").join(strength("hyphened"), "token").join(halves, "token")
    joins = joins.select("token", (F.col("jn") >= F.col("hn")).alias("is_joined"), F.when(F.col("jn") >= F.col("hn"), F.col("joined")).otherwise(F.col("hyphened")).alias("made"))

    # places with options, and each distinct one's lattice
    bits = broadcast_filter(options.select(F.xxhash64("word").alias("d")).distinct())
    places = cut(parsed.select(*ROW, "stream").mapInArrow(_segments(bits), SEGMENTS))
    items = places.select("segment").distinct().select("segment", F.posexplode(F.split("segment", " ")).alias("k", "token"))
    resolved = items.join(joins, "token", "left").withColumn("form", F.coalesce("made", "token"))
    choices = options.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("cand", "cost"))).alias("options"))
    resolved = resolved.join(choices, F.col("form") == F.col("word"), "left")
    lattice = cut(resolved.groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("k", "token", "form", F.col("is_joined").alias("joined"), "options"))).alias("items")))

    # counts of the words and bigrams that the lattices ask for
    needed = cut(lattice.mapInPandas(_needed, "segment string, a string, b string, d bigint"))
    bits = broadcast_filter(needed.select("d").distinct())
    grams = parsed.select("stream").mapInArrow(_bigrams(bits), "d bigint, n bigint").groupBy("d").agg(F.sum("n").alias("n"))
    told = needed.join(counted_side(grams), "d").groupBy("segment").agg(F.collect_list(F.struct("a", "b", "n")).alias("grams"))
    singles = needed.select("segment", F.explode(F.array("a", "b")).alias("w")).distinct().join(meant, "w").groupBy("segment").agg(F.collect_list(F.struct("w", "n")).alias("counts"))
    ready = lattice.join(told, "segment", "left").join(singles, "segment", "left")
    return places, cut(ready.mapInPandas(_make_decode(total), DECIDED))


def _render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with the decided changes, as paragraphs."""
    for b in batches:
        out = []
        for table, id_, text, header, pageno, hyphen, misread, changes in zip(*(b[c] for c in ("rec_table", "rec_id", "text", "header", "pageno", "hyphen", "misread", "changes")), strict=True):
            by_place = {c["at"]: c for c in changes} if changes is not None else {}
            at, lines = 0, []
            for raw in text.split("\n"):
                words = raw.split()
                for k, token in enumerate(words):
                    divided = BREAK in token
                    if not divided and not core_of(token):
                        continue
                    c = by_place.get(at)
                    at += 1
                    if divided:
                        a, z = token.split(BREAK, 1)
                        token = a[:-1] + ("" if c is None or c["joined"] else "-") + z.replace(BREAK, "")
                    if c is not None and c["form"] is not None:
                        core = core_of(token)
                        token = token.replace(core, _meant(core, c["form"]), 1)
                    words[k] = token
                lines.append((raw[:1] == "|", words))
            out.append((table, id_, bool(hyphen), bool(misread), header, pageno, _paragraphs(lines)))
        yield pd.DataFrame(out, columns=["rec_table", "rec_id", "hyphen", "misread", "header", "pageno", "repaired"])


REPAIRED = "rec_table string, rec_id string, hyphen boolean, misread boolean, header boolean, pageno boolean, repaired string"


def repair(records: DataFrame, guidelines: DataFrame) -> DataFrame:
    """(rec_table, rec_id, hyphen, misread, header, pageno, repaired): one row per record with a text.

    `records` has rec_table, rec_id, doc_id, page, text; `guidelines` doc_id, title, short_name.
    """
    parsed = laid_out(records, guidelines, whole=True)
    places, decided = decided_segments(parsed)
    found = places.join(counted_side(decided.where(F.size("changes") > 0)), "segment")
    moved = found.select(*ROW, "hyphen", "misread", F.explode("changes").alias("c"), "at").withColumn("c", F.struct((F.col("c.at") + F.col("at")).alias("at"), "c.joined", "c.form"))
    mine = moved.groupBy(*ROW).agg(F.bool_or("hyphen").alias("hyphen"), F.bool_or("misread").alias("misread"), F.collect_list("c").alias("changes"))
    return parsed.drop("stream").join(mine, ROW, "left").select(*REC, "text", "header", "pageno", "hyphen", "misread", "changes").mapInPandas(_render, REPAIRED)


def continuous_text(records: DataFrame, guidelines: DataFrame) -> DataFrame:
    """(rec_table, rec_id, repaired): one row per record; null and empty texts stay as they are."""
    blank = records.where(F.col("text").isNull() | (F.length("text") == 0)).select(*REC, F.col("text").alias("repaired")).distinct()
    return repair(records, guidelines).select(*REC, "repaired").unionByName(blank)


def noise_kinds(repaired: DataFrame) -> DataFrame:
    """(rec_table, rec_id, noise_kind)."""
    kinds = F.array_compact(F.array(*(F.when(F.col(k), F.lit(k)) for k in ("hyphen", "misread", "header", "pageno") if k in repaired.columns)))
    return repaired.select(*REC, F.explode(kinds).alias("noise_kind")).distinct()


def found_noise(records: DataFrame, guidelines: DataFrame) -> DataFrame:
    """(rec_table, rec_id, noise_kind), as `noise_kinds` of `repair`, without making the texts."""
    parsed = laid_out(records, guidelines)
    places, decided = decided_segments(parsed)
    wrong = decided.where("hyphen or misread").select("segment", "hyphen", "misread")
    return noise_kinds(places.join(counted_side(wrong), "segment")).union(noise_kinds(parsed.select(*REC, "header", "pageno"))).distinct()


def decisions(records: DataFrame, guidelines: DataFrame) -> DataFrame:
    """(choices, changed, against): over the distinct places with several options, how many there are,
    how many the decoder changed, and how often it chose another than the most frequent option."""
    _, decided = decided_segments(laid_out(records, guidelines))
    changed = F.size(F.filter("changes", lambda c: c["form"].isNotNull()))
    return decided.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in (("choices", F.col("choices")), ("changed", changed), ("against", F.col("against")))))
