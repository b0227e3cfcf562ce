"""One consistent form for text that prints alike.

`fold` works in the JVM: one `translate` for all one-to-one cases and for the removal of
invisible characters, then five replacements for ligatures, then, only for text that holds
a combining mark, composition of Latin letter and mark. `printed_as` puts the result under
the accent-sensitive collation `UNICODE`, where what is left of canonically equivalent
or ignorable characters compares equal. (Spark hashes such strings by their collation key,
which is not the same for composed and decomposed letters; hence the composition.)

`fold_text` is the same rule for use inside Arrow batches, ending in NFC.

Kept apart on purpose: raised and lowered figures or letters, letter case, dashes of
different length, middle dot and full stop, the number of spaces.
Null stays null; an empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that print like another one. Space-separated "look-alike=plain".
LOOKALIKE_LETTERS = (
    # Cyrillic capitals and small letters
    "А=A В=B Е=E Ѕ=S І=I Ј=J К=K М=M Н=H О=O Р=P С=C Т=T У=Y Х=X Ү=Y Ԍ=G Ԛ=Q Ԝ=W Ӏ=I "
    "а=a е=e ѕ=s і=i ј=j о=o р=p с=c у=y х=x һ=h ԁ=d ԛ=q ԝ=w ӏ=l ү=y "
    # Greek capitals and small letters
    "Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X ο=o ν=v ϲ=c ϳ=j "
    # Armenian, Latin and letter-like forms
    "\u0585=o \u057d=u \u0261=g \u212a=K \u212b=\u00c5 \u2126=\u03a9 \u03bc=\u00b5"
)
# Kinds of space that print as a space.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Characters that print as nothing.
INVISIBLE = (
    "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e"
    "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
    "\ufe00\ufe01\ufe02\ufe03\ufe04\ufe05\ufe06\ufe07\ufe08\ufe09\ufe0a\ufe0b\ufe0c\ufe0d\ufe0e\ufe0f"
)
# Ligatures that print as their letters.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
# Hyphens that print as the ordinary one.
HYPHENS = "\u2010\u2011"

#: Accent- and case-sensitive ICU collation used to compare folded text.
COLLATION = "UNICODE"


def _one_to_one() -> dict[str, str]:
    out = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width ASCII
    out |= dict(p.split("=") for p in LOOKALIKE_LETTERS.split())
    out |= {s: " " for s in SPACES} | {h: "-" for h in HYPHENS}
    return {k: v for k, v in out.items() if k != v}


_MAP = _one_to_one()
_FROM = "".join(_MAP) + INVISIBLE
_TO = "".join(_MAP.values())
_MAPPED = re.compile("[" + re.escape(_FROM + "".join(LIGATURES)) + "]")
_TABLE = str.maketrans(_MAP | {c: "" for c in INVISIBLE} | LIGATURES)


def _compositions() -> list[tuple[str, str]]:
    """Latin (letter + mark, composed) pairs, those on a plain letter first."""
    out = []
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.decomposition(chr(c)).split()
        if len(d) == 2 and not d[0].startswith("<"):
            out.append((chr(int(d[0], 16)) + chr(int(d[1], 16)), chr(c)))
    return sorted(out, key=lambda p: not p[0][0].isascii())


def _compose(text: Column) -> Column:
    # the pairs travel as one string literal: a tree of a thousand literals slows the planner
    pairs = F.split(F.lit(" ".join(f"{a}={b}" for a, b in _compositions())), " ")
    swap = lambda acc, p: F.replace(acc, F.split_part(p, F.lit("="), F.lit(1)), F.split_part(p, F.lit("="), F.lit(2)))
    return F.aggregate(pairs, text, swap)


def fold(text: Column) -> Column:
    """JVM-side look-alike map (see the module text)."""
    out = F.translate(text, _FROM, _TO)
    for one, many in LIGATURES.items():
        out = F.replace(out, F.lit(one), F.lit(many))
    marked = text.rlike("[\\u0300-\\u036f]")
    # most text has nothing to map: one scan decides
    return F.when(~text.rlike("[^\\x00-\\x7e]"), text).when(marked, _compose(out)).otherwise(out)


def printed_as(text: Column) -> Column:
    """Folded text under the accent-sensitive collation: equal if and only if it prints alike."""
    return F.collate(fold(text), COLLATION)


def fold_text(text: str | None) -> str | None:
    """`fold` for Python code, ending in NFC so that equal looks are equal strings."""
    if text is None or text.isascii():
        return text
    return unicodedata.normalize("NFC", text.translate(_TABLE) if _MAPPED.search(text) else text)


def fold_sql(text: str) -> str:
    """`fold_text` as an SQL expression over the column or expression `text`."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"translate({text}, {quote(_FROM)}, {quote(_TO)})"
    for one, many in LIGATURES.items():
        out = f"replace({out}, '{one}', '{many}')"
    return f"nfc_normalize({out})"
