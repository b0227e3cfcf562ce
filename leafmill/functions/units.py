"""Units of measurement named in table headers, cells and notes.

Pure Python, for use inside Arrow batches: `parse_table` reads one Markdown table into a
skeleton (the grid with numbers and units taken out) and its quantities.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from leafmill.functions.lookalike import fold_text

# Kind, common unit, then "unit = factor to the common unit: spellings".
UNITS = {
    "weight": ("kg", ("kg=1: kg kgs kilogram kilograms kilo kilos", "g=0.001: g gram grams gm", "lb=0.45359237: lb lbs pound pounds")),
    "dose": ("mg", ("mg=1: mg milligram milligrams", "g=1000: g gram grams gm", "ug=0.001: µg ug mcg microgram micrograms")),
    "dose_per_kg": ("mg/kg", ("mg/kg=1: mg/kg milligram/kg milligrams/kg", "g/kg=1000: g/kg gram/kg grams/kg", "ug/kg=0.001: µg/kg ug/kg mcg/kg microgram/kg micrograms/kg")),
    "volume": ("mL", ("mL=1: ml millilitre millilitres milliliter milliliters", "L=1000: l litre litres liter liters", "dL=100: dl decilitre decilitres deciliter deciliters", "cL=10: cl centilitre centilitres")),
    "concentration": ("mg/mL", ("mg/mL=1: mg/ml milligrams/millilitre milligram/millilitre", "g/L=1: g/l grams/l g/litre gram/litre grams/litre grams/liter", "ug/mL=0.001: µg/ml ug/ml mcg/ml micrograms/ml micrograms/millilitre", "g/dL=10: g/dl grams/dl g/decilitre", "mg/dL=0.01: mg/dl", "mg/L=0.001: mg/l mg/litre", "g/mL=1000: g/ml")),
    "haemoglobin": ("g/dL", ("g/dL=1: g/dl grams/dl gram/dl g/decilitre grams/decilitre", "g/L=0.1: g/l grams/l g/litre gram/litre grams/litre grams/liter", "mg/mL=0.1: mg/ml")),
    "temperature": ("°C", ("°C=1: °c ºc c celsius degreescelsius degreecelsius", "°F=1: °f ºf f fahrenheit degreesfahrenheit degreefahrenheit")),
    "age": ("months", ("months=1: mo mos month months mois mes meses", "years=12: y yr yrs year years an ans año años", "weeks=0.229977: wk wks week weeks semaine semaines", "days=0.0328549: d day days jour jours")),
    "course": ("days", ("days=1: d day days jour jours día días", "hours=0.0416666667: h hr hrs hour hours heure heures", "weeks=7: w wk wks week weeks semaine semaines")),
}
# Words of a header or note that tell the kind of its numbers.
KIND_WORDS = {
    "weight": "weight weights poids peso",
    "age": "age ages âge âges edad",
    "dose": "dose doses dosis",
    "volume": "volume volumes volumen",
    "concentration": "concentration concentrations concentración",
    "course": "course courses durée duración",
    "temperature": "temperature temperatures température temperatura",
    "haemoglobin": "haemoglobin hemoglobin hémoglobine hemoglobina",
}
# Words that may stand beside the numbers of a quantity.
FILLERS = frozenset("to over for at least and or up less more than from under below above about a à de du par per un day días".split())


class Unit(NamedTuple):
    code: int
    kind: str
    name: str
    factor: float


class Quantity(NamedTuple):
    row: int
    col: int
    part: int
    kind: str
    code: int
    raw: float


def _build() -> tuple[list[Unit], dict[str, dict[str, Unit]]]:
    units: list[Unit] = []
    spelt: dict[str, dict[str, Unit]] = {}
    for kind, (_, rows) in UNITS.items():
        spelt[kind] = {}
        for row in rows:
            head, words = row.split(": ")
            name, factor = head.split("=")
            u = Unit(len(units), kind, name, float(factor))
            units.append(u)
            spelt[kind] |= dict.fromkeys(words.split(), u)
    return units, spelt


ALL_UNITS, _SPELT = _build()
COMMON = {kind: common for kind, (common, _) in UNITS.items()}
#: The kinds that a column of a known kind may hold, tried in this order.
_MAY_BE = {"dose": ("dose_per_kg", "dose"), None: ("dose_per_kg", "haemoglobin", "concentration", "temperature", "dose", "volume", "course", "age", "weight")}
_NUMBER = r"\d{1,3}(?: \d{3})+(?!\d)(?:[.,·]\d+)?|\d{1,3}(?:,\d{3})+(?!\d)(?:[.·]\d+)?|\d+(?:[.,·]\d+)?"
_DENSE = r"(?:mg|g|µg|ug|mcg|milligrams?|grams?|micrograms?)"
_UNIT_TEXT = re.compile(
    rf"{_DENSE}\s*(?:/|per)\s*(?:\d+\s*)?(?:kg|ml|dl|l|millilitres?|litres?|liters?|decilitres?)(?![a-zµ])"
    r"|degrees?\s+(?:celsius|fahrenheit)|[°º]\s*[cf](?![a-z])|[a-zµáâéíñ]+(?![a-zµ/])",
    re.I,
)
_PER_N = re.compile(r"^(.*?)/(\d+)(ml|l|dl)$")
_QUANTITY = re.compile(rf"({_NUMBER})(?:\s*({_UNIT_TEXT.pattern}))?", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_HEADER_UNIT = re.compile(
    rf"\s*(?:\(\s*(?P<a>{_UNIT_TEXT.pattern})\s*\)|\[\s*(?P<b>{_UNIT_TEXT.pattern})\s*\]|,\s*(?P<c>{_UNIT_TEXT.pattern})(?=\s|$)"
    rf"|\s(?:in|en)\s+(?P<d>{_UNIT_TEXT.pattern})(?=\s|$))",
    re.I,
)
_NOTE_UNIT = re.compile(rf"\b(?:in|en)\s+({_UNIT_TEXT.pattern})\s*\.?\s*$", re.I)
_RULE_LINE = re.compile(r"^\|?[\s:|-]*-[\s:|-]*\|?$")
_SPACE = re.compile(r"\s+")
_DIGIT = re.compile(r"\d")
#: A power of ten: a count, not a quantity.
_POWER = re.compile(r"×\s*10\s*(?:\^|[⁰¹²³⁴-⁹])")


#: Codes from here on: a unit per N of its denominator ("mg/5 mL"), N times this plus the unit's code.
PER = 1000


def factor_of(code: int) -> float:
    """Factor of a unit code to the common unit of its kind."""
    return ALL_UNITS[code % PER].factor / max(1, code // PER)


@lru_cache(maxsize=4096)
def unit_of(text: str, kind: str | None) -> int | None:
    """Code of the unit spelt `text` in a column of `kind` (None: any)."""
    low = text.lower()
    key = _SPACE.sub("", re.sub(r"\bper\b", "/", low))
    per = 0
    if m := _PER_N.match(key):
        key, per = f"{m[1]}/{m[3]}", int(m[2])
    for k in _MAY_BE.get(kind, (kind,)):
        if u := _SPELT[k].get(key):
            return u.code + (PER * per if per > 1 else 0)
    return None


def number(text: str) -> float:
    """A printed number: spaces and three-figure commas group thousands, `·` is a point."""
    t = text.replace(" ", "").replace("·", ".")
    if re.fullmatch(r"\d{1,3}(,\d{3})+(\.\d+)?", t):
        t = t.replace(",", "")
    return float(t.replace(",", "."))


def common_value(raw: float, code: int) -> float:
    """`raw`, recorded in the unit `code`, in the common unit of its kind."""
    if code == _FAHRENHEIT:
        return (raw - 32.0) / 1.8
    return raw * factor_of(code)


_FAHRENHEIT = next(u.code for u in ALL_UNITS if u.name == "°F")


@lru_cache(maxsize=8192)
def _kind_of(header: str) -> str | None:
    low = header.lower()
    found = [(m.start(), k) for k, ws in KIND_WORDS.items() for w in ws.split() if (m := re.search(rf"(?<!\w){w}(?!\w)", low))]
    return min(found)[1] if found else None


@lru_cache(maxsize=8192)
def _read_header(header: str) -> tuple[str, str | None, int | None]:
    """(header without its unit, kind, unit)."""
    kind = _kind_of(header)
    for m in _HEADER_UNIT.finditer(header):
        text = m["a"] or m["b"] or m["c"] or m["d"]
        if (u := unit_of(text, kind)) is not None:
            return _SPACE.sub(" ", header[: m.start()] + " " + header[m.end() :]).strip(), kind, u
    return header, kind, None


def _cells(line: str) -> list[str]:
    if "<br>" in line or "  " in line or "\t" in line:
        line = _SPACE.sub(" ", line.replace("<br>", " "))
    return [c.strip() for c in line.removeprefix("|").removesuffix("|").split("|")]


@lru_cache(maxsize=200_000)
def _read_cell(cell: str, kind: str | None) -> tuple[str, tuple[tuple[float, int | None], ...]] | None:
    """(cell without numbers and units, its quantities), None if it states no quantity."""
    if not _DIGIT.search(cell) or ("×" in cell and _POWER.search(cell)):
        return None
    found: list[tuple[float, int | None]] = []
    rest, at = [], 0
    for m in _QUANTITY.finditer(cell):
        u = unit_of(m[2], kind) if m[2] else None
        rest.append(cell[at : m.start()] + "#" + ("" if u is not None else cell[m.end(1) : m.end()]))
        at = m.end()
        found.append((number(m[1]), u))
    rest.append(cell[at:])
    left = "".join(rest)
    if kind is None and all(u is None for _, u in found):
        return None
    if any(w not in FILLERS for w in _WORD.findall(left.lower())):
        return None
    for i in range(len(found) - 2, -1, -1):  # "25 + 135 mg": the unit holds for both
        if found[i][1] is None:
            found[i] = (found[i][0], found[i + 1][1])
    return _SPACE.sub("", left), tuple(found)


def parse_table(markdown: str | None) -> tuple[str, list[Quantity]] | None:
    """(skeleton, quantities); a quantity for which no unit is named has the code -1.

    None for null, text without a grid, and tables without quantities.
    """
    if not markdown:
        return None
    lines = [x for x in map(str.strip, fold_text(markdown).split("\n")) if x]
    grid = [x for x in lines if x[0] == "|" and not (x.find("-") >= 0 and _RULE_LINE.match(x))]
    if len(grid) < 2:
        return None
    notes = {}
    for x in lines:
        if x[0] != "|" and (m := _NOTE_UNIT.search(x)) and (kind := _kind_of(x)):
            notes[kind] = unit_of(m[1], kind)
    heads = [_read_header(h) for h in _cells(grid[0])]
    shape, quantities = ["|".join(h[0] for h in heads)], []
    for i, line in enumerate(grid[1:]):
        out = []
        for j, cell in enumerate(_cells(line)):
            kind, unit = heads[j][1:] if j < len(heads) else (None, None)
            got = _read_cell(cell, kind)
            if got is None:
                out.append(cell)
                continue
            out.append(got[0])
            for part, (raw, code) in enumerate(got[1]):
                if code is None:
                    code = unit if unit is not None else notes.get(kind)
                quantities.append(Quantity(i, j, part, (ALL_UNITS[code % PER].kind if code is not None else kind) or "", -1 if code is None else code, raw))
        shape.append("|".join(out))
    return ("\n".join(shape), quantities) if quantities else None
