"""Keyword lists and thresholds that drive the operators; a parameter everywhere, never global."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

# Keywords of table classes.
EVIDENCE_WORDS = (
    "grade", "quality of evidence", "relative effect", "95% ci", "no. of par", "no of par", "cochrane", "rr ",
    "systematic review", "assumed risk", "corresponding risk", "trials)",
)
STRUCTURAL_WORDS = ("contents", "annex", "preparation of the guidelines", "abbreviation", "glossary", "introduction......")
CLINICAL_WORDS = ("manifestation", "complication", "immediate management", "clinical feature", "danger sign", "referral", "severity")
DOSING_WORDS = ("body weight", "kg", "dose (mg)", "dose given", "mg/kg", "tablet", "twice daily", "daily for 3 days", "single dose")


@dataclass(frozen=True)
class Config:
    """One document collection's settings; empty lists switch a rule off."""

    title: str = "Guidelines"
    short_name: str = ""
    drugs: tuple[str, ...] = ()
    dosing_words: tuple[str, ...] = DOSING_WORDS
    evidence_words: tuple[str, ...] = EVIDENCE_WORDS
    structural_words: tuple[str, ...] = STRUCTURAL_WORDS
    clinical_words: tuple[str, ...] = CLINICAL_WORDS
    dose_ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    conditions: tuple[tuple[str, str], ...] = ()
    biomarkers: tuple[str, ...] = ()
    contraindication_terms: tuple[str, ...] = ()
    high_preservation_terms: tuple[str, ...] = ()
    section_words: dict[str, tuple[str, ...]] = field(default_factory=dict)
    care_levels: tuple[str, ...] = ()
    ground_truth: tuple[dict, ...] = ()

    @property
    def table_words(self) -> tuple[str, ...]:
        """Dosing words and drug names; an entry in both counts twice."""
        return self.dosing_words + self.drugs


def load_config(path: str | Path) -> Config:
    """A config from a JSON file with the names of `Config`; unknown names are an error."""
    raw = json.loads(Path(path).read_text())
    known = {f.name for f in fields(Config)}
    if unknown := set(raw) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    fixed = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in raw.items()}
    for name in ("dose_ranges", "section_words"):
        if name in fixed:
            fixed[name] = {k: tuple(v) for k, v in fixed[name].items()}
    return replace(Config(), **fixed)


def any_pattern(terms: tuple[str, ...]) -> str | None:
    """A case-insensitive pattern for any of the terms, the longest first; None for no terms.

    The longest come first so that "HC III" is not read as "HC II".
    """
    if not terms:
        return None
    return "(?i)(" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")"
