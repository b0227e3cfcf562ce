import itertools
import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from leafmill.functions.units import ALL_UNITS, common_value, number, parse_table, unit_of
from leafmill.operators import units


def table(head, rows, note=""):
    lines = ["| " + " | ".join(head) + " |", "| " + " | ".join("---" for _ in head) + " |"]
    return "\n".join(lines + ["| " + " | ".join(r) + " |" for r in rows]) + note


@pytest.mark.parametrize(("text", "value"), [("14 000", 14000), ("14,000", 14000), ("7,5", 7.5), ("0·15", 0.15), ("1,250,000", 1250000), ("12.5", 12.5)])
def test_numbers(text, value):
    assert number(text) == value


@pytest.mark.parametrize(
    ("text", "kind", "name", "raw", "common"),
    [("lb", "weight", "lb", 10, 4.5359237), ("g", "dose", "g", 0.5, 500), ("mcg/kg", "dose", "ug/kg", 100, 0.1), ("mg per 5 mL", "concentration", "mg/mL", 125, 25), ("grams per litre", "concentration", "g/L", 8, 8), ("degrees Fahrenheit", None, "°F", 104, 40), ("yr", "age", "years", 2, 24), ("h", "course", "hours", 72, 3), ("dl", "volume", "dL", 2, 200)],
)
def test_units(text, kind, name, raw, common):
    code = unit_of(text, kind)
    assert ALL_UNITS[code % 1000].name == name
    assert math.isclose(common_value(raw, code), common, rel_tol=1e-9)


def test_unit_in_header_cell_and_note():
    forms = [
        table(["Weight (kg)", "Dose of x, mg given daily"], [["< 15", "20 + 120"], ["15 to < 25", "40 + 240"]]),
        table(["Weight", "Dose of x given daily"], [["< 15 kg", "20 mg + 120 mg"], ["15 to < 25kg", "40 + 240 mg"]]),
        table(["Weight", "Dose of x [g] given daily"], [["< 15000", "0.02 + 0.12"], ["15,000 to < 25 000", "0.04 + 0.24"]], "\n\nBody weights are given in grams."),
    ]
    parsed = [parse_table(f) for f in forms]
    assert len({p[0] for p in parsed}) == 1
    for p in parsed:
        assert [round(common_value(q.raw, q.code), 6) for q in p[1]] == [15, 20, 120, 15, 25, 40, 240]


def test_no_quantities():
    assert parse_table(None) is None
    assert parse_table("") is None
    assert parse_table("no grid") is None
    assert parse_table(table(["Sign", "Action"], [["Fever", "Give x 250 mg subcutaneously at the next follow-up visit"]])) is None
    assert parse_table(table(["Criterion", "Threshold"], [["Parasite count", "≥ 4 × 10³/µL"]])) is None


def brute_segments(x, penalty):
    n = len(x)
    best = None
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            b = [0, *cuts, n]
            cost = sum(sum((v - np.mean(x[i:j])) ** 2 for v in x[i:j]) for i, j in itertools.pairwise(b)) + penalty * k
            if best is None or cost < best[0] - 1e-12:
                best = (cost, b)
    return best[0]


def test_changepoint_search_is_exact():
    rng = random.Random(5)
    for _ in range(30):
        n = rng.randrange(1, 8)
        x = [math.log(rng.choice([5, 5.01, 5000, 11])) for _ in range(n)]
        levels = units.segment_levels(np.array(x)[:, None], 0.01)[:, 0]
        changes = sum(abs(a - b) > 1e-9 for a, b in itertools.pairwise(levels))
        cost = sum((v - m) ** 2 for v, m in zip(x, levels, strict=True)) + 0.01 * changes
        assert math.isclose(cost, brute_segments(x, 0.01), rel_tol=1e-6, abs_tol=1e-9)


SCHEMA = "report_id long, doc_id string, page int, extracted_at timestamp, markdown string, id string"
COLUMNS = ["report_id", "doc_id", "page", "extracted_at", "markdown"]
T0 = datetime(2025, 1, 1)


def pairs(spark, rows):
    df = spark.createDataFrame([(i, d, p, T0 + timedelta(days=i or 0), m, "clash") for i, d, p, m in rows], SCHEMA)
    return {(r.a, r.b) for r in units.unit_pairs(df, COLUMNS).collect()}


def test_pairs(spark):
    kg = table(["Weight (kg)", "Dose (mg)"], [["< 15", "20"], ["15 to < 25", "40"]])
    lb = table(["Weight (lb)", "Dose (mg)"], [["< 33.1", "20"], ["33.1 to < 55.1", "40"]])
    spelt = table(["Weight in kilograms", "Dose (mg)"], [["< 15", "20"], ["15 to < 25", "40"]])
    other = table(["Weight (lb)", "Dose (mg)"], [["< 33.1", "20"], ["33.1 to < 55.1", "60"]])
    rows = [(1, "A", 1, kg), (2, "A", 1, lb), (3, "A", 1, spelt), (4, "A", 1, other), (5, "A", 2, lb), (6, "B", 1, lb), (2, "A", 1, lb), (7, "A", 1, None), (8, None, 1, lb), (None, "A", 1, lb), (9, "A", None, lb), (10, "A", 1, "")]
    assert pairs(spark, rows) == {(1, 2), (2, 3)}
    assert pairs(spark, []) == set()


def test_long_history_is_cut_into_blocks(spark):
    kg = table(["Weight (kg)", "Dose (mg)"], [["< 15", "20"], ["15 to < 25", "40"]])
    g = table(["Weight (g)", "Dose (mg)"], [["< 15000", "20"], ["15000 to < 25000", "40"]])
    rows = [(i, "A", 1, g if i % 50 == 3 else kg) for i in range(1, 301)]
    odd = {i for i in range(1, 301) if i % 50 == 3}
    assert pairs(spark, rows) == {(min(a, b), max(a, b)) for a in odd for b in set(range(1, 301)) - odd}


def test_missing_unit_is_told_by_the_level_shift(spark):
    kg = table(["Weight (kg)", "Dose (mg)"], [["< 15", "20"], ["15 to < 25", "40"]])
    bare = table(["Weight", "Dose (mg)"], [["< 15000", "20"], ["15000 to < 25000", "40"]])
    df = spark.createDataFrame([(1, "A", 1, T0, kg, ""), (2, "A", 1, T0 + timedelta(1), bare, "")], SCHEMA)
    parsed = units.parse_readings(units.readings(df, *COLUMNS), keep_places=True)
    out = units.common_quantities(parsed, units.mark_unit_changes(parsed)).where("id = 2 and col_no = 0").collect()
    assert {(r.value, r.unit) for r in out} == {(15.0, "kg"), (25.0, "kg")}


def test_long_cells_and_notes_name_their_units():
    mg = " + ".join(f"{100 + 25 * k} mg" for k in range(12))
    g = " + ".join(f"{(100 + 25 * k) / 1000} g" for k in range(12))
    a, b = (parse_table(table(["Weight (kg)", "Dose given daily"], [["< 15", x]])) for x in (mg, g))
    assert len(mg) > 60 and a[0] == b[0] and len(a[1]) == len(b[1]) == 13
    told = "The figures of this page were taken down by the staff of the ward and agreed upon with the referral unit before they were sent. " * 2
    for note in (f"{told}Body weights are given in grams.", "Body weights, " + "as they were told by the staff of the ward, " * 4 + "are given in grams."):
        _, quantities = parse_table(table(["Weight", "Dose (mg)"], [["15000", "20"]], f"\n\n{note}"))
        assert [ALL_UNITS[q.code].name for q in quantities] == ["g", "mg"]


def test_units_left_unnamed_in_a_long_history(spark):
    """The search alone tells the units, over more readings than a stretch, whatever their ids."""
    rng = random.Random(3)
    kg = table(["Weight (kg)", "Dose (mg)"], [["< 15", "20"], ["15 to < 25", "40"]])
    bare_kg = table(["Weight", "Dose (mg)"], [["< 15", "20"], ["15 to < 25", "40"]])
    bare_g = table(["Weight", "Dose (mg)"], [["< 15000", "20"], ["15000 to < 25000", "40"]])
    ids = list(range(1, 201))
    rng.shuffle(ids)
    in_grams = {k for k in range(200) if 40 <= k < 75 or 120 <= k < 190 or k == 100}
    rows = [(ids[k], "A", 1, T0 + timedelta(hours=k), kg if k == 0 else bare_g if k in in_grams else bare_kg, "") for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = units.unit_pairs(df, COLUMNS).collect()
    grams = {ids[k] for k in in_grams}
    assert {(r.a, r.b) for r in got} == {(min(a, b), max(a, b)) for a in grams for b in set(ids) - grams}
    assert {r.evidence for r in got} == {"shift"}
    parsed = units.parse_readings(units.readings(df, *COLUMNS), keep_places=True)
    out = units.common_quantities(parsed, units.mark_unit_changes(parsed)).where("col_no = 0 and row_no = 0")
    assert {(r.value, r.unit) for r in out.collect()} == {(15.0, "kg")} and out.count() == 200


def test_evidence_of_pairs(spark):
    rows = [
        (1, "A", 1, table(["Weight (kg)", "Level (g/L)"], [["15", "20"]])),
        (2, "A", 1, table(["Weight (g)", "Level (g/L)"], [["15000", "20"]])),
        (3, "B", 1, table(["Concentration (mg/mL)"], [["20"]])),
        (4, "B", 1, table(["Concentration (g/L)"], [["20"]])),
        (5, "C", 1, table(["Temperature (°C)"], [["40"]])),
        (6, "C", 1, table(["Temperature (°F)"], [["104"]])),
    ]
    df = spark.createDataFrame([(i, d, p, T0 + timedelta(days=i), m, "") for i, d, p, m in rows], SCHEMA)
    assert {tuple(r) for r in units.unit_pairs(df, COLUMNS).collect()} == {(1, 2, "shift"), (3, 4, "name"), (5, 6, "name")}


def test_time_stretches_are_consecutive(spark):
    rows = [(1, 7, k, 1000 * (k % 90) + k) for k in range(300)] + [(1, 8, k, 5) for k in range(150)]
    df = spark.createDataFrame(rows, "page int, history long, id long, at long")
    sizes = df.groupBy("page", "history").agg({"at": "min", "id": "count"}).toDF("page", "history", "lo", "n").join(df.groupBy("page", "history").agg({"at": "max"}).toDF("page", "history", "hi"), ["page", "history"])
    got = units.in_stretches(df, sizes, 64).where("own").collect()
    assert len(got) == 450
    for h, n in ((7, 300), (8, 150)):
        ordered = [r.block for r in sorted((r for r in got if r.history == h), key=lambda r: (r.at, r.id))]
        assert ordered == [k // 64 for k in range(n)]


def test_powers_of_ten_are_counts_and_products_are_not():
    assert parse_table(table(["Criterion", "Threshold"], [["Count", "≥ 4 × 10³/µL"]])) is None
    assert [q.raw for q in parse_table(table(["Weight (kg)", "Volume"], [["10", "2 × 5 mL"]]))[1]] == [10, 2, 5]
