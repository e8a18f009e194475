"""Quantities and what fields say together, against plain Python."""

import random
import re

from pyspark.sql import functions as F

from attesta.functions.cleaning import figure_low_sample, figure_value
from attesta.operators.corroboration import corroboration, quantities, quantity_agreement

TEXTS = "facility_id string, source_field string, text string, kind string, low int"

SAID = {
    "20 beds": [("beds", 20, 20)], "a 20-bedded ward": [("beds", 20, 20)], "20 - 25 beds": [("beds", 20, 25)],
    "between 30 and 25 beds": [("beds", 25, 30)], "20 to 25 BEDS": [("beds", 20, 25)],
    "at  least 20 beds": [("beds", 20, None)], "Over 1,200 beds": [("beds", 1200, None)],
    "up to 8 doctors, about 10 nurses": [("doctors", 0, 8), ("nurses", 9, 11)],
    "3,5 beds": [], "1.2.3 beds": [], "B20 beds": [], "20 bedsteads": [], "beds 20": [], "": [], None: [],
    "12,345,678.5 sq m": [("area_m2", 12345678.5, 12345678.5)], "100 sq ft": [("area_m2", 9.290304, 9.290304)],
    "1 bed and 2 beds": [("beds", 1, 2)], "0 beds": [("beds", 0, 0)], "room 5, 7 beds": [("beds", 7, 7)],
    "minimum of 4 nurses and maximum 9 nurses": [("nurses", 4, None), ("nurses", 0, 9)],
}


def test_grammar(spark):
    rows = [(str(i), "description", t, "x", 1) for i, t in enumerate(SAID)]
    got = {}
    for r in quantities(spark.createDataFrame(rows, TEXTS)).collect():
        high = r["high"] and round(r["high"], 6)
        got.setdefault(int(r["facility_id"]), set()).add((r["kind"], round(r["low"], 6), high))
    wanted = dict(SAID)
    wanted["1 bed and 2 beds"] = [("beds", 1, 1), ("beds", 2, 2)]
    for i, (text, want) in enumerate(wanted.items()):
        assert got.get(i, set()) == {(k, a, b and float(b)) for k, a, b in want}, text


def agreement(found):
    hulls = {}
    for f, s, k, low, high, quote in found:
        hulls.setdefault((f, k), {}).setdefault(s, []).append((low, float("inf") if high is None else high, quote))
    out = {}
    for key, fields in hulls.items():
        ends = {s: (min(x[0] for x in held), max(x[1] for x in held)) for s, held in fields.items()}
        low, high = max(a for a, _ in ends.values()), min(b for _, b in ends.values())
        order = sorted(ends, key=lambda s: (s is not None, s or ""))
        at_low = next(s for s in order if ends[s][0] == low)
        at_high = next(s for s in order if ends[s][1] == high)
        open_end = high == float("inf")
        out[key] = (
            len(fields), sum(map(len, fields.values())), low <= high, low, None if open_end else high,
            at_low, min(q for a, _, q in fields[at_low] if a == low),
            None if open_end else at_high, None if open_end else min(q for _, b, q in fields[at_high] if b == high),
        )
    return out


def test_agreement_equals_plain_lists(spark):
    rng = random.Random(4)
    forms = ("{} beds", "at least {} beds", "up to {} beds", "about {} beds", "{}-40 beds", "{} nurses", "none", None)
    rows = []
    for _ in range(600):
        form = rng.choice(forms)
        field = rng.choice(["description", "capabilities", "equipment", None])
        text = form and form.format(rng.randint(1, 40))
        rows.append((rng.choice([None, *map(str, range(60))]), field, text, "x", 1))
    rows += rows[:50]
    df = spark.createDataFrame(rows, TEXTS)
    found = quantities(df)
    plain = [tuple(r) for r in found.select("facility_id", "source_field", "kind", "low", "high", "quote").collect()]
    assert len(plain) == sum(bool(t and re.search(r"\d", t)) for _, _, t, *_ in rows)
    got = quantity_agreement(found)
    assert {(r[0], r[1]): tuple(r)[2:] for r in got.collect()} == agreement(plain)
    assert {r["agrees"] for r in got.collect()} == {True, False}
    assert quantity_agreement(quantities(df.limit(0))).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_conflicting_counts_are_listed_with_both_quotes(spark):
    rows = [("a", "description", "It has 20 beds.", "", 0), ("a", "capabilities", "A 50-bedded hospital", "", 0),
            ("b", "description", "over 20 beds", "", 0), ("b", "capabilities", "50 beds", "", 0)]
    got = {r["facility_id"]: r for r in quantity_agreement(quantities(spark.createDataFrame(rows, TEXTS))).collect()}
    assert not got["a"]["agrees"] and (got["a"]["low_quote"], got["a"]["high_quote"]) == ("50-bedded", "20 beds")
    assert got["b"]["agrees"] and got["b"]["low"] == got["b"]["high"] == 50


def test_corroboration(spark):
    claims = spark.createDataFrame(
        [("f", "c1", "icu", "capabilities", 0.9), ("f", "c2", "icu", "specialties", 0.7), ("f", "c2", "icu", "specialties", 0.7),
         ("f", "c3", "nicu", "equipment", None), ("g", "c4", "icu", None, 0.99), ("g", "c5", "icu", "equipment", 0.99),
         ("g", "c6", "icu", "capabilities", 0.99)],
        "facility_id string, claim_id string, claim_value string, source_field string, extraction_confidence double")
    evidence = spark.createDataFrame(
        [("f", "c2", "description", "supports"), ("f", "c2", "description", "supports"), ("f", "c3", "equipment", "supports"),
         ("g", "c4", "description", "contradicts")],
        "facility_id string, claim_id string, source_field string, polarity string")
    got = {(r["facility_id"], r["capability"]): tuple(r)[2:] for r in corroboration(claims, evidence).collect()}
    assert got == {
        ("f", "icu"): (3, 2, "capabilities,specialties", True, 0.95), ("f", "nicu"): (1, 1, "equipment", False, None),
        ("g", "icu"): (3, 2, "capabilities,equipment", False, 1.0),
    }
    assert corroboration(claims.limit(0), evidence).count() == 0


def test_published_figures(spark):
    rows = [("29.5", 29.5, False), ("(29.5)", 29.5, True), (" ( 7 ) ", 7.0, True), ("*", None, True), (" * ", None, True),
            ("12 %", 12.0, False), ("(12", None, False), ("12)", None, False), ("", None, False), ("na", None, False),
            (None, None, None), ("-3.5", -3.5, False), ("1e3", None, False), ("()", None, False), ("1,5", None, False)]
    df = spark.createDataFrame(rows, "t string, v double, low boolean").select(
        "t", figure_value(F.col("t")).alias("got"), "v", figure_low_sample(F.col("t")).alias("flag"), "low")
    for r in df.collect():
        assert (r["got"], r["flag"]) == (r["v"], r["low"]), r
