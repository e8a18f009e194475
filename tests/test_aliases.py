"""Alias resolution against the edit distance of all pairs."""

import random
import re

from pyspark.sql import functions as F

from attesta.operators.aliases import deletions, normal_name, resolve_aliases

STATES = ["Odisha", "Orissa", "Tamil Nadu", "Kerala", "Goa", "Karnataka", "Andhra Pradesh", "Himachal Pradesh",
          "Uttar Pradesh", "Madhya Pradesh", "Bihar", "Delhi", "Jammu & Kashmir", "Łódź"]
CANON = {**{s: s for s in STATES}, "Orissa": "Odisha", "Delhy": "Delhi", "Bihat": "Bihar", "Bihal": "Nihal"}


def normal(s):
    return re.sub(r"[^\w]+|_+", " ", s.lower().replace("&", " and ")).strip()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def judged(raw, table):
    name = normal(raw or "")
    if not name:
        return None, None, "missing"
    most = 2 if len(name) >= 8 else 1 if len(name) >= 4 else 0
    near = [(distance(name, normal(a)), s) for a, s in table if normal(a or "") and (s or "").strip()]
    near = [p for p in near if p[0] <= most]
    if not near:
        return None, None, "unknown"
    d = min(near)[0]
    states = {s for n, s in near if n == d}
    if len(states) > 1:
        return None, d, "ambiguous"
    written = raw in [a for a, s in table if s]
    return states.pop(), d, "exact" if written else "spelling" if d == 0 else "edits"


def garbled(rng, s):
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("aeit ") + s[i:], s[:i] + rng.choice("xo") + s[i + 1 :]])
    return s


def test_rows_equal_all_pairs(spark):
    rng = random.Random(6)
    table = [*CANON.items(), ("  ", "Blank"), (None, "None"), ("Goa", None)]
    names = [garbled(rng, rng.choice(list(CANON))) for _ in range(900)]
    names += ["ODISHA", " odisha!", "Jammu and Kashmir", "go", "Gao", None, "", " \t", "Bihar", "Bihax", "x" * 300, "Łodz"]
    rows = [(str(i) if i % 9 else None, n) for i, n in enumerate(names)] + [("1", "Keralla")] * 3
    df = spark.createDataFrame(rows, "facility_id string, state_raw string").repartition(4)
    df = df.selectExpr("*", "'x' AS name", "'y' AS state", "1 AS distance", "2 AS part")
    dim = spark.createDataFrame(table, "alias string, state string")
    got = sorted(map(str, (tuple(r) for r in resolve_aliases(df, dim).collect())))
    want = sorted(str((i, n, *judged(n, table))) for i, n in rows)
    assert got == want
    assert {"edits", "ambiguous", "exact", "spelling", "unknown", "missing"} == {judged(n, table)[2] for _, n in rows}


def test_empty_tables_and_plan(spark):
    rows = spark.createDataFrame([("a", "Goa"), ("b", None)], "facility_id string, state_raw string")
    none = spark.createDataFrame([], "alias string, state string")
    assert {(r.row_id, r.reason) for r in resolve_aliases(rows, none).collect()} == {("a", "unknown"), ("b", "missing")}
    assert resolve_aliases(rows.limit(0), none).count() == 0
    plan = resolve_aliases(rows, none)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_deletions_and_normal_names(spark):
    row = spark.range(1).select(
        deletions(F.lit("abc"), F.lit(1)).alias("a"), deletions(F.lit(""), F.lit(2)).alias("b"),
        normal_name(F.lit(" A & B's--c ")).alias("n"),
    ).head()
    assert sorted(row.a) == ["ab", "abc", "ac", "bc"] and row.b == [""] and row.n == "a and b s c"
