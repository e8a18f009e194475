"""District gaps against plain loops."""

import random
from statistics import mean

from attesta.operators.gaps import district_gaps

TRUST = "facility_id string, capability string, trust_score double, status string, level string"
FACILITIES = "facility_id string, state string, district string, burden int"
BURDENS = "state string, district string, burden double, capability string"


def data(seed):
    rng = random.Random(seed)
    places = [(s, d) for s in ("A", "B", None) for d in ("x", "y", "z", None)]
    # A third of all facilities are in one district.
    facilities = [(f"f{i}", *(("A", "x") if i % 3 == 0 else rng.choice(places[:-2])), 0) for i in range(150)]
    facilities += [facilities[0], ("f1", "A", "a", 0), (None, "A", "x", 0)]
    trust = [
        (f"f{rng.randrange(170)}", rng.choice(["icu", "nicu", "other"]), rng.choice([None, 0.1, 0.4, 0.8]),
         rng.choice(["verified", "unclear", "contradicted"]), "x") for _ in range(300)
    ]
    burdens = [(s, d, rng.choice([None, 10.0, 20.0, 35.5]), "x") for s, d in places]
    return trust, facilities, burdens + [burdens[1], ("C", "only", 50.0, "x")]


def wanted(trust, facilities, burdens, capabilities):
    first = lambda p: tuple((x is not None, x or "") for x in p)
    place = {}
    for f, s, d, _ in facilities:
        place[f] = min(place.get(f, (s, d)), (s, d), key=first)
    held = {}
    for s, d, b, _ in burdens:
        held.setdefault((s, d), []).append(b)
    burden = {k: mean([b for b in v if b is not None]) if any(b is not None for b in v) else None for k, v in held.items()}
    best, order = {}, ["contradicted", "unclear", "verified"]
    for f, c, score, status, _ in trust:
        old = best.get((f, c), (None, -1))
        known = [x for x in (old[0], score) if x is not None]
        best[f, c] = (max(known, default=None), max(old[1], order.index(status)))
    ups = (("district", lambda p: p), ("state", lambda p: (p[0], None)), ("country", lambda p: (None, None)))
    out = {}
    for level, up in ups:
        for c in capabilities:
            rows = {}
            for key in {up(p) for p in place.values()} | {up(p) for p in burden}:
                inside = [f for f, p in place.items() if up(p) == key]
                known = [b for p, b in burden.items() if up(p) == key and b is not None]
                scores = [best[f, c] for f in inside if f is not None and (f, c) in best]
                values = sorted(x for x, _ in scores if x is not None)
                n_verified = sum(s == 2 for _, s in scores)
                coverage = n_verified / len(inside) if inside else None
                b = mean(known) if known else None
                gap = None if b is None else round(b * (1 - (coverage or 0.0)), 6)
                median = values[-(-len(values) // 2) - 1] if values else None
                rows[key] = [len(inside), len(scores), n_verified, median, coverage and round(coverage, 6), b and round(b, 6), gap]
            gaps = [r[-1] for r in rows.values() if r[-1] is not None]
            for key, r in rows.items():
                rank = None if r[-1] is None else 1 + sum(g > r[-1] for g in gaps)
                share = None if r[-1] is None else round(sum(g < r[-1] for g in gaps) / max(1, len(gaps) - 1), 6)
                out[level, *key, c] = (*r, rank, share)
    return out


def test_gaps_equal_plain_loops(spark):
    for seed in (1, 2):
        trust, facilities, burdens = data(seed)
        dfs = [spark.createDataFrame(r, s) for r, s in ((trust, TRUST), (facilities, FACILITIES), (burdens, BURDENS))]
        found = district_gaps(*dfs, ["icu", "nicu", "icu"])
        rows = found.collect()
        got = {tuple(r)[:4]: tuple(r)[4:] for r in rows}
        assert len(got) == len(rows) and got == wanted(trust, facilities, burdens, ["icu", "nicu"])
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_tables(spark):
    trust, facilities, burdens = data(3)
    t, f, b = (spark.createDataFrame(r, s) for r, s in ((trust, TRUST), (facilities, FACILITIES), (burdens, BURDENS)))
    assert district_gaps(t.limit(0), f.limit(0), b.limit(0), ["icu"]).count() == 0
    rows = district_gaps(t.limit(0), f, b.limit(0), ["icu"]).collect()
    assert rows and all(r["gap"] is None and r["gap_rank"] is None and r["n_verified"] == 0 for r in rows)
    rows = district_gaps(t, f.limit(0), b, ["icu"]).collect()
    assert rows and all(r["coverage"] is None and r["gap"] == r["burden"] for r in rows)
