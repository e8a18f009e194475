"""Leases against plain lists: capacity, priority, expiry and order."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from attesta.operators.review import lease_rounds, no_leases, open_claims, positions

PAIRS = "facility_id string, capability string, trust_score double, position string"
REVIEWERS = "planner_id string, capacity int, lease_days int, turn string"
TIMES = ["2024-01-01 00:00:00", "2024-01-03 00:00:00", "2024-01-09 00:00:00"]


def data(seed):
    rng = random.Random(seed)
    pairs = [(f"f{rng.randrange(60)}", rng.choice("abc"), rng.choice([None, 0.1, 0.1, 0.5, 0.9]), "x") for _ in range(150)]
    pairs += [(None, "a", 0.0, "x"), ("f1", None, 0.0, "x"), pairs[0]]
    reviewers = [(f"r{i:02}", rng.choice([None, -1, 0, 1, 2, 7]), rng.choice([1, 2, 3, None, 0]), "x") for i in range(40)]
    reviewers += [(None, 5, 1, "x"), ("r00", 2, 1, "x"), ("r00", 1, 9, "x")]
    return pairs, reviewers, [(f"f{i}",) for i in range(0, 60, 9)] + [(None,)]


def wanted(pairs, reviewers, decided):
    scores, people, log = {}, {}, []
    for f, c, s, _ in pairs:
        if f is not None and c is not None and (f,) not in decided:
            scores.setdefault((f, c), []).append(s)
    scores = {k: None if None in v else min(v) for k, v in scores.items()}
    for name, n, days, _ in reviewers:
        if name and n and n > 0 and days and days > 0:
            old = people.get(name, (0, 0))
            people[name] = (max(n, old[0]), max(days, old[1]))
    for time in map(datetime.fromisoformat, TIMES):
        live = [x for x in log if x[4] > time]
        out = {x[0] for x in live}
        queue = sorted((s is not None, s or 0.0, k) for k, s in scores.items() if k not in out)
        free = {p: n - sum(x[2] == p for x in live) for p, (n, _) in people.items()}
        places = sorted((turn, p) for p, n in free.items() for turn in range(n))
        log += [
            (k, scores[k], p, time, time + timedelta(days=people[p][1]))
            for (_, _, k), (_, p) in zip(queue, places, strict=False)
        ]
    return log


def test_rounds_equal_plain_lists_and_runs_agree(spark):
    for seed in (1, 2):
        pairs, reviewers, decided = data(seed)
        runs = []
        for shuffled in (pairs, pairs[::-1]):
            waiting = open_claims(
                spark.createDataFrame(shuffled, PAIRS).repartition(3),
                spark.createDataFrame(decided, "facility_id string"), ["facility_id"],
            )
            got = lease_rounds(waiting, spark.createDataFrame(reviewers, REVIEWERS), TIMES).collect()
            runs.append([
                ((r["facility_id"], r["capability"]), r["trust_score"], r["planner_id"], r["leased_at"], r["expires_at"])
                for r in got
            ])
        want = wanted(pairs, reviewers, decided)
        assert sorted(map(str, runs[0])) == sorted(map(str, runs[1])) == sorted(map(str, want)) and len(want) > 20
        for time in {x[3] for x in want}:
            held = [x for x in want if x[3] <= time < x[4]]
            assert len({x[0] for x in held}) == len(held)


def test_positions_are_exact_and_spread(spark):
    rows = spark.range(5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("x").alias("other"))
    got = positions(rows, "v")
    assert got.columns == ["v", "other", "position"]
    assert got.filter("position != v + 1").count() == 0 and got.count() == 5000
    assert positions(rows.limit(0), "v").count() == 0


def test_empty(spark):
    pairs, reviewers, _ = data(3)
    none = spark.createDataFrame([], "facility_id string, capability string")
    waiting = open_claims(spark.createDataFrame(pairs, PAIRS), none)
    people = spark.createDataFrame(reviewers, REVIEWERS)
    assert lease_rounds(waiting, people.limit(0), TIMES[:1]).count() == 0
    assert lease_rounds(waiting.limit(0), people, TIMES[:1]).count() == 0
    assert no_leases(waiting).columns == lease_rounds(waiting, people, []).columns
