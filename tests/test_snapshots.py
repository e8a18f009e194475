"""Versioned snapshots against dictionaries."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from attesta.operators.snapshots import as_of, flips, intervals, load_snapshot, snapshot_diff

KEY, VALUES = ("facility_id", "capability"), ("status", "trust_score")
ROWS = "facility_id string, capability string, status string, trust_score double"
DAY = [dt.datetime(2024, 1, d) for d in range(1, 9)]


def random_snapshot(rng):
    return {
        (f"f{i}", c): (rng.choice(["verified", "unclear", "contradicted", None]), rng.choice([0.1, 0.9, None]))
        for i in range(25) for c in "ab" if rng.random() < 0.6
    }


def frame(spark, snapshot):
    rows = [(*k, *v) for k, v in snapshot.items()]
    return spark.createDataFrame(rows, ROWS).withColumns({"valid_from": F.lit(1), "change": F.lit("x"), "old": F.lit(2)})


def read(df):
    return {(r.facility_id, r.capability): (r.status, r.trust_score) for r in df.collect()}


@pytest.fixture
def log(spark):
    name = "trust_changes_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_snapshots_read_back(spark, log):
    rng = random.Random(8)
    taken = [random_snapshot(rng) for _ in range(4)] + [{}, random_snapshot(rng)]
    for day, snapshot in zip(DAY, taken):
        load_snapshot(spark, log, frame(spark, snapshot), day)
        n = spark.table(log).count()
        load_snapshot(spark, log, frame(spark, snapshot), day)
        load_snapshot(spark, log, frame(spark, snapshot), day + dt.timedelta(hours=3))
        assert spark.table(log).count() == n
    for day, snapshot in zip(DAY, taken):
        assert read(as_of(spark.table(log), day + dt.timedelta(hours=1), KEY, VALUES)) == snapshot
    assert read(as_of(spark.table(log), DAY[0] - dt.timedelta(days=1), KEY, VALUES)) == {}
    versions = intervals(spark.table(log), KEY, VALUES).collect()
    for day, snapshot in zip(DAY, taken):
        held = {
            (r.facility_id, r.capability): (r.status, r.trust_score) for r in versions
            if r.valid_from <= day and (r.valid_to is None or day < r.valid_to)
        }
        assert held == snapshot


def test_late_snapshots_are_refused_and_a_failed_load_leaves_the_log(spark, log):
    load_snapshot(spark, log, frame(spark, {("f", "a"): ("verified", 0.9)}), DAY[3])
    with pytest.raises(ValueError, match="after"):
        load_snapshot(spark, log, frame(spark, {}), DAY[2])
    broken = frame(spark, {("f", "a"): ("unclear", 0.5)}).withColumn("status", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        load_snapshot(spark, log, broken, DAY[4])
    assert spark.table(log).count() == 1
    load_snapshot(spark, log, frame(spark, {}), DAY[5])
    assert as_of(spark.table(log), DAY[6], KEY, VALUES).count() == 0


def test_flips(spark):
    before = {("a", "x"): ("verified", 0.9), ("b", "x"): ("unclear", 0.5), ("c", "x"): ("contradicted", 0.1),
              ("d", "x"): ("verified", 0.9), ("e", "x"): ("verified", 0.9)}
    after = {("a", "x"): ("contradicted", 0.2), ("b", "x"): ("verified", 0.8), ("c", "x"): ("contradicted", 0.3),
             ("e", "x"): ("verified", 0.9), ("f", "x"): ("unclear", 0.4)}
    got = {(r.facility_id, r.change, r.old_status, r.new_status, r.alert) for r in flips(frame(spark, before), frame(spark, after)).collect()}
    assert got == {
        ("a", "changed", "verified", "contradicted", "worse"), ("b", "changed", "unclear", "verified", "better"),
        ("d", "vanished", "verified", None, "gone"), ("f", "appeared", None, "unclear", "new"),
    }
    none = frame(spark, {})
    assert flips(none, none).count() == 0 and flips(none, frame(spark, after)).count() == 5
    assert snapshot_diff(frame(spark, before), frame(spark, before), KEY, VALUES).count() == 0
