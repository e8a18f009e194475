import json

from pyspark.sql import functions as F

from attesta.operators import evaluation, serving
from attesta.sources.tables import read_fixtures, read_scenarios

TRUST = "facility_id string, capability string, claim_count long, supporting_evidence_count long, contradicting_evidence_count long, trust_score double, status string"
ENTITY = "facility_id string, name string, state string, city string, latitude double, longitude double"


def _tables(spark):
    trust = spark.createDataFrame(
        [("1", "icu", 1, 2, 0, 0.81, "verified"), ("1", "nicu", 1, 0, 1, 0.35, "contradicted"),
         ("2", "icu", 1, 0, 1, 0.35, "contradicted"), ("3", "icu", 1, 1, 0, 0.73, "unclear"),
         ("5", "icu", 1, 1, 0, 0.73, "unclear")], TRUST)
    entities = spark.createDataFrame(
        [("1", "One", "Kerala", "Kochi", 9.0, 76.0), ("2", "Two", "kerala", None, 50.0, 76.0),
         ("3", "Three", None, "Keralapur", None, None), ("4", "Four", "Kerala", "x", 10.0, 77.0),
         ("5", "Five", "Goa", "y", 15.0, 74.0)], ENTITY)
    return trust, entities


def test_triage_order_and_counts(spark):
    trust, entities = _tables(spark)
    assert [r.facility_id for r in serving.triage(trust, entities, "icu").collect()] == ["1", "3", "5", "2"]
    assert [r.facility_id for r in serving.triage(trust, entities, "icu", "ker", 0.5).collect()] == ["1", "3"]
    for place, least in ((None, 0.0), ("ker", 0.0), ("ker", 0.5)):
        rows = serving.triage(trust, entities, "icu", place, least, limit=10**6)
        counts = serving.triage_counts(trust, entities, "icu", place, least).first()
        assert counts.total == rows.count()
        assert counts.verified == rows.filter("status = 'verified'").count()


def test_browse_order_and_counts(spark):
    trust, entities = _tables(spark)
    rows = serving.browse(trust, entities).collect()
    assert [(r.facility_id, r.status) for r in rows] == [
        ("1", "verified"), ("5", "unclear"), ("3", "unclear"), ("4", "unclear"), ("2", "contradicted")]
    assert rows[0].verified_capabilities == ["icu"] and rows[3].trust_score == 0.0
    assert tuple(serving.browse_counts(trust, entities).first()) == (5, 1, 3, 1)
    assert len(serving.browse(trust, entities, limit=2).collect()) == 2
    assert tuple(serving.map_summary(entities).first()) == (3, 1)


def test_districts_are_sorted_before_the_cut(spark):
    rows = [(f"d{i:03}", "S", float(200 - i), 1.0, 1.0, 1.0) for i in range(120)] + [("n", "S", None, 1.0, 1.0, 1.0)]
    ddl = "district string, state string, " + ", ".join(f"{c} double" for c in serving.DISTRICT_INDICATORS)
    got = serving.district_context(spark.createDataFrame(rows, ddl), "S").collect()
    assert [r.district for r in got] == [f"d{i:03}" for i in range(119, 69, -1)]


def test_evaluation(spark, tmp_path):
    scenarios = {"_meta": {}, "scenarios": [
        {"id": i, "facility_id": f, "claim_value": "icu", "expected_status": s}
        for i, (f, s) in enumerate([("1", "verified"), ("2", "contradicted"), ("3", "verified"), ("9", "unclear"), ("4", "unclear")])]}
    fixtures = {k: {"capabilities": ["a"], "description": None} for k in "1234"}
    (tmp_path / "s.json").write_text(json.dumps(scenarios, indent=1))
    (tmp_path / "f.json").write_text(json.dumps(fixtures, indent=1))
    labels = read_scenarios(spark, str(tmp_path / "s.json"))
    known = read_fixtures(spark, str(tmp_path / "f.json"))
    assert labels.count() == 5 and known.count() == 4
    trust, _ = _tables(spark)
    predicted = evaluation.predictions(labels, trust, known)
    assert {(r.id, r.predicted_status) for r in predicted.collect()} == {
        (0, "verified"), (1, "contradicted"), (2, "unclear"), (4, "absent")}
    m = evaluation.metrics(predicted).first()
    assert (m.total, m.passed, m.accuracy, m.contradiction_precision, m.contradiction_recall) == (4, 2, 0.5, 1.0, 1.0)
    grid = {r.expected: (r.verified, r.unclear, r.contradicted, r.absent) for r in evaluation.confusion_matrix(predicted).collect()}
    assert grid == {"verified": (1, 1, 0, 0), "unclear": (0, 0, 0, 1), "contradicted": (0, 0, 1, 0)}
    assert [r.facility_id for r in evaluation.missing_fixtures(labels, known).collect()] == ["9"]
    assert evaluation.misses(predicted).count() == 2
    nothing = evaluation.metrics(predicted.filter(F.lit(False))).first()
    assert (nothing.total, nothing.accuracy, nothing.contradiction_precision) == (0, None, 1.0)
