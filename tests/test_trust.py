import random

import pytest
from pyspark.sql import functions as F

from attesta.operators.claims import classify, classify_codes, primary_claims
from attesta.operators.evidence import find_evidence, find_evidence_for
from attesta.operators.trust import gold_trust, trust_from_tables
from attesta.packs import CARE_PACK, NOTICE_PACK
from attesta.plans.bindings import document_entities
from attesta.schemas import CLAIM, EVIDENCE, FIXTURE, TRUST

from . import brute

SF = "/root/testdata/sf0.001"

ONE_ELEMENT = [
    ("capabilities", "Level III NICU not available", {"nicu": (0, 1, 0.35, "contradicted")}),
    ("capabilities", "Second trauma centre block, under construction",
     {"trauma": (0, 1, 0.35, "contradicted")}),
    ("capabilities", "Intensive Care Unit (ICU), 14 beds", {"icu": (1, 0, 0.73, "unclear")}),
    ("capabilities", "Ultrasound and sonography not available",
     {"radiology": (0, 1, 0.35, "contradicted")}),
    ("capabilities", "neonatal ICU", {"nicu": (1, 0, 0.73, "unclear")}),
    ("specialties", "criticalCareMedicine", {"icu": (0, 0, 0.60, "unclear")}),
    ("specialties", " cardiology ", {"cardiology": (1, 0, 0.68, "unclear")}),
    ("specialties", "gynecologyAndObstetrics", {"maternity": (0, 0, 0.60, "unclear")}),
    ("specialties", "obstetricsAndGynecology", {"maternity": (1, 0, 0.68, "unclear")}),
    ("capabilities", "paediatric ward", {}),
    ("description", "ICU cases are referred to district hospital. No NICU.", {}),
    ("capabilities", "", {}),
    ("capabilities", None, {}),
]


def _entity(i, field, value):
    row = dict(facility_id=str(i), capabilities=[], procedures=None, equipment=[], specialties=[],
               description=None)
    row[field] = value if field == "description" else [value]
    return row


def _frame(spark, rows):
    names = [f.name for f in FIXTURE.fields]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FIXTURE)


def _trust(df):
    return {
        (r.facility_id, r.capability): (
            r.claim_count, r.supporting_evidence_count, r.contradicting_evidence_count,
            round(r.trust_score, 6), r.status)
        for r in df.collect()
    }


def test_one_element_facilities(spark):
    rows = [_entity(i, f, v) for i, (f, v, _) in enumerate(ONE_ELEMENT)]
    got = _trust(gold_trust(_frame(spark, rows), CARE_PACK))
    want = {
        (str(i), cap): (1, s, c, t, st)
        for i, (_, _, caps) in enumerate(ONE_ELEMENT) for cap, (s, c, t, st) in caps.items()
    }
    assert got == want


def _random_entities(n, seed=11):
    rnd = random.Random(seed)
    words = ["ICU", "NICU", "neonatal ICU", "intensive care", "no", "not available", "the", "cardiac care unit",
             "CCU", "trauma centre", "under construction", "x-ray", "Xray", "é", "😀", "\n", "beds", "of the",
             "maternity", "obstetrics", "24/7 emergency", "casualty", "referred out", "elsewhere", "  "]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, k)))
    codes = ["criticalCareMedicine", " cardiology", "radiology", "other", "", "radiology"]
    for i in range(n):
        yield dict(
            facility_id=f"f{i}", description=rnd.choice([None, text(120)]),
            capabilities=rnd.choice([None, [text(30) for _ in range(rnd.randint(0, 4))]]),
            procedures=[text(20) for _ in range(rnd.randint(0, 3))] + [None],
            equipment=[text(12) for _ in range(rnd.randint(0, 3))],
            specialties=[rnd.choice(codes) for _ in range(rnd.randint(0, 3))],
        )


@pytest.fixture(scope="module")
def random_rows():
    return list(_random_entities(250))


def test_trust_equals_brute_force(spark, random_rows):
    got = _trust(gold_trust(_frame(spark, random_rows), CARE_PACK))
    want = {
        (r["facility_id"], cap): v for r in random_rows for cap, v in brute.trust_of(r, CARE_PACK).items()
    }
    assert got == want and len(want) > 300


def test_claims_and_evidence_equal_brute_force(spark, random_rows):
    df = _frame(spark, random_rows)
    claims, evidence = classify(df, CARE_PACK), find_evidence(df, CARE_PACK)
    want_c, want_e = set(), set()
    for r in random_rows:
        cs = brute.claims_of(r, CARE_PACK)
        want_c |= {(k, c["capability"], c["span"], c["field"]) for k, c in cs.items()}
        want_e |= {(k, e["claim"], e["snippet"], e["field"], e["polarity"])
                   for k, e in brute.evidence_of(r, cs, CARE_PACK).items()}
    got_c = {(r.claim_id, r.claim_value, r.source_text_span, r.source_field) for r in claims.collect()}
    got_e = {(r.evidence_id, r.claim_id, r.snippet, r.source_field, r.polarity) for r in evidence.collect()}
    assert got_c == want_c and got_e == want_e


def test_documents_equal_brute_force(spark):
    df = document_entities(spark, SF)
    rows = [r.asDict() for r in df.collect()]
    want = {(r["facility_id"], cap): v for r in rows for cap, v in brute.trust_of(r, NOTICE_PACK).items()}
    assert _trust(gold_trust(df, NOTICE_PACK)) == want


def test_three_routes_to_trust_agree(spark, random_rows):
    df = _frame(spark, random_rows)
    claims, evidence = classify(df, CARE_PACK), find_evidence(df, CARE_PACK)
    one_pass = _trust(gold_trust(df, CARE_PACK))
    assert _trust(trust_from_tables(claims, evidence)) == one_pass
    assert _trust(trust_from_tables(claims, find_evidence_for(df, claims, CARE_PACK))) == one_pass


def test_copies_of_an_entity_change_nothing(spark, random_rows):
    """One entity may hold a large share of the rows."""
    df = _frame(spark, random_rows)
    copies = df.unionByName(df.filter("facility_id = 'f3'").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(200)))).drop("n"))
    assert _trust(gold_trust(copies.repartition(13), CARE_PACK)) == _trust(gold_trust(df, CARE_PACK))
    a = {tuple(r) for r in find_evidence(copies.repartition(13), CARE_PACK).collect()}
    assert a == {tuple(r) for r in find_evidence(df, CARE_PACK).collect()}


def test_code_join_equals_row_lookup(spark, random_rows):
    df = _frame(spark, random_rows)
    joined = classify_codes(df, CARE_PACK.code_rows(spark)).select("claim_id", "claim_value", "claim_raw")
    inside = classify(df, CARE_PACK).filter("claim_type = 'specialty'").select("claim_id", "claim_value", "claim_raw")
    assert {tuple(r) for r in joined.collect()} == {tuple(r) for r in inside.collect()}


def test_schemas_and_primary(spark, random_rows):
    df = _frame(spark, random_rows)
    claims = classify(df, CARE_PACK)
    names = lambda s: [(f.name, f.dataType) for f in s.fields]
    assert names(claims.schema) == names(CLAIM)
    assert names(find_evidence(df, CARE_PACK).schema) == names(EVIDENCE)
    assert names(gold_trust(df, CARE_PACK).schema) == names(TRUST)
    pairs = claims.select("facility_id", "claim_value").distinct().count()
    assert primary_claims(claims).count() == pairs
    empty = gold_trust(df.filter("facility_id = 'none'"), CARE_PACK)
    assert empty.collect() == [] and names(empty.schema) == names(TRUST)
