from pyspark.sql import functions as F

from attesta.operators.claims import classify
from attesta.operators.evidence import find_evidence_for
from attesta.operators.inference import (
    answers_kept, ask_model, cached_answers, classify_prompt, classify_with_model, extract_prompt, failures,
    parse_response,
)
from attesta.packs import CARE_PACK
from attesta.schemas import FIXTURE

ANSWERS = {
    '{"claim_value": "ICU ", "confidence": 0.6}': ("icu", 0.6),
    'Sure! {"claim_value": "icu", "confidence": 0.6} hope it helps': ("icu", 0.6),
    '{"claim_value": "spa", "confidence": 0.6}': ("other", 0.6),
    '{"claim_value": "other"}': ("other", 0.5),
    '{"claim_value": "icu", "confidence": "high"}': ("icu", 0.5),
    '{"claim_value": "icu", "confidence": "0.4"}': ("icu", 0.4),
    '{"claim_value": "icu", "confidence": null}': ("icu", 0.5),
    '{"claim_value": "icu", "confidence": 1.7}': ("icu", 0.75),
    '{"claim_value": "icu", "confidence": -1}': ("icu", 0.0),
    '{"x": {"claim_value": "icu"}': ("icu", 0.5),
    '{"confidence": 0.9}': None,
    '{"claim_value": ""}': None,
    "[1]": None,
    "{'claim_value': 'icu', 'confidence': 0.6}": None,
    '{"claim_value": "icu", "claim_value": "trauma", "confidence": 0.1, "confidence": 0.7}': ("trauma", 0.7),
    '{"claim_value": "icu", "confidence": "0.6f"}': ("icu", 0.5),
    '{"claim_value": "icu", "confidence": "1e-1"}': ("icu", 0.1),
    '{"claim_value": "icu", "confidence": " 0.25 "}': ("icu", 0.25),
    '{"claim_value": "icu", "confidence": "0x1p-2"}': ("icu", 0.5),
    '{"claim_value": "icu", "confidence": "Infinity"}': ("icu", 0.75),
    '{"claim_value": "icu", "confidence": true}': ("icu", 0.75),
    '{"claim_value": "icu"} and } more': ("icu", 0.5),
    "no idea": None,
    "": None,
    None: None,
}


def test_parse_response(spark):
    df = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, raw string")
    got = df.withColumn("a", parse_response(F.col("raw"), CARE_PACK.taxonomy)).orderBy("i").collect()
    assert [None if r.a is None else tuple(r.a) for r in got] == list(ANSWERS.values())


def _entities(spark):
    rows = [
        ("f1", ["Heart ward", "10-bed ICU", "Heart ward"], ["Heart ward"], ["spa"], ["cardiology"], "cardiology"),
        ("f2", ["broken call", None, ""], None, [], [], None),
    ]
    return spark.createDataFrame(rows, FIXTURE)


def _model(prompts):
    if any("broken" in p for p in prompts):
        raise RuntimeError("endpoint down")
    return ['{"claim_value": "cardiology", "confidence": 0.9}' if "Heart" in p else "none" for p in prompts]


def test_off_by_default(spark):
    df = _entities(spark)
    assert set(classify_with_model(df, CARE_PACK).collect()) == set(classify(df, CARE_PACK).collect())


def test_stub_model_fills_only_what_rules_leave(spark):
    got = classify_with_model(_entities(spark), CARE_PACK, _model).collect()
    found = sorted((r.facility_id, r.claim_type, r.claim_value, r.claim_raw, r.extraction_confidence, r.extraction_method) for r in got)
    assert found == [
        ("f1", "capability", "cardiology", "Heart ward", 0.75, "llm"),
        ("f1", "capability", "icu", "10-bed ICU", 0.85, "rules"),
        ("f1", "procedure", "cardiology", "Heart ward", 0.75, "llm"),
        ("f1", "specialty", "cardiology", "cardiology", 0.8, "rules"),
    ]


def test_evidence_of_model_claims(spark):
    df = spark.createDataFrame(
        [("f1", ["Heart ward"], [], [], [], "cardiology on site, no cardiac surgery")], FIXTURE)
    claims = classify_with_model(df, CARE_PACK, _model)
    got = sorted((r.polarity, r.source_field) for r in find_evidence_for(df, claims, CARE_PACK).collect())
    assert got == [("supports", "description")]


def test_a_failing_prompt_costs_its_own_answer_only(spark):
    asked = spark.createDataFrame(
        [(f"k{i}", "broken" if i == 7 else f"p{i}") for i in range(51)], "prompt_key string, prompt string"
    ).coalesce(1)

    def model(prompts):
        if "broken" in prompts:
            raise RuntimeError("endpoint down")
        return [f"to {p}" for p in prompts]

    got = ask_model(asked, model).collect()
    assert sum(r.response is not None for r in got) == 50
    assert [(r.prompt_key, r.error) for r in failures(ask_model(asked, model)).collect()] == [
        ("k7", "RuntimeError: endpoint down")
    ]
    short = ask_model(asked, lambda ps: ["x"] * (len(ps) if len(ps) == 1 else len(ps) - 1)).collect()
    assert {r.response for r in short} == {"x"} and len(short) == 51
    none = ask_model(asked, lambda ps: []).collect()
    assert {r.error for r in none} == {"0 answers to one prompt"}


def test_answers_are_kept_and_asked_once(spark, tmp_path):
    spark.sql("CREATE SCHEMA IF NOT EXISTS answers_test")
    log = tmp_path / "asked"

    def model(prompts):
        with log.open("a") as f:
            f.writelines(p + "\n" for p in prompts)
        if any("broken" in p for p in prompts):
            raise RuntimeError("endpoint down")
        return ["told"] * len(prompts)

    first = spark.createDataFrame([("a", "pa"), ("b", "broken"), ("a", "pa")], "prompt_key string, prompt string")
    got = answers_kept(first, model, "answers_test.cache").collect()
    assert [tuple(r) for r in got] == [("a", "told")]
    asked = log.read_text().split().count("pa")
    more = first.union(spark.createDataFrame([("c", "pc")], first.schema))
    assert {r.prompt_key for r in answers_kept(more, model, "answers_test.cache").collect()} == {"a", "c"}
    assert log.read_text().split().count("pa") == asked
    assert spark.table("answers_test.cache").count() == 2
    assert {r.prompt_key for r in spark.table("answers_test.cache_failures").collect()} == {"b"}


def test_uncut_prompts_and_quotes(spark):
    df = spark.createDataFrame([("f1", ["Heart ward " + "x" * 900], [], [], [], None)], FIXTURE)
    p = df.select(classify_prompt(F.lit("c"), F.col("capabilities")[0], CARE_PACK, None).alias("p")).first().p
    assert "x" * 900 in p
    icu = spark.createDataFrame([("f1", ["ICU " + "y" * 300], [], [], [], None)], FIXTURE)
    assert len(classify(icu, CARE_PACK).first().claim_raw) == 200
    assert len(classify(icu, CARE_PACK, None).first().claim_raw) == 304


def test_cache_is_asked_first(spark):
    asked = spark.createDataFrame(
        [("k1", "p1"), ("k2", "p2"), ("k1", "p1")], "prompt_key string, prompt string")
    cache = spark.createDataFrame([("k1", "kept"), ("k9", "unused")], "prompt_key string, response string")
    got = cached_answers(asked, lambda ps: [f"new {p}" for p in ps], cache).collect()
    assert sorted(tuple(r)[:2] for r in got) == [("k1", "kept"), ("k2", "new p2")]
    assert ask_model(asked, lambda ps: ["x"] * len(ps)).count() == 2


def test_prompts_keep_values_as_they_are(spark):
    df = spark.createDataFrame([("{text} " + "x" * 600,)], "t string")
    p = df.select(classify_prompt(F.lit("capabilities"), F.col("t"), CARE_PACK).alias("p")).first().p
    assert ("Place: capabilities\nNote: {text} " + "x" * 493 + "\n") in p and "icu, nicu" in p
    e = df.select(extract_prompt(F.lit("n"), F.col("t"), F.lit(None).cast("string"), F.lit("q"), F.lit("r"), CARE_PACK).alias("p")).first().p
    assert "Capability: \nProcedure: q\n" in e
