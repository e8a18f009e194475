"""Needles meet texts inside their row, and their windows are trimmed as ``btrim`` would."""

from pyspark.sql import functions as F

from attesta.functions.matching import PAD, WHITE_SPACE, trimmed
from attesta.operators.needles import needle_evidence


def test_trimmed_equals_btrim(spark):
    texts = ["\x7f\x7f a \x7fb\n\x7f", "\x7f\x7f", "", "a", "　\U0001f600 x\U0001f600\x7f", " \n", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    ends = PAD + WHITE_SPACE
    rows = df.select(trimmed(F.col("text"), ends), F.btrim("text", F.lit(ends))).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows] == ["a \x7fb", "", "", "a", "\U0001f600 x\U0001f600", "", None]


def test_needles_copy_no_text(spark):
    claims = [("Spa", "the SPA"), ("Spa", None), ("", "x")]
    df = spark.createDataFrame(
        [("f", claims, [("description", "no spa. The spa"), ("equipment", None)])],
        "facility_id string, claims array<struct<claim_value string, claim_raw string>>, "
        "texts array<struct<source_field string, text string>>",
    )
    found = needle_evidence(df)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("Generate " in line for line in plan.splitlines()) <= 3  # texts, hits, claims; not needles
    rows = sorted((r.claim_raw or "", r.hit_ord, r.retrieval_score) for r in found.collect())
    assert rows == [
        ("", 0, 0.7), ("", 1, 0.7), ("the SPA", 0, 0.7), ("the SPA", 0, 1.0), ("the SPA", 1, 0.7)
    ]
    assert {r.polarity for r in found.collect()} == {"contradicts"}
