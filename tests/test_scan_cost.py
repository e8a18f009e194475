"""Patterns are tried only on texts that may match, and lose no match by it."""

import re

from pyspark.sql import functions as F

from attesta.functions.matching import FLAGS, _needs, any_of, matches, matches_any, searchable
from attesta.operators.claims import with_claims
from attesta.packs import CARE_PACK, NOTICE_PACK, REVISED_NOTICE_PACK


def test_needs_of_patterns():
    assert _needs(r"\bof the\b") == ("of the", False)
    assert _needs(r"\bmit license\b") == ("t l", False)
    assert _needs(r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}\b") == (" (", True)
    assert _needs(r"\b(?:no|not)\b") == ("", False)
    assert _needs(r"ab?c+d{2}e") == ("a", False)
    assert _needs(r"\d?x\d*y\d{0,2}z") == ("x", False)
    assert _needs(r"\x41b") == _needs(r"\p{Lu}bc") == _needs(r"(?=a)bcd") == _needs("ébc") == ("", False)


def test_literals_have_no_further_forms(spark):
    # All characters beyond ASCII against the letters and digits that a literal may hold.
    letters = [c for c in "abcdefghijklmnopqrstuvwxyz0123456789" if c not in "iks"]
    rx = FLAGS + "|".join(letters)
    chars = spark.range(128, 0x110000).filter("id < 55296 OR id > 57343").selectExpr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32') AS c")
    assert chars.filter(F.col("c").rlike(rx)).count() == 0
    assert chars.filter(F.col("c").rlike(FLAGS + "[iks]")).count() > 0


def test_gated_patterns_equal_plain_ones(spark):
    texts = [
        "Of THE people", "MİT LICENSE", "mıt licenſe", "MIT licenses", "APACHE LICENſE", "+49 (030) 123-4567", "+٤٩ (٠٣٠) ١٢٣-٤٥٦٧",
        "x.y@Host.EXAMPLE.org", "١.٢.٣.٤", "4111111111111", "", None, "General  Public License", "24/7 emergency", "peDIAtric",
        "LAPAROſCOPY", "the 1.2.3.4", "ICU and NICU", "Kardiac CARDIAC", "x-ray", "xray", "X RAY", "CT sCAN", "ım the ßthe",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    held = df.withColumn("held", searchable(F.col("text")))
    for pack in (CARE_PACK, NOTICE_PACK, REVISED_NOTICE_PACK):
        for p in pack.patterns:
            plain = F.col("text").rlike(any_of((p,)))
            assert held.filter(~matches(F.col("held"), p).eqNullSafe(plain)).count() == 0, p
        plain = F.col("text").rlike(any_of(pack.patterns))
        assert held.filter(~matches_any(F.col("held"), pack.patterns).eqNullSafe(plain)).count() == 0


def test_claims_try_no_pattern_that_cannot_match(spark):
    none = F.array().cast("array<string>")
    df = spark.range(1).select(
        F.lit("a").alias("facility_id"), F.array(F.lit("plain words")).alias("capabilities"),
        none.alias("procedures"), none.alias("equipment"), none.alias("specialties"),
    )
    plan = with_claims(df, NOTICE_PACK)._jdf.queryExecution().analyzed().toString()
    assert len(re.findall(r"Contains\(", plan)) >= len(NOTICE_PACK.patterns) - 2
