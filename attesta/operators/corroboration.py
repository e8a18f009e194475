"""What several fields of an entity say together: corroborated claims, and quantities that agree or conflict.

Quantities are read by a small grammar in column expressions: an optional qualifier, a number or a range, and a unit. Each
becomes a typed interval in the base unit of its kind. Bounds are inclusive, as texts use "over" and "at least" alike:
``at least 20 beds`` is 20 and more, ``up to 20`` is 0 to 20, ``about 20`` is 10% around it, ``20-25`` and ``between 20 and 25`` are
20 to 25. A number is digits, or digits in groups of three behind commas, with an optional decimal part; what looks like
a number but is none (``3,5``, ``1.2.3``) says nothing. Of what one field says about a kind the hull counts; the fields of an
entity agree if all hulls have a point in common. All of it folds before the shuffle.

Defined cases: NULL and empty texts say nothing. An interval without an upper end has NULL as ``high``. Repeated rows and
repeated statements change counts of statements only. A NULL entity id is an entity of its own; NULL fields are one field.
Of several statements that set a bound the least quote by field and text is listed. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

# Words for units, their kind and how many base units they are.
UNITS = {
    "beds": ("beds", 1.0), "bed": ("beds", 1.0), "bedded": ("beds", 1.0),
    "doctors": ("doctors", 1.0), "doctor": ("doctors", 1.0), "physicians": ("doctors", 1.0),
    "nurses": ("nurses", 1.0), "nurse": ("nurses", 1.0),
    "square metres": ("area_m2", 1.0), "sq m": ("area_m2", 1.0), "sq ft": ("area_m2", 0.09290304),
}
# Words in front of a number, and what they say about it.
AT_LEAST = ("at least", "more than", "over", "minimum of", "minimum")
AT_MOST = ("at most", "up to", "less than", "under", "maximum of", "maximum")
ABOUT = ("about", "around", "approximately", "nearly")
NEAR = 0.1

_NUMBER = r"[0-9][0-9.,]*[0-9]|[0-9]"
_VALID = r"^([0-9]+|[0-9]{1,3}(,[0-9]{3})+)([.][0-9]+)?$"
_NO_END = 1e300


def _either(words) -> str:
    return "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=lambda w: (-len(w), w)))


def quantity_pattern(units: Mapping[str, tuple[str, float]]) -> str:
    """Groups: qualifier, first number, second number, unit."""
    qualifier = _either((*AT_LEAST, *AT_MOST, *ABOUT, "between"))
    return (
        rf"(?i)\b(?:({qualifier})\s+)?({_NUMBER})(?:\s*(?:-|–|\bto\b|\band\b)\s*({_NUMBER}))?"
        rf"\s*-?\s*({_either(units)})\b"
    )


def _number(text: Column) -> Column:
    return F.when(text.rlike(_VALID), F.replace(text, F.lit(","), F.lit("")).cast("double"))


def quantities(texts: DataFrame, units: Mapping[str, tuple[str, float]] = UNITS) -> DataFrame:
    """(facility_id, source_field, kind, low, high, quote) of every quantity in (facility_id, source_field, text)."""
    pattern = quantity_pattern(units)
    part = lambda quote, i: F.lower(F.regexp_replace(F.regexp_extract(quote, pattern, i), r"\s+", " "))
    parts = F.transform(
        F.when(F.col("text").rlike("[0-9]"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))),
        lambda x: F.struct(
            x.alias("quote"), part(x, 1).alias("word"), part(x, 2).alias("first"), part(x, 3).alias("second"),
            part(x, 4).alias("unit"),
        ),
    )
    # Behind an outer generator the parts are columns; in front of it each test of one would match the text again.
    split = texts.select("facility_id", "source_field", F.inline_outer(parts)).filter("unit IS NOT NULL")
    by_unit = lambda i, kind: F.element_at(
        F.create_map(*[F.lit(x) for w, u in units.items() for x in (w, kind(u[i]))]), F.col("unit"))
    read = split.select(
        "facility_id", "source_field", "quote", "word", "second", by_unit(0, str).alias("kind"),
        (_number(F.col("first")) * by_unit(1, float)).alias("a"), (_number(F.col("second")) * by_unit(1, float)).alias("b"),
    ).filter("a IS NOT NULL AND (second = '' OR b IS NOT NULL)")
    word, a, b = F.col("word"), F.col("a"), F.coalesce("b", "a")
    about = word.isin(*ABOUT)
    low = F.when(word.isin(*AT_MOST), F.lit(0.0)).otherwise(F.least(a, b) * F.when(about, 1 - NEAR).otherwise(1.0))
    high = F.when(~word.isin(*AT_LEAST), F.greatest(a, b) * F.when(about, 1 + NEAR).otherwise(1.0))
    return read.select("facility_id", "source_field", "kind", low.alias("low"), high.alias("high"), "quote")


def quantity_agreement(found: DataFrame) -> DataFrame:
    """(facility_id, kind, n_fields, n_statements, agrees, low, high, low_field, low_quote, high_field, high_quote).

    ``low`` to ``high`` is what all fields have in common. Where they conflict ``low`` is above ``high``, and the two quotes say which
    fields set them.
    """
    end = F.coalesce("high", F.lit(_NO_END))
    hulls = found.groupBy("facility_id", "kind", "source_field").agg(
        F.count("*").alias("n"),
        F.min(F.struct("low", "quote")).alias("least"),
        F.min(F.struct((-end).alias("end"), "quote")).alias("most"),
    )
    # The quote that sets a bound is the least one by field, so the greatest bound is sought as a least negative.
    folded = hulls.groupBy("facility_id", "kind").agg(
        F.count("*").alias("n_fields"), F.sum("n").alias("n_statements"),
        F.min(F.struct((-F.col("least.low")).alias("bound"), "source_field", "least.quote")).alias("x"),
        F.min(F.struct((-F.col("most.end")).alias("bound"), "source_field", "most.quote")).alias("y"),
    )
    low, high = -F.col("x.bound"), F.col("y.bound")
    return folded.select(
        "facility_id", "kind", "n_fields", "n_statements", (low <= high).alias("agrees"), low.alias("low"),
        F.when(high < _NO_END, high).alias("high"),
        F.col("x.source_field").alias("low_field"), F.col("x.quote").alias("low_quote"),
        F.when(high < _NO_END, F.col("y.source_field")).alias("high_field"),
        F.when(high < _NO_END, F.col("y.quote")).alias("high_quote"),
    )


def corroboration(claims: DataFrame, evidence: DataFrame, bonus: float = 0.05) -> DataFrame:
    """(facility_id, capability, n_claims, n_fields, fields, description_supported, confidence) of every claimed pair.

    ``fields`` are the different fields that claim it, in order, comma-joined. ``confidence`` is the best one of the claims plus
    ``bonus`` for each further field, at most 1; NULL if no claim has one. ``description_supported`` says whether the prose holds support for any of them.
    """
    prose = evidence.filter("source_field = 'description' AND polarity = 'supports'")
    supported = prose.select("facility_id", "claim_id").distinct().withColumn("in_prose", F.lit(True))
    met = claims.select("facility_id", "claim_id", "claim_value", "source_field", "extraction_confidence").join(
        supported, ["facility_id", "claim_id"], "left"
    )
    folded = met.groupBy("facility_id", F.col("claim_value").alias("capability")).agg(
        F.count("*").alias("n_claims"), F.collect_set("source_field").alias("held"),
        F.coalesce(F.bool_or("in_prose"), F.lit(False)).alias("description_supported"),
        F.max("extraction_confidence").alias("best"),
    )
    fields = F.size("held")
    boosted = F.least(F.col("best") + bonus * (fields - 1), F.lit(1.0))
    return folded.select(
        "facility_id", "capability", "n_claims", fields.cast("long").alias("n_fields"),
        F.array_join(F.array_sort("held"), ",").alias("fields"), "description_supported",
        F.when(F.col("best").isNotNull(), F.round(boosted, 6)).alias("confidence"),
    )
