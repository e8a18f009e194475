"""Evidence by literal needles: a claim's own wording and its term, as plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.matching import PAD, WHITE_SPACE, padded, trimmed
from ..packs import NEEDLE_CUES

# Window half-width, cue reach, and scores of raw wording and of the term.
NEEDLE_HALF = 80
CUE_REACH = 40
RAW_SCORE, VALUE_SCORE = 1.0, 0.7


def _quoted(needle: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _window_pattern(needle: Column) -> Column:
    """The window pattern of the matching module with the needle in place of a pattern."""
    q, w = _quoted(needle), NEEDLE_HALF
    window = F.concat(F.lit(rf"(?=((?s:.{{{w}}})"), q, F.lit(rf"(?s:.{{{w}}})))"))
    return F.concat(
        F.lit("(?iu)(?="), q, F.lit(r")(?<=(?![\uDC00-\uDFFF])"), window,
        F.lit(rf"(?s:.{{{w}}})(?:|(?!).{{{w}}}))"), q,
    )


# Fields whose text is searched; the elements of a list are lines of its text.
NEEDLE_FIELDS = ("description", "capabilities", "procedures", "equipment", "specialties")


def entity_texts() -> Column:
    """(source_field, text) of all fields of an entity row."""
    return F.array(
        *[
            F.struct(
                F.lit(f).alias("source_field"),
                (F.col(f) if f == "description" else F.array_join(f, "\n")).alias("text"),
            )
            for f in NEEDLE_FIELDS
        ]
    )


def needle_evidence(claimed: DataFrame) -> DataFrame:
    """Rows (facility_id, claims, texts) to snippets around literal needles.

    ``claims`` holds (claim_value, claim_raw) and ``texts`` (source_field, text). A claim's needles are its
    term and its whole wording. Each distinct needle of an entity is searched once in each text,
    and its hits are then listed for every claim that has it. Polarity looks at what stands before
    the first occurrence inside the snippet.
    """
    worded = F.transform(
        "claims",
        lambda c: F.struct(
            c["claim_value"].alias("claim_value"), c["claim_raw"].alias("claim_raw"),
            F.lower(c["claim_value"]).alias("value"), F.lower(c["claim_raw"]).alias("raw"),
        ),
    )
    lowered_once = claimed.select("facility_id", "texts", worded.alias("worded"))
    needles = F.array_distinct(F.flatten(F.transform("worded", lambda c: F.array(c["value"], c["raw"]))))
    asked = F.transform(
        F.filter(needles, lambda n: n != ""),
        lambda n: F.struct(
            n.alias("needle"),
            F.filter("worded", lambda c: (c["value"] == n) | (c["raw"] == n)).alias("own"),
        ),
    )
    # Outer generators: the plain ones make the optimizer test arrays below, by working them out twice.
    per_text = (
        lowered_once.select("facility_id", "texts", asked.alias("asked"))
        .select("facility_id", "asked", F.explode_outer("texts").alias("t"))
        .select("facility_id", "asked", "t.source_field", "t.text", F.lower("t.text").alias("low"))
        .filter(F.col("text").isNotNull() & (F.col("text") != ""))
    )
    # Needles meet the text inside the row, so no text is copied for each of them.
    found = F.filter("asked", lambda a: F.contains(F.col("low"), a["needle"]))
    windows = lambda needle: F.call_function(
        "regexp_extract_all", padded(F.col("text"), NEEDLE_HALF), _window_pattern(needle), F.lit(1))
    per_needle = F.transform(
        found,
        lambda a: F.transform(
            windows(a["needle"]),
            lambda w, i: F.struct(
                a["needle"].alias("needle"), a["own"].alias("own"), i.alias("hit_ord"), w.alias("window")
            ),
        ),
    )
    hits = per_text.select("facility_id", "source_field", F.explode_outer(F.flatten(per_needle)).alias("h")).select(
        "facility_id", "source_field", "h.*"
    ).filter(F.col("window").isNotNull())
    # Columns of their own, as many cues read them.
    at = F.col("at")
    hits = hits.select("*", trimmed(F.lower("window"), PAD).alias("lowered")).select(
        "*", F.instr(F.col("lowered"), F.col("needle")).alias("at")
    )
    reach = F.substring("lowered", F.greatest(F.lit(1), at - CUE_REACH), F.least(F.lit(CUE_REACH), at - 1))
    hits = hits.select("*", reach.alias("before"))
    denied = F.lit(False)
    for cue in NEEDLE_CUES:
        denied = denied | F.contains(F.col("before"), F.lit(cue))
    judged = hits.select(
        "facility_id", "source_field", "needle", "hit_ord",
        trimmed(F.col("window"), PAD + WHITE_SPACE).alias("snippet"),
        F.when(at == 0, F.lit("neutral")).when(denied, F.lit("contradicts"))
        .otherwise(F.lit("supports")).alias("polarity"),
        F.explode("own").alias("c"),
    )
    return judged.select(
        "facility_id", "c.claim_value", "c.claim_raw", "source_field", "hit_ord", "snippet", "polarity",
        F.when(F.col("needle") == F.col("c.raw"), F.lit(RAW_SCORE)).otherwise(F.lit(VALUE_SCORE))
        .alias("retrieval_score"),
    )
