"""Evidence: every mention of a claimed term in the entity's own text, with polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cleaning import cut
from ..functions.matching import (
    match_windows, padded, quote, regex, short_sha1, text_after, text_before,
)
from ..packs import RulePack
from .claims import SPAN_HALF, primary_claims, terms, with_claims
from .elements import field_elements

# Cue windows in characters, and the part of a snippet that names it (None: all).
CUE_BEFORE_WIDTH = 50
CUE_AFTER_WIDTH = 80
SNIPPET_KEY_LENGTH = 64

_HIT = "array<struct<rule_ord:int,claim_id:string,window:string>>"


def row_primary(claims: Column, pack: RulePack) -> Column:
    """Primary claim id per rule of one entity row, NULL where a rule has no claim.

    Highest confidence first, then emission order. NULL as a whole without any claim.
    """
    best_first = F.array_sort(
        F.transform(
            claims,
            lambda c, i: F.struct(
                (-c["extraction_confidence"]).alias("neg"),
                i.alias("i"),
                c["claim_value"].alias("term"),
                c["claim_id"].alias("claim_id"),
            ),
        )
    )
    ids = F.transform(
        terms(pack),
        lambda t: F.get(F.filter(best_first, lambda c: c["term"] == t), F.lit(0))["claim_id"],
    )
    return F.when(F.size(claims) > 0, ids)


def haystacks() -> Column:
    """All text of one row in scan order.

    Array fields come from ``marked``: an element without any pattern hit has no
    evidence either.
    """
    text = "array<struct<source_field:string,text:string>>"
    prose = F.array(
        F.struct(F.lit("description").alias("source_field"), F.col("description").alias("text"))
    )
    listed = F.transform(
        F.col("marked"), lambda e: F.struct(e["source_field"], e["text"])
    )
    codes = F.transform(
        field_elements("specialties", 0), lambda e: F.struct(e["source_field"], e["text"])
    )
    return F.concat(prose.cast(text), listed.cast(text), codes.cast(text))


def scan(text: Column, claimed: Column, pack: RulePack) -> Column:
    """All matches of all patterns of the claimed terms in one text, in pattern order.

    ``claimed`` holds a claim id per rule; rules without one are not searched.
    """
    source = padded(text, SPAN_HALF)
    windows, rule_of = [], []
    for i, rule in enumerate(pack.rules):
        asked = F.get(claimed, F.lit(i)).isNotNull()
        for p in rule.patterns:
            windows.append(F.when(asked, match_windows(source, p, SPAN_HALF)))
            rule_of.append(F.lit(i))
    rules = F.array(*rule_of)

    def tagged(found: Column, k: Column) -> Column:
        rule = F.get(rules, k)
        return F.transform(found, lambda w: F.struct(rule, F.get(claimed, rule), w))

    hits = F.transform(F.array(*windows), tagged)
    return F.flatten(F.filter(hits, lambda a: a.isNotNull())).cast(_HIT)


def polarity(window: Column, pack: RulePack) -> Column:
    before = text_before(window, SPAN_HALF, CUE_BEFORE_WIDTH)
    after = text_after(window, SPAN_HALF, CUE_AFTER_WIDTH)
    denied = before.rlike(regex(pack.cue_before)) | after.rlike(regex(pack.cue_after))
    return F.when(denied, F.lit("contradicts")).otherwise(F.lit("supports"))


def evidence_id(
    claim_id: Column, snippet_: Column, key_length: int | None = SNIPPET_KEY_LENGTH
) -> Column:
    """Hits of a claim whose snippets share their first ``key_length`` characters are one."""
    return short_sha1(claim_id, cut(snippet_, key_length))


def hit_order(hay_ord: Column, hit_ord: Column) -> Column:
    """Scan position of a hit as one long; both parts are array positions below 2^31."""
    return F.shiftleft(hay_ord.cast("long"), 31) + hit_ord


def evidence_hits(claimed: DataFrame, pack: RulePack) -> DataFrame:
    """Rows with ``marked`` and ``claimed`` (claim id per rule) to one row per match."""
    # Rows without claims are dropped by the generator: a filter would be pushed down and
    # make the claims be worked out twice.
    texts = F.when(F.col("claimed").isNotNull(), haystacks())
    per_text = (
        claimed.select("facility_id", "claimed", F.posexplode_outer(texts).alias("hay_ord", "h"))
        .select("facility_id", "claimed", "hay_ord", "h.source_field", "h.text")
        .filter(F.col("text").isNotNull())
    )
    per_hit = (
        per_text.select(
            "facility_id", "hay_ord", "source_field",
            F.posexplode_outer(scan(F.col("text"), F.col("claimed"), pack)).alias("hit_ord", "m"),
        )
        .filter(F.col("m").isNotNull())
        .select("facility_id", "hay_ord", "hit_ord", "source_field", "m.*")
    )
    return per_hit.select(
        "facility_id", "claim_id", "source_field",
        hit_order(F.col("hay_ord"), F.col("hit_ord")).alias("scan_ord"),
        polarity(F.col("window"), pack).alias("polarity"),
        quote(F.col("window")).alias("snippet"),
    )


def keep_first_evidence(hits: DataFrame, key_length: int | None = SNIPPET_KEY_LENGTH) -> DataFrame:
    """First scanned hit per (claim, snippet key); it fixes polarity and field."""
    return (
        hits.withColumn("evidence_id", evidence_id(F.col("claim_id"), F.col("snippet"), key_length))
        .groupBy("facility_id", "claim_id", "evidence_id")
        .agg(F.min(F.struct("scan_ord", "snippet", "source_field", "polarity")).alias("row"))
        .select(
            "facility_id", "evidence_id", "claim_id", "row.snippet", "row.source_field",
            "row.polarity", F.lit(1.0).alias("retrieval_score"),
        )
    )


def find_evidence(
    entities: DataFrame, pack: RulePack, key_length: int | None = SNIPPET_KEY_LENGTH
) -> DataFrame:
    """Entities to the evidence table; claims are found on the way, inside the row."""
    claimed = with_claims(entities, pack).withColumn(
        "claimed", row_primary(F.col("claims"), pack)
    )
    return keep_first_evidence(evidence_hits(claimed, pack), key_length)


def find_evidence_for(
    entities: DataFrame, claims: DataFrame, pack: RulePack,
    key_length: int | None = SNIPPET_KEY_LENGTH,
) -> DataFrame:
    """Evidence for a claim table that the rules alone did not make (model claims).

    Claims are folded to one small map per entity, at most one entry per term, before
    they meet the text. That side is hashed, so texts stream past it and are not sorted; where
    it is measured small, it is broadcast and no text moves.
    """
    known = primary_claims(claims).filter(F.col("capability").isin(*pack.taxonomy))
    by_term = F.map_from_entries(F.collect_list(F.struct("capability", "claim_id")))
    by_entity = (
        known.groupBy("facility_id")
        .agg(by_term.alias("m"))
        .select(
            "facility_id",
            F.transform(terms(pack), lambda t: F.try_element_at(F.col("m"), t)).alias("claimed"),
        )
    )
    marked = with_claims(entities, pack).drop("claims")
    met = marked.join(by_entity.hint("shuffle_hash"), "facility_id")
    return keep_first_evidence(evidence_hits(met, pack), key_length)
