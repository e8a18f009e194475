"""Rule claims: which taxonomy terms an entity's own array elements name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cleaning import cut
from ..functions.matching import (
    first_window, matches, matches_any, padded, quote, searchable, short_sha1, strip, window_regex,
)
from ..packs import RULE_BITS, RulePack
from .elements import CLAIM_FIELDS, CLAIM_TYPE, TEXT_FIELDS, field_elements, non_empty

# Confidence by field, span half-width and quote length (None: uncut).
CONFIDENCE = {"capabilities": 0.85, "specialties": 0.80, "procedures": 0.75, "equipment": 0.75}
SPAN_HALF = 100
QUOTE_LENGTH = 200

# Fixed value: what made a claim, where no model did.
RULES_MODEL = "rules-v1"

BROADCAST_CODES = 100_000

_CLAIMS = (
    "array<struct<field_ord:int,elem_ord:int,rule_ord:int,pat_ord:int,claim_value:string,"
    "claim_id:string,claim_type:string,source_field:string,element:string,span:string,"
    "extraction_confidence:double>>"
)


def emission_order(field_ord: Column, elem_ord: Column, rule_ord: Column) -> Column:
    """Place of a claim in the entity's emission order, as one comparable long."""
    element = F.shiftleft(field_ord.cast("long"), 31) + elem_ord
    return F.shiftleft(element, RULE_BITS) + rule_ord


def _by_field(source_field: Column, values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[source_field]


def terms(pack: RulePack) -> Column:
    return F.array(*[F.lit(t) for t in pack.taxonomy])


def _span(held: Column, patterns: tuple[str, ...]) -> Column:
    """The text around the first match of the first pattern that matches."""
    source = padded(held["text"], SPAN_HALF)
    return F.coalesce(
        *[
            F.when(matches(held, p), quote(first_window(source, F.lit(window_regex(p, SPAN_HALF)))))
            for p in patterns
        ]
    )


def element_hits(held: Column, pack: RulePack, spans: bool = False) -> Column:
    """Rules that fire on one ``searchable`` element, in rule order, each with its first matching pattern.

    With ``spans`` each hit quotes its surroundings; the patterns are literals here, so they
    are compiled once.
    """
    fired = [matches_any(held, r.patterns) for r in pack.rules]
    slots = []
    for rule, fires in zip(pack.rules, fired):
        for winner in pack.winners_over(rule.capability):
            fires = fires & ~fired[pack.rules.index(winner)]
        each = F.array(*[matches(held, p) for p in rule.patterns])
        span = _span(held, rule.patterns) if spans else F.lit(None).cast("string")
        slots.append(
            F.when(
                fires,
                F.struct(
                    (F.array_position(each, True).cast("int") - 1).alias("pat_ord"), span.alias("span")
                ),
            )
        )
    hits = F.transform(
        F.array(*slots),
        lambda h, rule: F.struct(rule.alias("rule_ord"), h["pat_ord"].alias("pat_ord"), h["span"].alias("span")),
    )
    return F.filter(hits, lambda h: h["pat_ord"].isNotNull())


def _searchable(elements: Column) -> Column:
    return F.transform(elements, lambda e: F.struct(e.alias("e"), searchable(e["text"]).alias("held")))


def _text_claims(marked: Column, pack: RulePack, spans: bool) -> Column:
    names = terms(pack)

    def claim(e: Column, h: Column) -> Column:
        kind, term = _by_field(e["source_field"], CLAIM_TYPE), F.get(names, h["rule_ord"])
        return F.struct(
            e["field_ord"].alias("field_ord"),
            e["elem_ord"].alias("elem_ord"),
            h["rule_ord"].alias("rule_ord"),
            h["pat_ord"].alias("pat_ord"),
            term.alias("claim_value"),
            short_sha1(F.col("facility_id"), kind, term, e["text"]).alias("claim_id"),
            kind.alias("claim_type"),
            e["source_field"].alias("source_field"),
            e["text"].alias("element"),
            h["span"].alias("span"),
            _by_field(e["source_field"], CONFIDENCE).alias("extraction_confidence"),
        )

    return F.flatten(
        F.transform(
            _searchable(marked),
            lambda x: F.transform(element_hits(x["held"], pack, spans), lambda h: claim(x["e"], h)),
        )
    ).cast(_CLAIMS)


def _code_claims(pack: RulePack) -> Column:
    owner: dict[str, int] = {}
    for i, rule in enumerate(pack.rules):
        for code in rule.codes:
            owner.setdefault(code, i)
    if not owner:
        return F.array().cast(_CLAIMS)
    lookup = F.create_map(*[F.lit(x) for kv in owner.items() for x in kv])
    names = terms(pack)
    coded = F.transform(
        non_empty(field_elements("specialties", CLAIM_FIELDS.index("specialties"))),
        lambda e: F.struct(e.alias("e"), lookup[strip(e["text"])].alias("rule_ord")),
    )

    def claim(x: Column) -> Column:
        e, term = x["e"], F.get(names, x["rule_ord"])
        return F.struct(
            e["field_ord"].alias("field_ord"),
            e["elem_ord"].alias("elem_ord"),
            x["rule_ord"].alias("rule_ord"),
            F.lit(None).cast("int").alias("pat_ord"),
            term.alias("claim_value"),
            short_sha1(F.col("facility_id"), F.lit("specialty"), term, e["text"]).alias("claim_id"),
            F.lit("specialty").alias("claim_type"),
            e["source_field"].alias("source_field"),
            e["text"].alias("element"),
            e["text"].alias("span"),
            F.lit(CONFIDENCE["specialties"]).alias("extraction_confidence"),
        )

    return F.transform(F.filter(coded, lambda x: x["rule_ord"].isNotNull()), claim).cast(_CLAIMS)


def with_claims(entities: DataFrame, pack: RulePack, spans: bool = False) -> DataFrame:
    """Add ``marked`` (elements that hit any pattern) and ``claims`` to each entity row.

    Both stay inside the row: the entity's text is read once and never shuffled. Quotes are
    cut only with ``spans``.
    """
    texts = F.concat(*[field_elements(f, CLAIM_FIELDS.index(f)) for f in TEXT_FIELDS])
    hit = F.filter(_searchable(texts), lambda x: matches_any(x["held"], pack.patterns))
    marked = F.transform(hit, lambda x: x["e"])
    return entities.withColumn("marked", marked).withColumn(
        "claims", F.array_sort(F.concat(_text_claims(F.col("marked"), pack, spans), _code_claims(pack)))
    )


def claim_rows(claims: DataFrame, quote_length: int | None = QUOTE_LENGTH) -> DataFrame:
    """Rows (facility_id, c) of found claims to the columns of the claim table, repeats included."""
    c = F.col("c")
    is_code = c["source_field"] == "specialties"
    return claims.select(
        "facility_id", c["claim_id"].alias("claim_id"), c["claim_type"].alias("claim_type"),
        c["claim_value"].alias("claim_value"),
        F.when(is_code, c["element"]).otherwise(cut(c["element"], quote_length)).alias("claim_raw"),
        c["source_field"].alias("source_field"), c["span"].alias("source_text_span"),
        c["extraction_confidence"].alias("extraction_confidence"),
        F.lit("rules").alias("extraction_method"), F.lit(RULES_MODEL).alias("llm_model"),
        emission_order(c["field_ord"], c["elem_ord"], c["rule_ord"]).alias("claim_ord"),
    )


def claim_table(
    with_claims_: DataFrame, quote_length: int | None = QUOTE_LENGTH
) -> DataFrame:
    """Claims as rows, first emitted row per claim id; ``with_claims_`` holds claims with spans."""
    rows = with_claims_.select("facility_id", F.explode_outer("claims").alias("c"))
    return keep_first_claim(claim_rows(rows.filter(F.col("c").isNotNull()), quote_length))


def keep_first_claim(rows: DataFrame) -> DataFrame:
    """The claim table from claim rows: one row per id, at its first place.

    An id is made of the entity, the type, the term and the whole element, and these fix all
    other columns but the place. So the fold is a hash aggregate with a minimum of one long;
    it folds before the shuffle however often an entity is repeated, and sorts no text.
    """
    return rows.groupBy(*[c for c in rows.columns if c != "claim_ord"]).agg(
        F.min("claim_ord").alias("claim_ord")
    )


def classify(
    entities: DataFrame, pack: RulePack, quote_length: int | None = QUOTE_LENGTH
) -> DataFrame:
    """Entities to the claim table."""
    return claim_table(with_claims(entities, pack, spans=True), quote_length)


def classify_codes(entities: DataFrame, codes: DataFrame) -> DataFrame:
    """Code claims against a code table of any size (code, capability, rule_ord).

    The join key is the stripped code; the claim id keeps the raw one. A table counted to hold
    at most ``BROADCAST_CODES`` rows is broadcast, so a code in a third of all rows stays where it is.
    """
    if codes.limit(BROADCAST_CODES + 1).count() <= BROADCAST_CODES:
        codes = F.broadcast(codes)
    coded = (
        entities.select(
            "facility_id", F.posexplode_outer("specialties").alias("elem_ord", "claim_raw")
        )
        .filter(F.col("claim_raw").isNotNull() & (F.col("claim_raw") != ""))
        .withColumn("code", strip(F.col("claim_raw")))
        .join(codes, "code")
    )
    claim_id = short_sha1(
        F.col("facility_id"), F.lit("specialty"), F.col("capability"), F.col("claim_raw")
    )
    return (
        coded.select(
            "facility_id", claim_id.alias("claim_id"),
            F.lit("specialty").alias("claim_type"),
            F.col("capability").alias("claim_value"),
            "claim_raw",
            F.lit("specialties").alias("source_field"),
            F.col("claim_raw").alias("source_text_span"),
            F.lit(CONFIDENCE["specialties"]).alias("extraction_confidence"),
        )
        # The id fixes all other columns, so this keeps one row per id.
        .distinct()
    )


def primary_claims(claims: DataFrame) -> DataFrame:
    """One claim id per (entity, term): highest confidence, then first emitted."""
    best = F.min(
        F.struct((-F.col("extraction_confidence")).alias("neg"), "claim_ord", "claim_id")
    )
    return (
        claims.groupBy("facility_id", F.col("claim_value").alias("capability"))
        .agg(best.alias("b"))
        .select(
            "facility_id", "capability",
            F.col("b.claim_id").alias("claim_id"),
            (-F.col("b.neg")).alias("extraction_confidence"),
        )
    )
