"""Every operator as a named query over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cleaning as clean
from ..functions.scoring import status_label, trust_score
from ..operators import (
    actions, aliases, claims, corroboration, domains, elements, entity, evaluation, evidence, facts, gaps, indicators, inference,
    needles, polygons, quality, reference, review, searches, serving, similar, snapshots, trust,
)
from ..packs import CARE_PACK, NOTICE_INDICATORS, NOTICE_PACK, REVISED_NOTICE_PACK
from ..sources import tables as src
from ..streaming import verdicts
from . import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query, name: str | None = None) -> Query:
    QUERIES[name or f.__name__] = f
    return f


def named(name: str) -> Callable[[Query], Query]:
    return lambda f: query(f, name)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return b.document_entities(spark, d)


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return claims.classify(_docs(spark, d), NOTICE_PACK)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.find_evidence(_docs(spark, d), NOTICE_PACK)


def _trust(spark: SparkSession, d: str) -> DataFrame:
    return trust.gold_trust(_docs(spark, d), NOTICE_PACK)


def _pincodes(spark: SparkSession, d: str) -> DataFrame:
    return reference.build_pincode(b.postcode_source(spark, d))


def _facilities(spark: SparkSession, d: str) -> DataFrame:
    return entity.build_facility(
        b.facility_source(spark, d), _pincodes(spark, d), b.canonical_states(spark, d)
    )


def _districts(spark: SparkSession, d: str) -> DataFrame:
    return reference.build_district_health(b.district_source(spark, d))


def _r6(c: str):
    return F.round(c, 6).alias(c)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    """Scores to six digits, so that sums taken in another order compare equal."""
    return df.select(*[_r6(c) if c in names else F.col(c) for c in df.columns])


# --- sources ----------------------------------------------------------------

_ALL_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


@query
def describe_sources(spark, d):
    tables = {t: b.table(spark, d, t) for t in _ALL_TABLES}
    listed = src.describe_sources(spark, tables).drop("data_type")
    return src.profile_sources(tables).join(listed, ["table_name", "column_name"])


@query
def sample_rows(spark, d):
    return src.sample_rows(b.table(spark, d, "customer"), "c_custkey", 3)


@query
def parameterised_sql(spark, d):
    return src.query(
        spark,
        "SELECT source, count(*) AS documents, sum(n_chars) AS chars FROM {docs} "
        "WHERE lang = :lang AND n_chars >= :least GROUP BY source",
        {"lang": "en", "least": 100},
        docs=b.table(spark, d, "documents"),
    )


@query
def bronze_copy(spark, d):
    return src.bronze_copy(spark, b.table(spark, d, "customer"), f"bronze_customer_{uuid.uuid4().hex}")


# --- cleaning ---------------------------------------------------------------


@query
def clean_category(spark, d):
    s = b.facility_source(spark, d)
    return s.select(
        "unique_id",
        clean.clean_category(F.col("organization_type")).alias("organization_type"),
        clean.clean_category(F.col("facilityTypeId")).alias("facility_type"),
        F.trim("name").alias("name"),
    )


@query
def normalize_name(spark, d):
    s = b.facility_source(spark, d)
    return s.select(
        "unique_id",
        clean.normalize_name(F.col("address_stateOrRegion")).alias("state_raw"),
        clean.normalize_name(F.col("address_city")).alias("city"),
        clean.title(F.col("address_city")).alias("city_uncollapsed"),
    )


@query
def parse_json_array(spark, d):
    s = b.facility_source(spark, d)
    cols = ("specialties", "procedure", "equipment", "capability", "source_urls")
    sorted_text = lambda c: F.concat_ws("|", F.sort_array(clean.parse_json_array(F.col(c))))
    return s.select(
        "unique_id",
        *[sorted_text(c).alias(c) for c in cols],
        *[F.size(clean.parse_json_array(F.col(c))).alias(f"{c}_size") for c in cols],
    )


@query
def safe_cast(spark, d):
    s = b.facility_source(spark, d)
    return s.select(
        "unique_id",
        *[clean.safe_int(F.col(c)).alias(c) for c in ("capacity", "yearEstablished", "numberDoctors")],
    )


@query
def sentinel_cast(spark, d):
    s = b.postcode_source(spark, d)
    return s.select(
        "officename",
        clean.sentinel_double(F.col("latitude")).alias("latitude"),
        clean.sentinel_double(F.col("longitude")).alias("longitude"),
    )


@query
def bbox_flag(spark, d):
    s = b.facility_source(spark, d)
    return s.select(
        "unique_id", clean.in_bbox(F.col("latitude"), F.col("longitude")).alias("has_valid_coords")
    )


@query
def text_bool(spark, d):
    s = b.facility_source(spark, d)
    return s.select(
        "unique_id",
        clean.text_bool(F.col("affiliated_staff_presence")).alias("has_affiliated_staff"),
        clean.text_bool(F.col("custom_logo_presence")).alias("has_custom_logo"),
    )


@query
def display_name(spark, d):
    return b.table(spark, d, "conversations").select(
        "conv_id", "turn", clean.display_name(F.col("text")).alias("display_name")
    )


@query
def top_urls(spark, d):
    p = b.table(spark, d, "pages").select(
        "page_id",
        F.transform(
            F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)), lambda u: F.lower(u)
        ).alias("urls"),
    )
    return p.select("page_id", F.concat_ws(" ", clean.top_urls(F.col("urls"))).alias("top_urls"))


@query
def silver_facility(spark, d):
    f = _facilities(spark, d)
    arrays = ("specialties", "procedures", "equipment", "capabilities", "source_urls")
    return f.select(
        *[
            F.concat_ws("|", F.sort_array(c)).alias(c) if c in arrays else F.col(c)
            for c in entity.SILVER_COLUMNS
        ]
    )


@query
def dedupe_by_priority(spark, d):
    return _pincodes(spark, d)


@query
def resolve_with_provenance(spark, d):
    return _facilities(spark, d).select(
        "facility_id", "pincode", "state_raw", "district_raw", "state", "district", "state_source"
    )


@query
def attach_district(spark, d):
    return reference.attach_district(_facilities(spark, d), _pincodes(spark, d))


@query
def district_health(spark, d):
    return _districts(spark, d)


# --- claims, evidence, trust -------------------------------------------------


@query
def explode_elements(spark, d):
    return elements.explode_elements(_docs(spark, d))


@query
def classify_claims(spark, d):
    return _claims(spark, d)


@query
def classify_codes(spark, d):
    return claims.classify_codes(_docs(spark, d), NOTICE_PACK.code_rows(spark))


@query
def primary_claim(spark, d):
    return claims.primary_claims(_claims(spark, d))


@named("evidence")
def evidence_query(spark, d):
    return _evidence(spark, d)


@query
def gold_trust(spark, d):
    return _rounded(_trust(spark, d), "trust_score")


@query
def gold_trust_tables(spark, d):
    found = facts.write_facts(_docs(spark, d), NOTICE_PACK)
    c = src.materialise(facts.claims_of(found), "claims")
    e = src.materialise(facts.evidence_of(found), "evidence")
    return _rounded(trust.trust_from_tables(c, e), "trust_score")


@query
def gold_trust_care(spark, d):
    return _rounded(trust.gold_trust(_docs(spark, d), CARE_PACK), "trust_score")


def _score_inputs(spark, d):
    return b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_quantity").cast("long") % 7).alias("claims"),
        F.col("l_linenumber").cast("long").alias("supports"),
        F.round(F.col("l_tax") * 50).cast("long").alias("contradicts"),
        F.round(1.0 - F.col("l_discount") * 3, 2).alias("confidence"),
    )


@named("trust_score")
def trust_score_query(spark, d):
    s = _score_inputs(spark, d)
    score = trust_score(F.col("claims"), F.col("supports"), F.col("contradicts"), F.col("confidence"))
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(score, 6).alias("trust_score"))


@named("status_label")
def status_label_query(spark, d):
    s = _score_inputs(spark, d)
    label = status_label(F.col("confidence"), F.col("supports"), F.col("contradicts"))
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", label.alias("status"))


@query
def needle_evidence(spark, d):
    worded = F.transform(
        "claims", lambda c: F.struct(c["claim_value"].alias("claim_value"), c["element"].alias("claim_raw"))
    )
    claimed = claims.with_claims(_docs(spark, d), NOTICE_PACK).select(
        "facility_id", worded.alias("claims"), needles.entity_texts().alias("texts")
    )
    return needles.needle_evidence(claimed)


@named("indicators")
def indicators_query(spark, d):
    return indicators.indicators(_docs(spark, d), NOTICE_INDICATORS)


def _status_text(statuses):
    return F.concat_ws(
        ",", F.sort_array(F.transform(F.map_entries(statuses), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    )


@query
def indicator_map(spark, d):
    statuses = indicators.indicator_status_map(NOTICE_INDICATORS)
    return _docs(spark, d).select("facility_id", _status_text(statuses).alias("statuses"))


@query
def indicator_filter(spark, d):
    return _reachable(spark, d).select("facility_id", "name", "state", "city")


@query
def prompt_column(spark, d):
    c = b.table(spark, d, "conversations")
    return c.select(
        "conv_id", "turn",
        inference.classify_prompt(F.col("role"), F.col("text"), NOTICE_PACK).alias("classify_prompt"),
        F.sha1(
            inference.extract_prompt(
                F.col("role"), F.col("text"), F.col("role"), F.lit(None).cast("string"), F.col("role"),
                NOTICE_PACK,
            )
        ).alias("extract_prompt_sha1"),
    )


@query
def unmatched_elements(spark, d):
    return inference.unmatched_elements(_docs(spark, d), NOTICE_PACK)


def _answers(spark, d):
    """Model answers in many shapes, spelled out of event rows."""
    e = b.table(spark, d, "events")
    body = F.concat(
        F.lit('{"claim_value": "'), F.upper("event_type"), F.lit(' ", "confidence": '),
        (F.col("value") / 64.0).cast("string"), F.lit("}"),
    )
    shape = F.col("event_id") % 9
    given = lambda text: F.regexp_replace(body, "[^ ]*}$", text + "}")
    return e.select(
        "event_id",
        F.when(shape == 1, F.concat(F.lit("Sure: "), body, F.lit(" as asked")))
        .when(shape == 2, F.lit("[1]"))
        .when(shape == 3, given('"high"'))
        .when(shape == 4, F.replace(body, F.lit('"'), F.lit("'")))
        .when(shape == 5, F.concat(F.lit('{"claim_value": "spa", "confidence": 0.125, '), F.substring(body, 2, 200)))
        .when(shape == 6, given('"0.6f"'))
        .when(shape == 7, F.concat(body, F.lit(" and } more")))
        .when(shape == 8, given(' "0.25"'))
        .otherwise(body).alias("response"),
    )


def _asked(spark, d):
    return inference.with_prompt_key(
        inference.unmatched_elements(_docs(spark, d), NOTICE_PACK), NOTICE_PACK
    ).drop("prompt")


def _model_claims(spark, d):
    asked = src.materialise(_asked(spark, d), "asked")
    return inference.model_claims(asked, b.model_answers(asked), NOTICE_PACK, "stub")


@query
def model_claims(spark, d):
    return _model_claims(spark, d)


@query
def model_trust(spark, d):
    """Rule and model claims, the evidence for both, and trust from the written tables."""
    c = src.materialise(_claims(spark, d).unionByName(_model_claims(spark, d)), "claims")
    e = src.materialise(evidence.find_evidence_for(_docs(spark, d), c, NOTICE_PACK), "evidence")
    return _rounded(trust.trust_from_tables(c, e), "trust_score")


@query
def parse_response(spark, d):
    parsed = inference.parse_response(F.col("response"), ("click", "view", "signup"))
    return (
        _answers(spark, d).withColumn("a", parsed)
        .select("event_id", "a.claim_value", "a.confidence")
    )


# --- serving ----------------------------------------------------------------


@query
def triage(spark, d):
    rows = serving.triage(_trust(spark, d), _docs(spark, d), "common", "e", 0.3, 200)
    return _rounded(rows.drop("source_urls", "capabilities", "procedures", "equipment"), "trust_score")


@query
def triage_counts(spark, d):
    return serving.triage_counts(_trust(spark, d), _docs(spark, d), "common", "e", 0.3)


@query
def browse(spark, d):
    rows = serving.browse(_trust(spark, d), _docs(spark, d), "src1", 200)
    return _rounded(
        rows.withColumn("verified_capabilities", F.concat_ws(",", "verified_capabilities"))
        .withColumn("source_urls", F.concat_ws(",", "source_urls")),
        "trust_score",
    )


@query
def browse_counts(spark, d):
    return serving.browse_counts(_trust(spark, d), _docs(spark, d), "src1")


def _reachable(spark, d):
    """One filtered relation for both the list and its counts."""
    return indicators.filter_by_indicators(
        _docs(spark, d), NOTICE_INDICATORS, required=("english",), hide_caveats=True
    )


@query
def triage_filtered(spark, d):
    rows = serving.triage(
        _trust(spark, d), _reachable(spark, d), "common", limit=50, wide=_docs(spark, d)
    )
    return _rounded(rows.select("facility_id", "name", "trust_score", "status"), "trust_score")


@query
def browse_counts_filtered(spark, d):
    return serving.browse_counts(_trust(spark, d), _reachable(spark, d))


@query
def prefix_search(spark, d):
    f = _docs(spark, d)
    return serving.in_place(f, " SRC1").select("facility_id", "name", "state", "city")


@query
def substring_search(spark, d):
    return b.table(spark, d, "documents").filter(
        clean.substring_match("Apache License", F.col("text"))
    ).select("doc_id", "lang", "source")


@query
def entity_detail(spark, d):
    return serving.entity_detail(_docs(spark, d), "125").drop(
        "capabilities", "procedures", "equipment", "specialties", "source_urls"
    )


@query
def claims_with_evidence(spark, d):
    rows = serving.claims_with_evidence(_claims(spark, d), _trust(spark, d))
    return _rounded(rows, "trust_score")


@query
def claims_of_entity(spark, d):
    rows = serving.claims_with_evidence(_claims(spark, d), _trust(spark, d), "125")
    return _rounded(rows, "trust_score")


@query
def claim_groups(spark, d):
    rows = serving.claim_groups(serving.claims_with_evidence(_claims(spark, d), _trust(spark, d)))
    listed = F.transform("claimed_in", lambda p: F.concat_ws(": ", p["source_field"], p["claim_raw"]))
    return _rounded(rows.withColumn("claimed_in", F.array_join(listed, " | ")), "trust_score")


@query
def entity_evidence(spark, d):
    return serving.entity_evidence(_evidence(spark, d), _claims(spark, d))


@query
def evidence_of_entity(spark, d):
    return serving.entity_evidence(_evidence(spark, d), _claims(spark, d), "125")


@query
def evidence_for_capability(spark, d):
    return serving.evidence_for_capability(_evidence(spark, d), _claims(spark, d), "contact")


@query
def district_context(spark, d):
    return serving.district_context(_districts(spark, d), "Nation 3", limit=50)


@query
def lowest_k(spark, d):
    rows = _districts(spark, d)
    return serving.lowest_k(rows, serving.DISTRICT_INDICATORS[0], 5, "district", "state").select(
        "district", "state", serving.DISTRICT_INDICATORS[0]
    )


@query
def status_examples(spark, d):
    rows = serving.status_examples(_trust(spark, d), _docs(spark, d), "common", "contradicted", 20)
    return _rounded(rows, "trust_score")


@query
def map_points(spark, d):
    return serving.map_points(_docs(spark, d))


@query
def map_summary(spark, d):
    return serving.map_summary(_docs(spark, d))


# --- quality ----------------------------------------------------------------


@query
def dq_overview(spark, d):
    return quality.overview(_facilities(spark, d))


@query
def dq_state_source(spark, d):
    return quality.state_sources(_facilities(spark, d))


@query
def dq_status_by_capability(spark, d):
    return quality.status_by_capability(_trust(spark, d))


@query
def claims_by_capability(spark, d):
    return quality.claims_by_capability(_claims(spark, d))


@query
def status_pivot(spark, d):
    return quality.status_pivot(_trust(spark, d))


@query
def correction_examples(spark, d):
    return quality.correction_examples(_facilities(spark, d), 15)


# --- evaluation -------------------------------------------------------------


def _predictions(spark, d):
    labels = b.scenario_labels(spark, d)
    scored = trust.gold_trust(evaluation.labelled(_docs(spark, d), labels), NOTICE_PACK)
    return evaluation.predictions(labels, scored)


@query
def eval_predictions(spark, d):
    return _predictions(spark, d)


@query
def eval_metrics(spark, d):
    return evaluation.metrics(_predictions(spark, d))


@query
def confusion_matrix(spark, d):
    return evaluation.confusion_matrix(_predictions(spark, d))


@query
def eval_misses(spark, d):
    return evaluation.misses(_predictions(spark, d))


@query
def label_lines(spark, d):
    """Expectations written as JSON lines and read back in splits."""
    path = src.fresh_path(spark, "label-lines")
    b.scenario_labels(spark, d).write.json(path)
    return src.read_label_lines(spark, path).select("facility_id", "claim_value", "expected_status", "rationale")


# --- reviewer state -----------------------------------------------------------


@query
def verifications_latest(spark, d):
    return actions.latest_verdicts(b.verdict_log(spark, d))


@query
def verifications_stream(spark, d):
    return verdicts.latest_from_stream(b.verdict_stream(spark, d))


@query
def verdict_stream_log(spark, d):
    """The verdict log and its rejects as one stream has written them."""
    path, checkpoint = (src.fresh_path(spark, n) for n in ("judged-log", "judged-checkpoint"))
    stream = b.verdict_stream(spark, d)
    verdicts.append_judged(stream, path, checkpoint).awaitTermination()
    judged = verdicts.judged_log(spark, path, stream)
    return judged.drop("refused").withColumn("broken", F.array_join("broken", ","))


@query
def verifications_state(spark, d):
    """Latest verdicts as streaming state has kept them."""
    path, checkpoint = (src.fresh_path(spark, n) for n in ("verdict-state", "state-checkpoint"))
    verdicts.keep_latest(b.verdict_stream(spark, d), path, checkpoint).awaitTermination()
    return verdicts.kept_latest(spark, path)


@query
def annotations_log(spark, d):
    return actions.valid_notes(b.note_log(spark, d))


@query
def planner_history(spark, d):
    return actions.planner_work(
        actions.latest_verdicts(b.verdict_log(spark, d)), actions.valid_notes(b.note_log(spark, d)), "planner 7"
    )


def _recorded(spark, rows, record):
    """The log and the reject table that an append leaves, side by side."""
    log = src.scratch_table(spark, rows, "log")
    refused = rows.withColumn("broken", F.array(F.lit(""))).withColumn("rejected_at", F.current_timestamp())
    rejects = src.scratch_table(spark, refused, "rejects")
    record(rows, log, rejects)
    kept = spark.table(log).withColumn("broken", F.lit(""))
    lost = spark.table(rejects).drop("rejected_at")
    return kept.unionByName(lost.withColumn("broken", F.array_join("broken", ",")))


@query
def recorded_verdicts(spark, d):
    return _recorded(spark, b.verdict_log(spark, d), actions.record_verdicts)


@query
def recorded_notes(spark, d):
    return _recorded(spark, b.note_log(spark, d), actions.add_notes)


@query
def validate_actions(spark, d):
    return actions.validate_actions(b.verdict_log(spark, d))


# --- similar claims, districts by polygon, state aliases ------------------------


@query
def similar_claims(spark, d):
    """The probed neighbours; how many of the exact ones they are is ``similar_claims_recall``."""
    return similar.similar_claims(b.table(spark, d, "embeddings"))


@query
def similar_claims_exact(spark, d):
    return similar.similar_claims(b.table(spark, d, "embeddings"), exact=True)


@query
def similar_claims_recall(spark, d):
    return similar.recall_report(b.table(spark, d, "embeddings"))


@query
def polygon_districts(spark, d):
    """Every district that holds a facility; planning runs the jobs that cover the districts with cells."""
    return polygons.point_districts(b.vector_points(spark, d), b.district_polygons(spark, d), "vec_id")


@query
def polygon_attach(spark, d):
    return polygons.attach_polygon_district(
        b.facility_source(spark, d), b.district_polygons(spark, d), point_id="unique_id"
    )


@query
def alias_resolution(spark, d):
    return aliases.resolve_aliases(b.misspelt_states(spark, d), b.state_aliases(spark, d))


# --- snapshots ------------------------------------------------------------------

# When the test snapshots are taken; a rejected verdict is no row of them.
SNAPSHOT_TIMES = ("2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00")


def _verdict_snapshot(spark, d, at):
    log = b.verdict_log(spark, d).filter(F.col("created_at") <= F.lit(at).cast("timestamp_ntz"))
    return actions.latest_verdicts(log).filter("status != 'rejected'")


def _snapshot_log(spark, d):
    """Three snapshots, the second loaded twice, in a table of their changes."""
    key, values = actions.VERDICT_KEY, ("status", "reason")
    table = f"verdict_changes_{uuid.uuid4().hex}"
    for at in (*SNAPSHOT_TIMES[:2], *SNAPSHOT_TIMES[1:]):
        snapshots.load_snapshot(spark, table, _verdict_snapshot(spark, d, at), at, key, values)
    return spark.table(table), key, values


@query
def snapshot_intervals(spark, d):
    """When each version of a verdict held, over three loaded snapshots; planning loads them."""
    rows = snapshots.intervals(*_snapshot_log(spark, d))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("valid_from", "valid_to")})


@query
def snapshot_as_of(spark, d):
    """The second of three loaded snapshots, read back as of a day later."""
    log, key, values = _snapshot_log(spark, d)
    return snapshots.as_of(log, F.lit("2024-01-16 00:00:00").cast("timestamp"), key, values)


@query
def trust_flips(spark, d):
    """Alerts between the trust under one rule pack and under its revision."""
    before, after = (trust.gold_trust(_docs(spark, d), pack) for pack in (NOTICE_PACK, REVISED_NOTICE_PACK))
    return _rounded(snapshots.flips(before, after), "old_score", "new_score")


# --- the review queue ----------------------------------------------------------------


@query
def review_queue(spark, d):
    """The leases of two rounds over the pairs without a verdict, the least trusted first; planning runs the rounds."""
    decided = actions.latest_verdicts(b.verdict_log(spark, d)).filter("status <> 'needs_info'")
    waiting = review.open_claims(_rounded(_trust(spark, d), "trust_score"), decided, ["facility_id"])
    return review.lease_rounds(waiting, b.reviewers(spark, d), list(b.LEASE_TIMES))


# --- saved searches, source quality -----------------------------------------------


def _searchable(spark, d):
    statuses = indicators.indicator_status_map(NOTICE_INDICATORS)
    available = F.map_keys(F.map_filter(statuses, lambda _, s: s == "available"))
    return searches.searchable(_trust(spark, d), _docs(spark, d), available)


@query
def saved_search_matches(spark, d):
    """Every scored pair with every saved search that it satisfies; planning writes the scored pairs."""
    return _rounded(searches.match_searches(b.saved_searches(spark, d), _searchable(spark, d)), "trust_score")


@query
def shortlist_status(spark, d):
    """Documents of one language and source as a shortlist, with their trust."""
    lists = _docs(spark, d).groupBy(F.col("pincode").alias("shortlist_id"))
    return searches.shortlist_status(lists.agg(F.collect_list("facility_id").alias("facility_ids")), _trust(spark, d))


@query
def source_quality(spark, d):
    """Registered domains of all pages by their rank in the graph of menu links; planning runs the rounds."""
    return domains.source_quality(b.table(spark, d, "pages"), b.cross_links(spark, d), b.host_suffixes(spark, d))


@query
def page_quality(spark, d):
    """Every page with the rank of its registered domain."""
    pages, suffixes = b.table(spark, d, "pages"), b.host_suffixes(spark, d)
    ranked = domains.source_quality(pages, b.cross_links(spark, d), suffixes)
    return domains.page_quality(pages.select("page_id", "url"), ranked, suffixes)


# --- figures, gaps, what fields say together ---------------------------------------


def _published(spark, d):
    return reference.typed_indicators(b.published_figures(spark, d), ["short_pct", "long_pct"])


@query
def typed_indicators(spark, d):
    """Published figures as numbers, with a flag for few cases."""
    return _published(spark, d)


@query
def district_gaps(spark, d):
    """Verified coverage against a published burden, for every place and capability."""
    facilities = _docs(spark, d).select("facility_id", "state", F.col("pincode").alias("district"))
    burdens = _published(spark, d).select("state", "district", F.col("short_pct").alias("burden"))
    terms = [r.capability for r in NOTICE_PACK.rules]
    return gaps.district_gaps(_rounded(_trust(spark, d), "trust_score"), facilities, burdens, terms)


@query
def quantities(spark, d):
    return _rounded(corroboration.quantities(b.stated_quantities(spark, d)), "low", "high")


@query
def quantity_agreement(spark, d):
    """Where the fields of a facility agree about its size, and the two quotes that set the bounds."""
    return _rounded(corroboration.quantity_agreement(corroboration.quantities(b.stated_quantities(spark, d))), "low", "high")


@query
def corroborated_claims(spark, d):
    """How many fields claim each pair, and whether the prose supports it."""
    return corroboration.corroboration(_claims(spark, d), _evidence(spark, d))
