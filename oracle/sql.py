"""One SQL statement per registered query."""

from __future__ import annotations

from attesta.operators.corroboration import UNITS, quantity_pattern
from attesta.operators.entity import SILVER_COLUMNS
from attesta.operators.inference import CLASSIFY_PROMPT, EXTRACT_PROMPT
from attesta.operators.serving import DISTRICT_INDICATORS
from attesta.packs import (
    CARE_PACK, NAME_ACRONYMS, NAME_SMALL_WORDS, NEEDLE_CUES, NOTICE_INDICATORS, NOTICE_PACK,
    REVISED_NOTICE_PACK,
)

from attesta.plans.bindings import HOLE, LEASE_TIMES, STAR
from attesta.plans.catalogue import SNAPSHOT_TIMES

from . import fragments as f
from .fragments import ctes, q

ORACLE_SQL: dict[str, str] = {}

STATUSES = ("verified", "unclear", "contradicted")
PREDICTED = ("verified", "unclear", "contradicted", "absent")

S, C = "supporting_evidence_count", "contradicting_evidence_count"
CLAIM = f.claim(NOTICE_PACK)
EVIDENCE = f.evidence(NOTICE_PACK)
TRUST = f.trust(NOTICE_PACK)
RANK = "CASE status WHEN 'verified' THEN 0 WHEN 'unclear' THEN 1 ELSE 2 END"
TRUST_COLUMNS = f"facility_id, capability, claim_count, {S}, {C}, round(trust_score, 6) AS trust_score, status"


def add(name: str, sql: str) -> None:
    ORACLE_SQL[name] = sql


# --- sources ----------------------------------------------------------------

_TYPES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

add("describe_sources", "\nUNION ALL ".join(
    f"SELECT {q(t)} AS table_name, count(*) AS row_count, {q(c.split()[0])} AS column_name, "
    f"{q(c.split()[1])} AS data_type, count({c.split()[0]}) AS filled_count, {i} AS ordinal, true AS nullable FROM {t}"
    for t, cols in _TYPES.items() for i, c in enumerate(cols.split(", "))
))
add("sample_rows", "SELECT * FROM customer ORDER BY c_custkey LIMIT 3")
add("parameterised_sql", """
SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents
WHERE lang = 'en' AND n_chars >= 100 GROUP BY source""")
add("bronze_copy", "SELECT * FROM customer")

# --- cleaning ---------------------------------------------------------------

add("clean_category", ctes(f.SOURCE) + """
SELECT unique_id, lower(nullif(trim(organization_type), '')) AS organization_type,
  lower(nullif(trim(facilityTypeId), '')) AS facility_type, trim(name) AS name FROM facility_source""")
add("normalize_name", ctes(f.SOURCE) + f"""
SELECT unique_id, {f.normalized('address_stateOrRegion')} AS state_raw,
  {f.normalized('address_city')} AS city, {f.initcap('trim(address_city)')} AS city_uncollapsed
FROM facility_source""")
_JSON = ("specialties", "procedure", "equipment", "capability", "source_urls")
add("parse_json_array", ctes(f.SOURCE) + "SELECT unique_id, " + ", ".join(
    f"coalesce(array_to_string(list_sort({f.json_list(c)}), '|'), '') AS {c}, "
    f"CAST(len({f.json_list(c)}) AS INTEGER) AS {c}_size" for c in _JSON) + " FROM facility_source")
add("safe_cast", ctes(f.SOURCE) + "SELECT unique_id, " + ", ".join(
    f"{f.try_int(c)} AS {c}" for c in ("capacity", "yearEstablished", "numberDoctors")) + " FROM facility_source")
add("sentinel_cast", ctes(f.POSTCODE) + """
SELECT officename, TRY_CAST(nullif(latitude, 'NA') AS DOUBLE) AS latitude,
  TRY_CAST(nullif(longitude, 'NA') AS DOUBLE) AS longitude FROM postcode_source""")
add("bbox_flag", ctes(f.SOURCE) + """
SELECT unique_id, latitude BETWEEN 6 AND 37 AND longitude BETWEEN 68 AND 98 AS has_valid_coords
FROM facility_source""")
add("text_bool", ctes(f.SOURCE) + """
SELECT unique_id, lower(staff) = 'true' AS has_affiliated_staff, lower(logo) = 'true' AS has_custom_logo
FROM facility_source""")

_DIGIT = r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{24EA}]"
_core = "regexp_replace(lower(t), '^[.,():;''\"]+|[.,():;''\"]+$', '', 'g')"
_in = lambda words: ", ".join(q(w) for w in words)
add("display_name", f"""
WITH tokens AS (
  SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '{f.SPACE}+'), lambda t: t <> '') AS ts
  FROM conversations)
SELECT conv_id, turn, coalesce(array_to_string(list_transform(ts, lambda t, i: CASE
    WHEN {_core} IN ({_in(NAME_ACRONYMS)}) THEN upper({_core})
    WHEN i > 1 AND {_core} IN ({_in(NAME_SMALL_WORDS)}) THEN {_core}
    WHEN contains(t, '&') THEN t
    WHEN starts_with(t, '''') OR regexp_matches(t, '{_DIGIT}') THEN t
    ELSE array_to_string(list_transform(string_split(t, '-'),
      lambda p: replace(upper(left(p, 1)), 'ẞ', 'SS') || lower(substring(p, 2))), '-') END), ' '), '') AS display_name
FROM tokens""")
add("top_urls", """
WITH u AS (SELECT page_id, list_transform(regexp_extract_all(html, 'href="([^"]*)"', 1), lambda x: lower(x)) AS urls
           FROM pages),
one AS (SELECT page_id, url, min(i) AS i FROM (
          SELECT page_id, unnest(urls) AS url, unnest(range(1, len(urls) + 1)) AS i FROM u)
        WHERE url <> '' GROUP BY ALL),
ten AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS rn FROM one)
SELECT p.page_id, coalesce(string_agg(ten.url, ' ' ORDER BY rn) FILTER (WHERE rn <= 10), '') AS top_urls
FROM pages p LEFT JOIN ten USING (page_id) GROUP BY p.page_id""")

_ARRAYS = ("specialties", "procedures", "equipment", "capabilities", "source_urls")
add("silver_facility", ctes(f.FACILITY) + "SELECT " + ", ".join(
    f"coalesce(array_to_string(list_sort({c}), '|'), '') AS {c}" if c in _ARRAYS else c
    for c in SILVER_COLUMNS) + " FROM facility")
add("dedupe_by_priority", ctes(f.PINCODE) + "SELECT * FROM pincode")
add("resolve_with_provenance", ctes(f.FACILITY) + """
SELECT facility_id, pincode, state_raw, district_raw, state, district, state_source FROM facility""")
add("attach_district", ctes(f.FACILITY) + """
SELECT f.facility_id, coalesce(f.state, p.statename) AS state_resolved, p.district AS district_resolved,
  'pincode' AS district_source FROM facility f LEFT JOIN pincode p ON f.pincode = p.pincode""")
add("district_health", ctes(f.DISTRICT) + "SELECT * FROM district")

# --- claims, evidence, trust -------------------------------------------------

add("explode_elements", ctes(f.DOC, f.ELEM) + "SELECT * FROM elem")
add("classify_claims", ctes(CLAIM) + "SELECT * FROM claim")
add("classify_codes", ctes(CLAIM) + """
SELECT facility_id, claim_id, claim_type, claim_value, claim_raw, source_field, source_text_span,
  extraction_confidence FROM claim WHERE source_field = 'specialties'""")
add("primary_claim", ctes(CLAIM) + "SELECT * FROM prim")
add("evidence", ctes(EVIDENCE) + "SELECT * FROM evidence")
add("gold_trust", ctes(TRUST) + f"SELECT {TRUST_COLUMNS} FROM trust")
add("gold_trust_tables", ORACLE_SQL["gold_trust"])
add("gold_trust_care", ctes(f.trust(CARE_PACK)) + f"SELECT {TRUST_COLUMNS} FROM trust")

_INPUTS = """
inputs AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) % 7 AS claims, CAST(l_linenumber AS BIGINT) AS s,
    CAST(round(l_tax * 50) AS BIGINT) AS c, round(1.0e0 - l_discount * 3, 2) AS conf FROM lineitem)
"""
add("trust_score", ctes(_INPUTS) + f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({f.score('claims', 's', 'c', 'conf')}, 6) AS trust_score
FROM inputs""")
add("status_label", ctes(_INPUTS) + f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {f.label('conf', 's', 'c')} AS status FROM inputs""")

_before = "substring(lw, greatest(1, idx - 40), least(40, idx - 1))"
_cues = " OR ".join(f"contains({_before}, {q(c)})" for c in NEEDLE_CUES)
add("needle_evidence", ctes(CLAIM) + f""",
field AS (
  SELECT facility_id, 'description' AS source_field, description AS text FROM doc
  UNION ALL SELECT facility_id, ['capabilities', 'procedures', 'equipment'][k + 1],
    (SELECT string_agg(ls[i + 1], chr(10) ORDER BY i) FROM (SELECT unnest(range(k, len(ls), 3)) AS i))
  FROM (SELECT facility_id, string_split(description, chr(10)) AS ls, unnest([0, 1, 2]) AS k FROM doc)
  UNION ALL SELECT facility_id, 'specialties', source || chr(10) || lang FROM doc),
asked AS (
  SELECT e.facility_id, e.cap AS claim_value, e.element AS claim_raw, d.text, d.source_field,
    unnest(list_distinct([lower(e.cap), lower(e.element)])) AS needle
  FROM emitted e JOIN field d ON d.facility_id = e.facility_id),
pieces AS (
  SELECT *, string_split(lower(text), needle) AS pc FROM asked
  WHERE needle <> '' AND contains(lower(text), needle)),
numbered AS (SELECT *, unnest(range(1, len(pc))) AS i FROM pieces),
placed AS (
  SELECT *, CAST(list_sum(list_transform(pc[1:i], lambda x: length(x))) + (i - 1) * length(needle) AS BIGINT) AS st,
    length(needle) AS ln FROM numbered),
cut AS (
  SELECT *, lower(substring(text, greatest(st - 80, 0) + 1,
    least(length(text), st + ln + 80) - greatest(st - 80, 0))) AS lw FROM placed),
found AS (SELECT *, instr(lw, needle) AS idx FROM cut)
SELECT facility_id, claim_value, claim_raw, source_field, CAST(i - 1 AS INTEGER) AS hit_ord,
  {f.window('text', 'st', 'st + ln', 80)} AS snippet,
  CASE WHEN idx = 0 THEN 'neutral' WHEN {_cues} THEN 'contradicts' ELSE 'supports' END AS polarity,
  CASE WHEN needle = lower(claim_raw) THEN 1.0e0 ELSE 0.7e0 END AS retrieval_score FROM found""")

INDICATORS = f.indicators(NOTICE_INDICATORS)
add("indicators", ctes(INDICATORS) + f"""
SELECT facility_id, key, label, kind, status, source_field, left({f.strip('text')}, 200) AS source_quote,
  CAST(rule_ord AS INTEGER) AS indicator_ord FROM best JOIN meta USING (rule_ord)""")
add("indicator_map", ctes(INDICATORS) + """
SELECT d.facility_id, coalesce(string_agg(key || '=' || status, ',' ORDER BY key || '=' || status), '') AS statuses
FROM doc d LEFT JOIN (SELECT * FROM best JOIN meta USING (rule_ord)) b USING (facility_id) GROUP BY d.facility_id""")
_caveats = ", ".join(q(k) for k in NOTICE_INDICATORS.caveat_keys)
add("indicator_filter", ctes(INDICATORS) + f""",
s AS (SELECT facility_id, key, status FROM best JOIN meta USING (rule_ord))
SELECT facility_id, name, state, city FROM doc
WHERE facility_id IN (SELECT facility_id FROM s WHERE key = 'english' AND status = 'available')
  AND facility_id NOT IN (SELECT facility_id FROM s WHERE key IN ({_caveats}) AND status = 'attention')""")


def _prompt(template: str, **values: str) -> str:
    parts, rest = [], template
    for name, value in values.items():
        head, rest = rest.split("{" + name + "}", 1)
        parts += [q(head), value]
    return " || ".join([*parts, q(rest)])


_tax = q(", ".join(NOTICE_PACK.taxonomy))
add("prompt_column", f"""
SELECT conv_id, turn,
  {_prompt(CLASSIFY_PROMPT, taxonomy=_tax, source_field='role', text='left(text, 500)')} AS classify_prompt,
  sha1({_prompt(EXTRACT_PROMPT, taxonomy=_tax, name='role', description='left(text, 4000)',
                capability='role', procedure="''", equipment='role')}) AS extract_prompt_sha1
FROM conversations""")
_none = " AND ".join(f"NOT regexp_matches({f.mask('element')}, {f.rx(p)})" for p in NOTICE_PACK.patterns)
add("unmatched_elements", ctes(f.DOC, f.ELEM) + f"""
SELECT * FROM elem WHERE source_field <> 'specialties' AND {_none}""")
_OBJECT = "json_valid(t) AND starts_with(trim(t), '{')"
_NUMBER = r"^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$".replace("\\\\", "\\")
add("parse_response", f"""
WITH body AS (
  SELECT event_id, event_id % 9 AS shape, '{{"claim_value": "' || upper(event_type) || ' ", "confidence": ' AS head,
    CAST(value / 64.0e0 AS VARCHAR) AS num FROM events),
answer AS (
  SELECT event_id, CASE shape WHEN 1 THEN 'Sure: ' || head || num || '}} as asked' WHEN 2 THEN '[1]'
    WHEN 3 THEN head || '"high"}}' WHEN 4 THEN replace(head || num || '}}', '"', chr(39))
    WHEN 5 THEN '{{"claim_value": "spa", "confidence": 0.125, ' || substring(head || num || '}}', 2)
    WHEN 6 THEN head || '"0.6f"}}' WHEN 7 THEN head || num || '}} and }} more'
    WHEN 8 THEN head || ' "0.25"}}' ELSE head || num || '}}' END AS response
  FROM body),
tried AS (
  SELECT event_id, list_filter(list_concat([response], regexp_extract_all(response, '\\{{[^{{}}]*\\}}')),
    lambda t: {_OBJECT}) AS found
  FROM answer),
named AS (
  SELECT event_id, list_filter(list_transform(found, lambda t: [
      lower(trim(regexp_extract_all(t, '"claim_value"\\s*:\\s*"([^"]*)"', 1)[-1])),
      trim(regexp_extract_all(t, '"confidence"\\s*:\\s*"?([^",}}]*)', 1)[-1])]),
    lambda x: x[1] <> '')[1] AS x
  FROM tried)
SELECT event_id,
  CASE WHEN x IS NULL THEN NULL WHEN x[1] IN ('click', 'view', 'signup') THEN x[1] ELSE 'other' END AS claim_value,
  CASE WHEN x IS NULL THEN NULL ELSE greatest(0.0e0, least(0.75e0, coalesce(
    CASE WHEN regexp_matches(x[2], '{_NUMBER}') THEN TRY_CAST(x[2] AS DOUBLE) END, 0.5e0))) END AS confidence
FROM named""".replace("\\\\", "\\"))

_digit = "CAST(strpos('0123456789abcdef', prompt_key[1]) * 16 + strpos('0123456789abcdef', prompt_key[2]) - 17 AS INTEGER)"
_terms = ", ".join(q(t) for t in NOTICE_PACK.taxonomy)
MODEL = f""",
asked AS (
  SELECT *, sha1({_prompt(CLASSIFY_PROMPT, taxonomy=_tax, source_field='source_field', text='left(element, 500)')})
    AS prompt_key FROM elem WHERE source_field <> 'specialties' AND {_none}),
digits AS (SELECT *, {_digit} AS digit FROM asked),
told AS (
  SELECT *, lower(trim(['common', 'Contact ', 'spa', 'other', 'card'][digit % 5 + 1])) AS term
  FROM digits WHERE digit % 8 > 0),
mraw AS (
  SELECT *, CASE source_field WHEN 'capabilities' THEN 'capability' WHEN 'procedures' THEN 'procedure'
    ELSE 'equipment' END AS claim_type, (CAST(field_ord AS BIGINT) * 2147483648 + elem_ord) * 4096 AS claim_ord
  FROM told WHERE term IN ({_terms})),
mclaim AS (
  SELECT facility_id, substring(sha1(facility_id || '|' || claim_type || '|' || term || '|' || element), 1, 16) AS claim_id,
    claim_type, term AS claim_value, left(element, 200) AS claim_raw, source_field,
    left(element, 200) AS source_text_span, least(0.75e0, digit / 256.0e0) AS extraction_confidence,
    'llm' AS extraction_method, 'stub' AS llm_model, claim_ord
  FROM mraw QUALIFY row_number() OVER (PARTITION BY facility_id, claim_id ORDER BY claim_ord) = 1)"""
add("model_claims", ctes(f.DOC, f.ELEM) + MODEL + " SELECT * FROM mclaim")
_both = f.trust(NOTICE_PACK).replace(
    "prim AS (", MODEL.strip().lstrip(",").strip() + ",\nallclaim AS (SELECT * FROM claim UNION ALL SELECT * FROM mclaim),\nprim AS ("
).replace("FROM claim QUALIFY", "FROM allclaim QUALIFY").replace("FROM claim LEFT JOIN", "FROM allclaim LEFT JOIN")
add("model_trust", ctes(_both) + f"SELECT {TRUST_COLUMNS} FROM trust")

_REACHABLE = f.indicators(NOTICE_INDICATORS).split("elem AS (", 1)[1]
_reach = f""",
{_REACHABLE[_REACHABLE.index("texts AS ("):]},
s AS (SELECT facility_id, key, status AS istatus FROM best JOIN meta USING (rule_ord)),
reachable AS (SELECT * FROM doc
  WHERE facility_id IN (SELECT facility_id FROM s WHERE key = 'english' AND istatus = 'available')
    AND facility_id NOT IN (SELECT facility_id FROM s WHERE key IN ({_caveats}) AND istatus = 'attention'))"""

# --- serving ----------------------------------------------------------------

_place = lambda p: f"(starts_with(lower(state), {q(p)}) OR starts_with(lower(city), {q(p)}))"
_joined = ctes(TRUST) + f""",
j AS (SELECT t.*, d.name, d.city, d.state, d.pincode, d.latitude, d.longitude, d.description
      FROM trust t JOIN doc d USING (facility_id)
      WHERE t.capability = 'common' AND t.trust_score >= 0.3e0 AND {_place('e')})"""
add("triage", _joined + f"""
SELECT facility_id, name, city, state, pincode, latitude, longitude, claim_count, {S}, {C},
  round(trust_score, 6) AS trust_score, status, description
FROM j ORDER BY {RANK}, j.trust_score DESC, facility_id LIMIT 200""")
_counts = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in STATUSES)
add("triage_counts", _joined + f" SELECT count(*) AS total, {_counts} FROM j")
_browsed = ctes(TRUST) + f""",
roll AS (
  SELECT facility_id, max(trust_score) AS best_trust,
    {", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}_caps" for s in STATUSES)},
    string_agg(DISTINCT capability, ',' ORDER BY capability) FILTER (WHERE status = 'verified') AS caps
  FROM trust GROUP BY facility_id),
browsed AS (
  SELECT d.*, r.best_trust, coalesce(r.best_trust, 0.0e0) AS trust_score,
    {", ".join(f"coalesce(r.{s}_caps, 0) AS {s}_caps" for s in STATUSES)},
    coalesce(caps, '') AS verified_capabilities,
    CASE WHEN r.contradicted_caps > 0 AND r.verified_caps = 0 THEN 'contradicted'
         WHEN r.verified_caps >= 1 THEN 'verified' ELSE 'unclear' END AS status
  FROM doc d LEFT JOIN roll r USING (facility_id) WHERE {_place('src1')})"""
add("browse", _browsed + f"""
SELECT facility_id, name, city, state, pincode, latitude, longitude, round(trust_score, 6) AS trust_score,
  verified_caps, unclear_caps, contradicted_caps, verified_capabilities, status, source_urls
FROM browsed ORDER BY {RANK}, best_trust DESC NULLS LAST, name, facility_id LIMIT 200""")
add("browse_counts", _browsed + f" SELECT count(*) AS total, {_counts} FROM browsed")
add("triage_filtered", ctes(TRUST) + _reach + f"""
SELECT facility_id, name, round(t.trust_score, 6) AS trust_score, status
FROM trust t JOIN reachable USING (facility_id) WHERE capability = 'common' AND trust_score >= 0
ORDER BY {RANK}, t.trust_score DESC, facility_id LIMIT 50""")
add("browse_counts_filtered", _browsed.replace("FROM doc d LEFT JOIN roll", "FROM reachable d LEFT JOIN roll")
    .replace(f" WHERE {_place('src1')}", "").replace(",\nroll AS", _reach + ",\nroll AS")
    + f" SELECT count(*) AS total, {_counts} FROM browsed")
add("prefix_search", ctes(f.DOC) + f"SELECT facility_id, name, state, city FROM doc WHERE {_place('src1')}")
add("substring_search", """
SELECT doc_id, lang, source FROM documents WHERE contains(lower(text), 'apache license')""")
add("entity_detail", ctes(f.DOC) + """
SELECT facility_id, name, city, state, pincode, latitude, longitude, description FROM doc
WHERE facility_id = '125'""")
_with = ctes(TRUST) + f""",
cwe AS (
  SELECT c.facility_id, c.claim_id, c.claim_type, c.claim_value, c.claim_raw, c.source_field,
    c.source_text_span, c.extraction_confidence, c.llm_model, round(t.trust_score, 6) AS trust_score, t.status, t.{S}, t.{C},
    c.claim_ord
  FROM claim c LEFT JOIN trust t ON t.facility_id = c.facility_id AND t.capability = c.claim_value)"""
add("claims_with_evidence", _with + " SELECT * FROM cwe")
add("claims_of_entity", _with + " SELECT * FROM cwe WHERE facility_id = '125'")
add("claim_groups", _with + f"""
SELECT facility_id, claim_value AS capability, arg_min(claim_id, claim_ord) AS claim_id,
  arg_min(claim_raw, claim_ord) AS claim_raw, count(*) AS claims, coalesce(max(trust_score), 0.0e0) AS trust_score,
  coalesce(max(status), 'unclear') AS status, coalesce(max({S}), 0) AS {S}, coalesce(max({C}), 0) AS {C},
  string_agg(source_field || ': ' || left(claim_raw, 160), ' | ' ORDER BY claim_ord) AS claimed_in
FROM cwe GROUP BY facility_id, claim_value""")
_EV = "facility_id, claim_id, evidence_id, snippet, source_field, polarity, retrieval_score"
add("entity_evidence", ctes(EVIDENCE) + f"""
SELECT e.facility_id, e.claim_id, evidence_id, snippet, e.source_field, polarity, retrieval_score
FROM evidence e JOIN claim c ON c.facility_id = e.facility_id AND c.claim_id = e.claim_id""")
add("evidence_of_entity", ORACLE_SQL["entity_evidence"] + " WHERE e.facility_id = '125'")
add("evidence_for_capability", ctes(EVIDENCE) + f"""
SELECT {_EV} FROM evidence WHERE claim_id IN (SELECT claim_id FROM claim WHERE claim_value = 'contact')""")
_IND = ", ".join(DISTRICT_INDICATORS)
add("district_context", ctes(f.DISTRICT) + f"""
SELECT district, state, {_IND} FROM district WHERE state = 'Nation 3'
ORDER BY {DISTRICT_INDICATORS[0]} ASC NULLS LAST, district LIMIT 50""")
add("lowest_k", ctes(f.DISTRICT) + f"""
SELECT district, state, {DISTRICT_INDICATORS[0]} FROM district WHERE {DISTRICT_INDICATORS[0]} IS NOT NULL
ORDER BY {DISTRICT_INDICATORS[0]}, district, state LIMIT 5""")
add("status_examples", ctes(TRUST) + f"""
SELECT facility_id, name, state, city, claim_count, {S}, {C}, round(t.trust_score, 6) AS trust_score, status
FROM trust t JOIN doc USING (facility_id) WHERE capability = 'common' AND status = 'contradicted'
ORDER BY t.trust_score DESC, facility_id LIMIT 20""")
_box = "latitude BETWEEN 6 AND 37 AND longitude BETWEEN 68 AND 98"
add("map_points", ctes(f.DOC) + f"SELECT facility_id, latitude AS lat, longitude AS lon FROM doc WHERE {_box}")
add("map_summary", ctes(f.DOC) + f"""
SELECT count(*) FILTER (WHERE {_box}) AS shown, count(latitude) - count(*) FILTER (WHERE {_box}) AS hidden FROM doc""")

# --- quality ----------------------------------------------------------------

_cov = {
    "valid_coords": "has_valid_coords", "with_capability_array": "len(capabilities) > 0",
    "with_specialties": "len(specialties) > 0", "with_equipment_array": "len(equipment) > 0",
    "with_citations": "len(source_urls) > 0", "with_year_established": "year_established IS NOT NULL",
}
add("dq_overview", ctes(f.FACILITY) + "SELECT count(*) AS total, " + ", ".join(
    f"count(*) FILTER (WHERE {e}) AS {n}, round(100.0e0 * count(*) FILTER (WHERE {e}) / nullif(count(*), 0), 1) AS {n}_pct"
    for n, e in _cov.items()) + """,
  count(*) FILTER (WHERE NOT has_valid_coords AND latitude IS NOT NULL) AS bad_coords_dropped,
  count(capacity) AS with_capacity FROM facility""")
add("dq_state_source", ctes(f.FACILITY) + """
SELECT state_source, count(*) AS facilities FROM facility GROUP BY state_source""")
add("dq_status_by_capability", ctes(TRUST) + """
SELECT capability, status, count(*) AS facilities, round(avg(trust_score), 3) AS avg_trust FROM trust
GROUP BY capability, status""")
add("claims_by_capability", ctes(CLAIM) + """
SELECT claim_value AS capability, count(*) AS claims FROM claim GROUP BY claim_value""")
add("status_pivot", ctes(TRUST) + f"SELECT capability, {_counts} FROM trust GROUP BY capability")
add("correction_examples", ctes(f.FACILITY) + """
SELECT name, state_raw, state AS state_resolved, district, pincode FROM facility
WHERE state_source = 'pincode' AND state_raw <> state ORDER BY facility_id LIMIT 15""")

# --- evaluation -------------------------------------------------------------

PREDICTIONS = ctes(TRUST, f.SCENARIO)
add("eval_predictions", PREDICTIONS + "SELECT * FROM predicted")
_flag, _true = "predicted_status = 'contradicted'", "expected_status = 'contradicted'"
add("eval_metrics", PREDICTIONS + f""",
n AS (SELECT count(*) AS total, count(*) FILTER (WHERE predicted_status = expected_status) AS passed,
        count(*) FILTER (WHERE {_flag} AND {_true}) AS tp, count(*) FILTER (WHERE {_flag} AND NOT {_true}) AS fp,
        count(*) FILTER (WHERE NOT {_flag} AND {_true}) AS fn FROM predicted)
SELECT total, passed, round(CAST(passed AS DOUBLE) / nullif(total, 0), 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 1.0e0 ELSE CAST(tp AS DOUBLE) / nullif(tp + fp, 0) END, 6) AS contradiction_precision,
  round(CASE WHEN tp + fn = 0 THEN 1.0e0 ELSE CAST(tp AS DOUBLE) / nullif(tp + fn, 0) END, 6) AS contradiction_recall
FROM n""")
add("confusion_matrix", PREDICTIONS + f""",
domain(expected) AS (VALUES {", ".join(f"({q(s)})" for s in STATUSES)})
SELECT expected, {", ".join(f"count(*) FILTER (WHERE predicted_status = {q(p)}) AS {p}" for p in PREDICTED)}
FROM domain LEFT JOIN predicted ON expected_status = expected GROUP BY expected""")
add("eval_misses", PREDICTIONS + "SELECT * FROM predicted WHERE predicted_status <> expected_status")

# --- reviewer state -----------------------------------------------------------

_VERDICT = "facility_id, claim_id, planner_id, status, reason, notes, created_at, seq"
add("verifications_latest", ctes(f.VERDICT) + f"SELECT {_VERDICT} FROM latest")
add("verifications_stream", ORACLE_SQL["verifications_latest"])
_NOTE = """
note AS (
  SELECT CAST(conv_id AS VARCHAR) AS facility_id, CASE WHEN role IS NOT NULL THEN 'planner ' || conv_id END AS planner_id,
    text AS note, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn) AS created_at, turn AS seq FROM conversations)
"""
add("annotations_log", ctes(_NOTE) + "SELECT * FROM note WHERE planner_id IS NOT NULL AND trim(note) <> ''")
add("planner_history", ctes(f.VERDICT, _NOTE) + """
SELECT 'verdict' AS kind, planner_id, facility_id, claim_id, status, reason, notes AS note, created_at, seq
FROM latest WHERE planner_id = 'planner 7'
UNION ALL SELECT 'note', planner_id, facility_id, NULL, NULL, NULL, note, created_at, seq
FROM note WHERE planner_id = 'planner 7' AND trim(note) <> ''""")
add("recorded_verdicts", ctes(f.VERDICT) + f"""
SELECT {_VERDICT}, concat_ws(',', CASE WHEN facility_id IS NULL THEN 'null_facility_id' END,
  CASE WHEN claim_id IS NULL THEN 'null_claim_id' END, CASE WHEN planner_id IS NULL THEN 'null_planner_id' END,
  CASE WHEN status IS NULL THEN 'null_status' END,
  CASE WHEN status NOT IN ('verified', 'rejected', 'needs_info') THEN 'status_outside_domain' END) AS broken
FROM verdict""")
add("recorded_notes", ctes(_NOTE) + """
SELECT *, concat_ws(',', CASE WHEN facility_id IS NULL THEN 'null_facility_id' END,
  CASE WHEN planner_id IS NULL THEN 'null_planner_id' END, CASE WHEN note IS NULL THEN 'null_note' END,
  CASE WHEN trim(note) = '' THEN 'blank_note' END) AS broken
FROM note""")
add("validate_actions", ctes(f.VERDICT) + "\nUNION ALL ".join(
    [f"SELECT 'null_{c}' AS \"check\", count(*) FILTER (WHERE {c} IS NULL) AS violations FROM verdict"
     for c in ("facility_id", "claim_id", "planner_id", "status")]
    + ["SELECT 'status_outside_domain', count(*) FILTER (WHERE status NOT IN "
       "('verified', 'rejected', 'needs_info')) FROM verdict",
       "SELECT 'repeated_key', count(*) FILTER (WHERE n > 1) FROM "
       "(SELECT count(*) AS n FROM valid GROUP BY facility_id, claim_id, planner_id)"]))


# --- similar claims, districts by polygon, state aliases ------------------------

add("similar_claims_exact", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
met AS (
  SELECT a.vec_id AS query_id, b.vec_id AS claim_id, round(list_cosine_similarity(a.e, b.e), 9) AS s
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, claim_id) AS rank, claim_id,
  round(s, 6) AS similarity
FROM met QUALIFY rank <= 10""")
add("similar_claims_recall", """
SELECT count(*) AS n_queries, CAST(sum(least(10, (SELECT count(*) FROM embeddings) - 1)) AS BIGINT) AS n_exact,
  true AS reached
FROM embeddings WHERE vec_id % 100 = 0""")

_POINT = """
point AS (
  SELECT CAST(c_custkey AS VARCHAR) AS point_id, c_nationkey * 4.0e0 AS x,
    CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN c_acctbal / 100.0e0 END AS y
  FROM customer)
"""


def _ring(corners) -> str:
    ends = [*corners[1:], corners[0]]
    return ", ".join(f"({x1}e0, {y1}e0, {x2}e0, {y2}e0)" for (x1, y1), (x2, y2) in zip(corners, ends))


_INSIDE = ctes(_POINT, f"""
edge AS (
  SELECT n_nationkey AS district_id, 4.0e0 * n_nationkey + dx1 AS x1, 20.0e0 + 10.0e0 * (n_nationkey % 5) + dy1 AS y1,
    4.0e0 * n_nationkey + dx2 AS x2, 20.0e0 + 10.0e0 * (n_nationkey % 5) + dy2 AS y2
  FROM nation, (VALUES {_ring(STAR)}, {_ring(HOLE)}) AS r(dx1, dy1, dx2, dy2))""", """
judged AS (
  SELECT point_id, district_id,
    count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) AS crossed,
    count(*) FILTER (WHERE (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) = 0 AND x BETWEEN least(x1, x2)
      AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS held
  FROM point, edge WHERE y IS NOT NULL GROUP BY ALL)""", """
inside AS (SELECT point_id, district_id FROM judged WHERE crossed % 2 = 1 OR held > 0)""")
add("polygon_districts", _INSIDE.replace(_POINT.strip(), """
point AS (
  SELECT vec_id AS point_id, 30.0e0 * CAST(embedding[1] AS DOUBLE) + 48.0e0 AS x,
    30.0e0 * CAST(embedding[2] AS DOUBLE) + 40.0e0 AS y
  FROM embeddings)""".strip()) + "SELECT * FROM inside")
add("polygon_attach", _INSIDE + """
SELECT point_id, min(district_id) AS district_id, count(district_id) AS n_districts,
  CASE WHEN count(district_id) = 0 THEN 'unresolved' ELSE 'polygon' END AS district_source
FROM point LEFT JOIN inside USING (point_id) GROUP BY point_id""")


def _cut(s: str, i: str) -> str:
    return f"(substr({s}, 1, {i} - 1) || substr({s}, {i} + 1))"


def _normal(c: str) -> str:
    return rf"trim(regexp_replace(replace(lower({c}), '&', ' and '), '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g'))"


_CUT = _cut("s", "i")
add("alias_resolution", ctes(f"""
written AS (
  SELECT conv_id || '-' || turn AS row_id, number % 7 AS way, number, 3 + number % 5 AS i, replace(n_name, '_', ' ') AS s
  FROM (SELECT *, conv_id + 11 * turn AS number FROM conversations) JOIN nation ON conv_id % 25 = n_nationkey)""", f"""
raw AS (
  SELECT row_id, CASE way WHEN 0 THEN '  ' || lower(s) || '!' WHEN 1 THEN {_CUT} WHEN 2 THEN {_cut(_CUT, "2")}
    WHEN 3 THEN substr(s, 1, i) || 'q' || substr(s, i + 1) WHEN 4 THEN 'Republic of' || {_CUT}
    WHEN 5 THEN CASE WHEN number % 2 = 0 THEN ' ' END ELSE {f.initcap("s")} END AS name_raw
  FROM written)""", f"""
canon AS (SELECT {f.initcap("replace(n_name, '_', ' ')")} AS state FROM nation)""", f"""
told AS (
  SELECT spelled, {_normal("spelled")} AS alias, state
  FROM (SELECT state AS spelled, state FROM canon UNION ALL SELECT 'Republic of ' || state, state FROM canon))""", f"""
named AS (SELECT row_id, name_raw, coalesce({_normal("name_raw")}, '') AS name FROM raw)""", """
near AS (
  SELECT DISTINCT name, state, levenshtein(name, alias) AS distance FROM (SELECT DISTINCT name FROM named), told
  WHERE levenshtein(name, alias) <= CASE WHEN length(name) >= 8 THEN 2 WHEN length(name) >= 4 THEN 1 ELSE 0 END)""", """
best AS (
  SELECT name, min(distance) AS distance, min(state) AS state, count(DISTINCT state) AS n
  FROM (SELECT * FROM near QUALIFY distance = min(distance) OVER (PARTITION BY name)) GROUP BY name)""") + """
SELECT row_id, name_raw, CASE WHEN n = 1 THEN state END AS state, CAST(distance AS INT) AS distance,
  CASE WHEN name = '' THEN 'missing' WHEN n > 1 THEN 'ambiguous' WHEN name_raw IN (SELECT spelled FROM told) THEN 'exact'
    WHEN distance = 0 THEN 'spelling' WHEN distance > 0 THEN 'edits' ELSE 'unknown' END AS reason
FROM named LEFT JOIN best USING (name)""")

# --- snapshots ------------------------------------------------------------------

_AT = [f"TIMESTAMP '{t}'" for t in SNAPSHOT_TIMES]
_SNAPSHOTS = ctes(f.VERDICT, f"""
taken AS (
  SELECT n, t, lead(t) OVER (ORDER BY n) AS following
  FROM (VALUES {", ".join(f"({i}, {t})" for i, t in enumerate(_AT))}) AS v(n, t))""", """
snapshot AS (
  SELECT n, t, facility_id, claim_id, planner_id, status, reason FROM valid JOIN taken ON created_at <= t
  QUALIFY row_number() OVER (PARTITION BY n, facility_id, claim_id, planner_id ORDER BY created_at DESC, seq DESC) = 1)""", """
held AS (SELECT * FROM snapshot WHERE status <> 'rejected')""")
add("snapshot_intervals", _SNAPSHOTS + """
, version AS (
  SELECT *, coalesce(lag(n) OVER w = n - 1 AND lag(status) OVER w = status
    AND lag(reason) OVER w IS NOT DISTINCT FROM reason, false) AS same
  FROM held WINDOW w AS (PARTITION BY facility_id, claim_id, planner_id ORDER BY n)
), island AS (
  SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END)
    OVER (PARTITION BY facility_id, claim_id, planner_id ORDER BY n) AS i FROM version
), span AS (
  SELECT facility_id, claim_id, planner_id, status, reason, i, min(t) AS valid_from, max(n) AS last
  FROM island GROUP BY ALL
)
SELECT facility_id, claim_id, planner_id, status, reason, valid_from, following AS valid_to
FROM span JOIN taken ON taken.n = span.last""")
add("snapshot_as_of", _SNAPSHOTS + "SELECT facility_id, claim_id, planner_id, status, reason FROM held WHERE n = 1")
_GOLD = "(" + ctes("{parts}") + "SELECT facility_id, capability, status, trust_score FROM trust)"
_FLIP_RANK = "CASE {c} WHEN 'verified' THEN 1 WHEN 'unclear' THEN 2 ELSE 3 END"
add("trust_flips", f"""
SELECT facility_id, capability, o.status AS old_status, n.status AS new_status, round(o.trust_score, 6) AS old_score,
  round(n.trust_score, 6) AS new_score,
  CASE WHEN o.status IS NULL THEN 'appeared' WHEN n.status IS NULL THEN 'vanished' ELSE 'changed' END AS change,
  CASE WHEN o.status IS NULL THEN 'new' WHEN n.status IS NULL THEN 'gone'
    WHEN {_FLIP_RANK.format(c="n.status")} > {_FLIP_RANK.format(c="o.status")} THEN 'worse' ELSE 'better' END AS alert
FROM {_GOLD.replace("{parts}", TRUST)} o FULL JOIN {_GOLD.replace("{parts}", f.trust(REVISED_NOTICE_PACK))} n
  USING (facility_id, capability)
WHERE o.status IS DISTINCT FROM n.status""")


# --- saved searches, source quality -----------------------------------------------

_TERMS = "['permissive', 'copyleft', 'noncommercial', 'contact', 'network', 'card', 'common']"
add("saved_search_matches", f"""
WITH search AS (
  SELECT 'search ' || s_suppkey AS search_id, ({_TERMS})[s_suppkey % 8 + 1] AS capability,
    CASE s_suppkey % 5 WHEN 1 THEN 'verified' WHEN 2 THEN 'contradicted' END AS status,
    CASE s_suppkey % 3 WHEN 0 THEN 'src' || s_nationkey WHEN 1 THEN 'f' END AS place,
    CASE WHEN s_suppkey % 4 > 0 THEN (s_suppkey % 10) / 10.0e0 END AS min_trust,
    CASE WHEN s_suppkey % 2 = 0 THEN ['licensed'] WHEN s_suppkey % 7 = 0 THEN ['english', 'reachable'] ELSE [] END AS required
  FROM supplier),
gold AS ({ctes(TRUST)} SELECT * FROM trust),
has AS (
  SELECT facility_id, list(key) AS available
  FROM ({ctes(INDICATORS)} SELECT facility_id, key FROM best JOIN meta USING (rule_ord) WHERE status = 'available')
  GROUP BY facility_id)
SELECT search_id, g.facility_id, g.capability, g.status, round(g.trust_score, 6) AS trust_score
FROM gold g JOIN documents d ON g.facility_id = CAST(d.doc_id AS VARCHAR) LEFT JOIN has USING (facility_id)
JOIN search s ON (s.capability IS NULL OR s.capability = g.capability) AND (s.status IS NULL OR s.status = g.status)
  AND (s.place IS NULL OR starts_with(lower(d.lang), s.place) OR starts_with(lower(d.source), s.place))
  AND (s.min_trust IS NULL OR g.trust_score >= s.min_trust) AND list_has_all(coalesce(available, []), s.required)""")
_LEASE = [f"TIMESTAMP '{t}'" for t in LEASE_TIMES]


def _lease(n: int, waiting: str, free: str) -> str:
    """The leases of round ``n``: claims by priority meet places by turn."""
    return f"""
place{n} AS (
  SELECT planner_id, lease_days, row_number() OVER (ORDER BY turn, planner_id) AS position
  FROM (SELECT *, unnest(range(1, free + 1)) AS turn FROM ({free}))),
queue{n} AS (
  SELECT *, row_number() OVER (ORDER BY trust_score NULLS FIRST, facility_id, capability) AS position
  FROM ({waiting})),
lease{n} AS (
  SELECT facility_id, capability, trust_score, planner_id, position, {_LEASE[n - 1]} AS leased_at,
    {_LEASE[n - 1]} + to_days(CAST(lease_days AS INTEGER)) AS expires_at
  FROM queue{n} JOIN place{n} USING (position))"""


add("review_queue", ctes(TRUST, f.VERDICT, """
waiting AS (
  SELECT facility_id, capability, min(round(trust_score, 6)) AS trust_score FROM trust
  WHERE facility_id NOT IN (SELECT facility_id FROM latest WHERE status <> 'needs_info') GROUP BY ALL),
reviewer AS (
  SELECT DISTINCT 'planner ' || user_id AS planner_id, user_id % 4 AS free, user_id % 3 + 1 AS lease_days
  FROM events WHERE user_id IS NOT NULL)""",
    _lease(1, "SELECT * FROM waiting", "SELECT * FROM reviewer"), f"""
live AS (SELECT * FROM lease1 WHERE expires_at > {_LEASE[1]})""",
    _lease(2, "SELECT * FROM waiting ANTI JOIN live USING (facility_id, capability)", """
      SELECT planner_id, lease_days, free - coalesce(held, 0) AS free FROM reviewer
      LEFT JOIN (SELECT planner_id, count(*) AS held FROM live GROUP BY ALL) USING (planner_id)"""),
) + "SELECT * FROM lease1 UNION ALL SELECT * FROM lease2")

add("shortlist_status", f"""
WITH gold AS ({ctes(TRUST)} SELECT * FROM trust)
SELECT lang || '-' || source AS shortlist_id, count(DISTINCT doc_id) AS n_listed, count(DISTINCT facility_id) AS n_known,
  {", ".join(f"count(*) FILTER (WHERE status = {q(s)}) AS {s}" for s in STATUSES)}
FROM documents LEFT JOIN gold ON facility_id = CAST(doc_id AS VARCHAR) GROUP BY 1""")

# Enough rounds for the shares to stand still to more than the six digits shown.
_ROUNDS = 80
_DOMAIN = r"regexp_extract(lower(url), '://(?:[^/?#@]*@)?[^/:?#]*?((?:[^./:?#]+\.)?example\.(?:com|net|org))(?:[/:?#]|$)', 1)"
add("source_quality", f"""
WITH page AS (SELECT page_id, {_DOMAIN} AS domain, html FROM pages),
led AS (
  SELECT domain AS src, (page_id * 31 + (length(h) - 1) * (length(h) - 1) * 17) % (SELECT count(*) FROM pages) AS page_id
  FROM (SELECT page_id, domain, unnest(regexp_extract_all(html, ' href="([^"]*)"', 1)) AS h FROM page WHERE page_id % 9 <> 4)),
edge AS MATERIALIZED (
  SELECT src, domain AS dst, count(*) AS n FROM led JOIN page USING (page_id) WHERE src <> domain GROUP BY ALL),
node AS MATERIALIZED (
  SELECT domain, count(*) AS n_pages, (SELECT sum(n) FROM edge WHERE src = domain) AS out FROM page GROUP BY domain),
r0 AS MATERIALIZED (SELECT domain, out, 1.0e0 / (SELECT count(*) FROM node) AS r FROM node),
""" + ",\n".join(f"""r{i + 1} AS MATERIALIZED (
  SELECT p.domain, p.out, (0.15e0 + 0.85e0 * (SELECT coalesce(sum(r), 0) FROM r{i} WHERE out IS NULL)) / (SELECT count(*) FROM node)
    + 0.85e0 * coalesce(g.got, 0) AS r
  FROM r{i} p LEFT JOIN (SELECT dst, sum(r * n / out) AS got FROM edge JOIN r{i} ON domain = src GROUP BY dst) g
    ON g.dst = p.domain)""" for i in range(_ROUNDS)) + f"""
SELECT domain, n_pages, (SELECT count(*) FROM edge WHERE dst = domain) AS n_in, round(r, 6) AS rank,
  rank() OVER (ORDER BY round(r, 9) DESC) AS place
FROM r{_ROUNDS} JOIN node USING (domain)""")

add("verdict_stream_log", ORACLE_SQL["recorded_verdicts"])
add("verifications_state", ORACLE_SQL["verifications_latest"])
add("label_lines", """
SELECT CAST(doc_id AS VARCHAR) AS facility_id, 'common' AS claim_value,
  CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'verified' ELSE 'unclear' END AS expected_status,
  'quality ' || quality || ' toxic ' || toxic AS rationale
FROM labels""")

add("page_quality", f"""
SELECT page_id, url, domain, rank, place FROM ({ORACLE_SQL["source_quality"]})
JOIN (SELECT page_id, url, {_DOMAIN} AS domain FROM pages) USING (domain)""")


# --- figures, gaps, what fields say together ---------------------------------------

_PUBLISHED = """
share AS (
  SELECT upper(lang) AS state, lang || '-' || source AS district, count(*) AS n,
    round(100.0e0 * count(*) FILTER (WHERE n_chars < 1000) / count(*), 1) AS short,
    round(100.0e0 * count(*) FILTER (WHERE n_chars > 3000) / count(*), 1) AS long
  FROM documents GROUP BY ALL),
figure AS (
  SELECT state, district, CASE WHEN n % 7 <> 1 THEN short END AS short_pct, CASE WHEN n % 7 <> 1 THEN long END AS long_pct,
    n % 7 = 1 OR n % 3 = 0 AS short_pct_low_sample, n % 7 = 1 OR n % 3 = 0 AS long_pct_low_sample
  FROM share)"""
add("typed_indicators", ctes(_PUBLISHED) + "SELECT * FROM figure")

add("district_gaps", ctes(TRUST, _PUBLISHED, f"""
asked AS (SELECT unnest([{", ".join(q(t) for t in dict.fromkeys(r.capability for r in NOTICE_PACK.rules))}]) AS capability),
held AS (
  SELECT ['district', 'state', '', 'country'][grouping(state, pincode) + 1] AS level, state, pincode AS district, count(*) AS n_facilities
  FROM doc GROUP BY GROUPING SETS ((state, pincode), (state), ())),
burdened AS (
  SELECT ['district', 'state', '', 'country'][grouping(state, district) + 1] AS level, state, district, round(avg(short_pct), 6) AS burden
  FROM figure GROUP BY GROUPING SETS ((state, district), (state), ())),
claiming AS (
  SELECT ['district', 'state', '', 'country'][grouping(state, pincode) + 1] AS level, state, pincode AS district, capability,
    count(*) AS n_claiming, count(*) FILTER (WHERE status = 'verified') AS n_verified,
    quantile_disc(round(trust_score, 6), 0.5) AS median_score
  FROM trust JOIN doc USING (facility_id) GROUP BY GROUPING SETS ((capability, state, pincode), (capability, state), (capability))),
gapped AS (
  SELECT t.level, t.state, t.district, asked.capability, n_facilities, coalesce(n_claiming, 0) AS n_claiming,
    coalesce(n_verified, 0) AS n_verified, median_score, burden,
    round(coalesce(n_verified, 0) / n_facilities, 6) AS coverage,
    round(burden * (1 - coalesce(n_verified, 0) / n_facilities), 6) AS gap
  FROM held t CROSS JOIN asked
  LEFT JOIN burdened m ON m.level = t.level AND m.state IS NOT DISTINCT FROM t.state AND m.district IS NOT DISTINCT FROM t.district
  LEFT JOIN claiming c ON c.level = t.level AND c.state IS NOT DISTINCT FROM t.state AND c.district IS NOT DISTINCT FROM t.district
    AND c.capability = asked.capability)""") + """
SELECT *, CASE WHEN gap IS NOT NULL THEN rank() OVER (PARTITION BY level, capability, gap IS NULL ORDER BY gap DESC) END AS gap_rank,
  CASE WHEN gap IS NOT NULL THEN round(percent_rank() OVER (PARTITION BY level, capability, gap IS NULL ORDER BY gap), 6) END AS gap_percent
FROM gapped""")

_SAID = """
said AS (
  SELECT l_partkey AS facility_id, ['description', 'capabilities', 'equipment'][l_linenumber % 3 + 1] AS source_field,
    CASE (l_orderkey + l_suppkey) % 9
      WHEN 0 THEN 'A ward of ' || n || ' beds.'
      WHEN 1 THEN 'Between ' || n || '  and ' || (n + l_linenumber) || ' beds, with over ' || n || ' nurses'
      WHEN 2 THEN 'a ' || n || '-bedded house; up to ' || (n + l_linenumber) || ' doctors'
      WHEN 3 THEN n || '-' || (n + l_linenumber) || ' Beds on ' || (n + 1) || ',250 sq ft'
      WHEN 4 THEN 'AT LEAST ' || n || ' beds (' || n || '.5.1 beds, 3,5 nurses)'
      WHEN 5 THEN 'about ' || n || ' doctors and ' || (n + 1) || ',250.5 square  metres'
      WHEN 6 THEN 'v' || n || ' beds, room ' || n
      WHEN 7 THEN 'minimum of ' || n || ' nurses, at most ' || (n + l_linenumber) || ' nurses' END AS text
  FROM (SELECT *, CAST(l_quantity AS BIGINT) AS n FROM lineitem))"""
_PATTERN = q(quantity_pattern(UNITS))
_BY_UNIT = lambda i: "CASE unit " + " ".join(
    f"WHEN {q(w)} THEN {q(x[0]) if i == 0 else repr(x[1]) + 'e0'}" for w, x in UNITS.items()) + " END"
_number = lambda x: (
    f"CASE WHEN regexp_matches({x}, '^([0-9]+|[0-9]{{1,3}}(,[0-9]{{3}})+)([.][0-9]+)?$') "
    f"THEN CAST(replace({x}, ',', '') AS DOUBLE) * {_BY_UNIT(1)} END")
_QUANTITY = f"""{_SAID},
quoted AS (SELECT facility_id, source_field, unnest(regexp_extract_all(text, {_PATTERN}, 0)) AS quote FROM said),
parts AS (
  SELECT *, """ + ", ".join(
    rf"lower(regexp_replace(regexp_extract(quote, {_PATTERN}, {i}), '\s+', ' ', 'g')) AS {n}"
    for i, n in enumerate(("word", "first", "second", "unit"), 1)) + f""" FROM quoted),
valued AS (SELECT *, {_BY_UNIT(0)} AS kind, {_number("first")} AS a, {_number("second")} AS b FROM parts),
quantity AS (
  SELECT facility_id, source_field, kind, quote,
    CASE WHEN word IN ('at most', 'up to', 'less than', 'under', 'maximum of', 'maximum') THEN 0.0e0
      WHEN word IN ('about', 'around', 'approximately', 'nearly') THEN least(a, coalesce(b, a)) * 0.9e0
      ELSE least(a, coalesce(b, a)) END AS low,
    CASE WHEN word IN ('at least', 'more than', 'over', 'minimum of', 'minimum') THEN NULL
      WHEN word IN ('about', 'around', 'approximately', 'nearly') THEN greatest(a, coalesce(b, a)) * 1.1e0
      ELSE greatest(a, coalesce(b, a)) END AS high
  FROM valued WHERE a IS NOT NULL AND (second = '' OR b IS NOT NULL))"""
add("quantities", ctes(_QUANTITY) + """
SELECT facility_id, source_field, kind, round(low, 6) AS low, round(high, 6) AS high, quote FROM quantity""")
add("quantity_agreement", ctes(_QUANTITY, """
hull AS (
  SELECT facility_id, kind, source_field, count(*) AS n, min(low) AS low, max(coalesce(high, 1e300)) AS high FROM quantity GROUP BY ALL),
both_ AS (
  SELECT facility_id, kind, count(*) AS n_fields, CAST(sum(n) AS BIGINT) AS n_statements, max(low) AS low, min(high) AS high
  FROM hull GROUP BY ALL),
sides AS (
  SELECT b.*, (SELECT min(source_field) FROM hull h WHERE h.facility_id = b.facility_id AND h.kind = b.kind AND h.low = b.low) AS low_field,
    (SELECT min(source_field) FROM hull h WHERE h.facility_id = b.facility_id AND h.kind = b.kind AND h.high = b.high) AS top_field
  FROM both_ b)""") + """
SELECT s.facility_id, s.kind, n_fields, n_statements, s.low <= s.high AS agrees, round(s.low, 6) AS low,
  CASE WHEN s.high < 1e300 THEN round(s.high, 6) END AS high, low_field,
  (SELECT min(quote) FROM quantity x WHERE x.facility_id = s.facility_id AND x.kind = s.kind AND x.source_field = low_field
    AND x.low = s.low) AS low_quote,
  CASE WHEN s.high < 1e300 THEN top_field END AS high_field,
  CASE WHEN s.high < 1e300 THEN (SELECT min(quote) FROM quantity x WHERE x.facility_id = s.facility_id AND x.kind = s.kind
    AND x.source_field = top_field AND x.high = s.high) END AS high_quote
FROM sides s""")

add("corroborated_claims", ctes(EVIDENCE, """
prose AS (SELECT DISTINCT facility_id, claim_id, true AS in_prose FROM evidence WHERE source_field = 'description' AND polarity = 'supports')
""") + """
SELECT facility_id, claim_value AS capability, count(*) AS n_claims, count(DISTINCT source_field) AS n_fields,
  string_agg(DISTINCT source_field, ',' ORDER BY source_field) AS fields, coalesce(bool_or(in_prose), false) AS description_supported,
  round(least(max(extraction_confidence) + 0.05e0 * (count(DISTINCT source_field) - 1), 1.0e0), 6) AS confidence
FROM claim LEFT JOIN prose USING (facility_id, claim_id) GROUP BY facility_id, claim_value""")
