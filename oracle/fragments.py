"""SQL building blocks for the second engine.

Its regular expressions know neither look-around nor Unicode word boundaries. So
positions come from the pieces between matches, and letters outside ASCII are first
replaced by an underscore, which is a word character too and keeps all positions.
"""

from __future__ import annotations

import re

from attesta.packs import IndicatorPack, RulePack

CONFIDENCE = {"capabilities": 0.85, "specialties": 0.8, "procedures": 0.75, "equipment": 0.75}
CLAIM_TYPE = {
    "capabilities": "capability", "specialties": "specialty", "procedures": "procedure", "equipment": "equipment",
}


def ungrouped(pattern: str) -> str:
    """The pattern with capturing groups opened as plain ones; escapes and classes stay."""
    out, i, in_class = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out, i = out + pattern[i : i + 2], i + 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        plain_group = c == "(" and not in_class and not re.match(r"\(\?", pattern[i:])
        out, i = out + ("(?:" if plain_group else c), i + 1
    return out

SPACE = (
    r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return q("(?i)" + ungrouped(pattern))


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def mask(x: str) -> str:
    return f"regexp_replace({x}, '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g')"


def initcap(x: str) -> str:
    return (
        f"array_to_string(list_transform(string_split(lower({x}), ' '), "
        "lambda w: upper(left(w, 1)) || substring(w, 2)), ' ')"
    )


def normalized(x: str) -> str:
    return initcap(rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))")


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


DOC = """
doc AS (
  SELECT CAST(doc_id AS VARCHAR) AS facility_id, 'Document ' || doc_id AS name, source AS city,
         upper(lang) AS state, lang || '-' || source AS pincode, n_chars / 100.0e0 AS latitude,
         60.0e0 + length(source) * 4.0e0 AS longitude, text AS description, source, lang,
         'https://' || source || '.example/' || lang AS source_urls
  FROM documents)
"""

ELEM = """
line AS (
  SELECT facility_id, ls, unnest(range(0, len(ls))) AS li
  FROM (SELECT facility_id, string_split(description, chr(10)) AS ls FROM doc)),
elem AS (
  SELECT facility_id, ['capabilities', 'procedures', 'equipment'][li % 3 + 1] AS source_field,
         CAST([0, 2, 3][li % 3 + 1] AS INTEGER) AS field_ord, CAST(li // 3 AS INTEGER) AS elem_ord,
         ls[li + 1] AS element
  FROM line WHERE ls[li + 1] <> ''
  UNION ALL SELECT facility_id, 'specialties', 1, 0, source FROM doc WHERE source <> ''
  UNION ALL SELECT facility_id, 'specialties', 1, 1, lang FROM doc WHERE lang <> '')
"""


def window(text: str, st: str, en: str, half: int = 100) -> str:
    return strip(
        f"substring({text}, greatest({st} - {half}, 0) + 1, "
        f"least(length({text}), {en} + {half}) - greatest({st} - {half}, 0))"
    )


def denied(text: str, st: str, en: str, before: str, after: str, reach: int) -> str:
    b = f"substring({text}, greatest(1, {st} - 49), least({st}, 50))"
    return (
        f"(regexp_matches({b}, {rx(before)}) OR "
        f"regexp_matches(substring({text}, {en} + 1, {reach}), {rx(after)}))"
    )


def claim(pack: RulePack) -> str:
    """doc, line, elem, claim."""
    hits = "\n  UNION ALL ".join(
        f"SELECT *, {q(r.capability)} AS cap, {i} AS rule_ord, {j} AS pat_ord, "
        f"length(string_split_regex(m, {rx(p)})[1]) AS st, "
        f"length(regexp_extract(m, {rx(p)})) AS ln FROM masked WHERE regexp_matches(m, {rx(p)})"
        for i, r in enumerate(pack.rules)
        for j, p in enumerate(r.patterns)
    )
    losers = " OR ".join(
        f"(w.cap = {q(w)} AND f.cap = {q(x)})" for w, x in pack.suppress
    ) or "false"
    owner: dict[str, tuple[str, int]] = {}
    for i, r in enumerate(pack.rules):
        for c in r.codes:
            owner.setdefault(c, (r.capability, i))
    codes = ", ".join(f"({q(c)}, {q(cap)}, {i})" for c, (cap, i) in owner.items())
    conf = " ".join(f"WHEN {q(f)} THEN {v}e0" for f, v in CONFIDENCE.items())
    kind = " ".join(f"WHEN {q(f)} THEN {q(v)}" for f, v in CLAIM_TYPE.items())
    cid = (
        "substring(sha1(facility_id || '|' || claim_type || '|' || cap || '|' || element), 1, 16)"
    )
    return ",\n".join(
        [
            DOC.strip(),
            ELEM.strip(),
            f"masked AS (SELECT *, {mask('element')} AS m FROM elem WHERE source_field <> 'specialties')",
            f"rawhit AS ({hits})",
            "firsthit AS (SELECT * FROM rawhit QUALIFY row_number() OVER "
            "(PARTITION BY facility_id, field_ord, elem_ord, rule_ord ORDER BY pat_ord) = 1)",
            "kept AS (SELECT * FROM firsthit f WHERE NOT EXISTS (SELECT 1 FROM firsthit w "
            "WHERE w.facility_id = f.facility_id AND w.field_ord = f.field_ord "
            f"AND w.elem_ord = f.elem_ord AND ({losers})))",
            f"code(code, cap, rule_ord) AS (VALUES {codes})",
            "emitted0 AS ("
            f"SELECT facility_id, field_ord, elem_ord, rule_ord, source_field, element, cap, "
            f"left(element, 200) AS claim_raw, {window('element', 'st', 'st + ln')} AS source_text_span "
            "FROM kept UNION ALL "
            "SELECT facility_id, field_ord, elem_ord, c.rule_ord, source_field, element, c.cap, "
            f"element, element FROM elem JOIN code c ON c.code = {strip('element')} "
            "WHERE source_field = 'specialties')",
            f"emitted1 AS (SELECT *, CASE source_field {kind} END AS claim_type, "
            f"CASE source_field {conf} END AS extraction_confidence, "
            "(CAST(field_ord AS BIGINT) * 2147483648 + elem_ord) * 4096 + rule_ord AS claim_ord "
            "FROM emitted0)",
            f"emitted AS (SELECT *, {cid} AS claim_id FROM emitted1)",
            "claim AS (SELECT facility_id, claim_id, claim_type, cap AS claim_value, claim_raw, "
            "source_field, source_text_span, extraction_confidence, 'rules' AS extraction_method, "
            "'rules-v1' AS llm_model, claim_ord FROM emitted QUALIFY row_number() OVER "
            "(PARTITION BY facility_id, claim_id ORDER BY claim_ord) = 1)",
            "prim AS (SELECT facility_id, claim_value AS capability, claim_id, extraction_confidence "
            "FROM claim QUALIFY row_number() OVER (PARTITION BY facility_id, claim_value "
            "ORDER BY extraction_confidence DESC, claim_ord) = 1)",
        ]
    )


def positions(pieces: str, matches: str) -> str:
    """Start of match i from the pieces between matches."""
    return (
        f"CAST(list_sum(list_transform({pieces}[1:i], lambda x: length(x))) + "
        f"coalesce(list_sum(list_transform({matches}[1:i-1], lambda x: length(x))), 0) AS BIGINT)"
    )


def evidence(pack: RulePack) -> str:
    """claim's parts plus evidence."""
    found = "\n  UNION ALL ".join(
        f"SELECT h.*, p.claim_id, {j} AS pat_ord, string_split_regex(m, {rx(p)}) AS pc, "
        f"regexp_extract_all(m, {rx(p)}) AS ms FROM hay h JOIN prim p "
        f"ON p.facility_id = h.facility_id AND p.capability = {q(r.capability)} "
        f"WHERE regexp_matches(m, {rx(p)})"
        for r in pack.rules
        for j, p in enumerate(r.patterns)
    )
    return ",\n".join(
        [
            claim(pack),
            "hay AS (SELECT *, " + mask("text") + " AS m FROM ("
            "SELECT facility_id, 0 AS hay, 'description' AS source_field, 0 AS elem_ord, "
            "description AS text FROM doc UNION ALL SELECT facility_id, "
            "CASE source_field WHEN 'capabilities' THEN 1 WHEN 'procedures' THEN 2 "
            "WHEN 'equipment' THEN 3 ELSE 4 END, source_field, elem_ord, element FROM elem))",
            f"found AS ({found})",
            "numbered AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM found)",
            f"placed AS (SELECT *, {positions('pc', 'ms')} AS st, length(ms[i]) AS ln FROM numbered)",
            f"hit AS (SELECT *, {window('text', 'st', 'st + ln')} AS snippet, CASE WHEN "
            f"{denied('m', 'st', '(st + ln)', pack.cue_before, pack.cue_after, 80)} "
            "THEN 'contradicts' ELSE 'supports' END AS polarity FROM placed)",
            "keyed AS (SELECT *, substring(sha1(claim_id || '|' || left(snippet, 64)), 1, 16) "
            "AS evidence_id FROM hit)",
            "evidence AS (SELECT facility_id, evidence_id, claim_id, snippet, source_field, polarity, "
            "1.0e0 AS retrieval_score FROM keyed QUALIFY row_number() OVER (PARTITION BY facility_id, "
            "claim_id, evidence_id ORDER BY hay, elem_ord, pat_ord, i) = 1)",
        ]
    )


def score(claims: str, s: str, c: str, conf: str) -> str:
    return (
        f"CASE WHEN {claims} = 0 THEN 0.0e0 ELSE greatest(0.0e0, least(1.0e0, "
        f"greatest(0.0e0, {conf} - 0.2e0) + least(0.3e0, 0.08e0 * {s}) - least(0.8e0, 0.3e0 * {c}))) END"
    )


def label(trust: str, s: str, c: str) -> str:
    return (
        f"CASE WHEN {c} >= 1 AND {s} <= {c} THEN 'contradicted' WHEN {c} >= 1 THEN 'unclear' "
        f"WHEN {trust} >= 0.75e0 AND {s} >= 2 THEN 'verified' ELSE 'unclear' END"
    )


def trust(pack: RulePack) -> str:
    """evidence's parts plus trust (score not rounded)."""
    s, c = "supporting_evidence_count", "contradicting_evidence_count"
    return ",\n".join(
        [
            evidence(pack),
            "per_claim AS (SELECT facility_id, claim_id, "
            "count(*) FILTER (WHERE polarity = 'supports') AS s, "
            "count(*) FILTER (WHERE polarity = 'contradicts') AS c FROM evidence GROUP BY ALL)",
            "counted AS (SELECT facility_id, claim_value AS capability, count(*) AS claim_count, "
            f"CAST(coalesce(sum(s), 0) AS BIGINT) AS {s}, CAST(coalesce(sum(c), 0) AS BIGINT) AS {c}, "
            "max(extraction_confidence) AS conf FROM claim LEFT JOIN per_claim "
            "USING (facility_id, claim_id) GROUP BY facility_id, claim_value)",
            f"scored AS (SELECT *, {score('claim_count', s, c, 'conf')} AS trust_score FROM counted)",
            f"trust AS (SELECT facility_id, capability, claim_count, {s}, {c}, trust_score, "
            f"{label('trust_score', s, c)} AS status FROM scored)",
        ]
    )


def indicators(pack: IndicatorPack) -> str:
    """doc, line, elem plus judged: status per (entity, text, rule)."""
    hits = "\n  UNION ALL ".join(
        f"SELECT *, {i} AS rule_ord, {j} AS pat_ord, {str(r.is_caveat).lower()} AS caveat, "
        f"length(string_split_regex(m, {rx(p)})[1]) AS st, "
        f"length(regexp_extract(m, {rx(p)})) AS ln FROM texts WHERE regexp_matches(m, {rx(p)})"
        for i, r in enumerate(pack.rules)
        for j, p in enumerate(r.patterns)
    )
    return ",\n".join(
        [
            DOC.strip(),
            ELEM.strip(),
            f"texts AS (SELECT *, {mask('text')} AS m FROM ("
            "SELECT facility_id, CASE source_field WHEN 'capabilities' THEN 0 WHEN 'procedures' THEN 1 "
            "ELSE 2 END AS text_field, elem_ord, source_field, element AS text FROM elem "
            "WHERE source_field <> 'specialties' UNION ALL "
            "SELECT facility_id, 3, 0, 'description', description FROM doc) "
            f"WHERE {strip('text')} <> '')",
            f"ihit AS ({hits})",
            "ifirst AS (SELECT * FROM ihit QUALIFY row_number() OVER (PARTITION BY facility_id, "
            "text_field, elem_ord, rule_ord ORDER BY pat_ord) = 1)",
            "judged AS (SELECT *, CASE WHEN caveat THEN 'attention' WHEN "
            f"{denied('m', 'st', '(st + ln)', pack.cue_before, pack.cue_after, 60)} "
            "THEN 'unavailable' ELSE 'available' END AS status FROM ifirst)",
            "ranked AS (SELECT *, CASE status WHEN 'attention' THEN 2 WHEN 'available' THEN 1 ELSE 0 END "
            "AS rnk FROM judged)",
            "best AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY facility_id, rule_ord "
            "ORDER BY rnk DESC, text_field, elem_ord) = 1)",
            "meta(rule_ord, key, label, kind) AS (VALUES "
            + ", ".join(f"({i}, {q(r.key)}, {q(r.label)}, {q(r.kind)})" for i, r in enumerate(pack.rules))
            + ")",
        ]
    )


def try_int(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '^\s*[+-]?[0-9]+\s*$') THEN TRY_CAST(trim({x}) AS INTEGER) END"


def json_list(x: str) -> str:
    """Distinct elements of a JSON array in text, NULL for anything else."""
    return (
        f"CASE WHEN json_valid({x}) AND json_type({x}) = 'ARRAY' "
        f"THEN list_distinct(CAST(json({x}) AS VARCHAR[])) END"
    )


SOURCE = """
facility_source AS (
  SELECT CAST(c_custkey AS VARCHAR) AS unique_id, '  ' || c_name || ' ' AS name,
    c_mktsegment || ' in ' || n_name AS description,
    ' ' || c_mktsegment || ' ' AS organization_type,
    CASE WHEN c_mktsegment = 'MACHINERY' THEN '   ' ELSE c_mktsegment END AS facilityTypeId,
    n_name AS operatorTypeId,
    '["' || c_mktsegment || '","' || n_name || '","' || c_mktsegment || '"]' AS specialties,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'not json'
         ELSE '["' || n_name || '","' || n_name || '"]' END AS procedure,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN '{"a": 1}' ELSE '[]' END AS equipment,
    CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN '["' || c_name || '"]' END AS capability,
    '["http://x/' || n_name || '","","http://x/' || c_mktsegment || '"]' AS source_urls,
    CASE c_mktsegment WHEN 'BUILDING' THEN ' ' || c_nationkey || ' '
         WHEN 'MACHINERY' THEN c_nationkey || '.0' ELSE CAST(c_nationkey AS VARCHAR) END AS capacity,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN '' ELSE CAST(c_nationkey + 1950 AS VARCHAR) END AS yearEstablished,
    CASE WHEN c_mktsegment = 'FURNITURE' THEN '1e3' ELSE '7' END AS numberDoctors,
    ' ' || c_mktsegment || '   town' AS address_city,
    replace(n_name, '_', '   ') AS address_stateOrRegion,
    CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN ' ' ELSE ' ' || c_custkey END AS address_zipOrPostcode,
    CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN c_acctbal / 100.0e0 END AS latitude,
    c_nationkey * 4.0e0 AS longitude,
    CAST(n_regionkey AS VARCHAR) AS social,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'TRUE' WHEN 'MACHINERY' THEN NULL ELSE 'false' END AS staff,
    CASE WHEN c_acctbal > 0 THEN 'true' ELSE 'no' END AS logo,
    c_custkey, c_mktsegment
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)
"""

POSTCODE = """
postcode_source AS (
  SELECT 'office ' || event_id AS officename, user_id AS pincode,
    CASE event_type WHEN 'purchase' THEN 'HO' WHEN 'signup' THEN 'po' WHEN 'click' THEN 'BO'
         ELSE event_type END AS officetype,
    '  zone  ' || json_extract_string(props, '$.k') AS district,
    CASE WHEN event_type = 'purchase' THEN ' nation ' || json_extract_string(props, '$.k') END AS statename,
    CASE WHEN value < 5 THEN 'NA' ELSE CAST(value AS VARCHAR) END AS latitude,
    CASE WHEN value < 5 THEN 'NA' ELSE '77.5' END AS longitude
  FROM events)
"""

PINCODE = POSTCODE.strip() + f""",
pincode AS (
  SELECT CAST(pincode AS VARCHAR) AS pincode, officename, officetype,
         {initcap('trim(district)')} AS district, {initcap('trim(statename)')} AS statename,
         TRY_CAST(nullif(latitude, 'NA') AS DOUBLE) AS latitude,
         TRY_CAST(nullif(longitude, 'NA') AS DOUBLE) AS longitude
  FROM postcode_source QUALIFY row_number() OVER (PARTITION BY postcode_source.pincode ORDER BY
    CASE upper(officetype) WHEN 'HO' THEN 1 WHEN 'PO' THEN 2 WHEN 'BO' THEN 3 ELSE 4 END,
    CASE WHEN latitude IS NOT NULL AND latitude <> 'NA' THEN 0 ELSE 1 END, officename) = 1)
"""

FACILITY = SOURCE.strip() + ",\n" + PINCODE.strip() + f""",
canonical AS (SELECT CASE WHEN n_regionkey <= 2 THEN '' ELSE 'Greater ' END || {initcap("replace(n_name, '_', ' ')")} AS state
  FROM nation),
cleaned AS (
  SELECT unique_id AS facility_id, trim(name) AS name, lower(nullif(trim(organization_type), '')) AS organization_type,
    lower(nullif(trim(facilityTypeId), '')) AS facility_type,
    lower(nullif(trim(operatorTypeId), '')) AS operator_type, description,
    {json_list('specialties')} AS specialties, {json_list('procedure')} AS procedures,
    {json_list('equipment')} AS equipment, {json_list('capability')} AS capabilities,
    {json_list('source_urls')} AS source_urls,
    {try_int('capacity')} AS capacity, {try_int('yearEstablished')} AS year_established,
    {try_int('numberDoctors')} AS number_doctors,
    {normalized('address_stateOrRegion')} AS state_raw, {normalized('address_city')} AS city,
    nullif(trim(address_zipOrPostcode), '') AS pincode,
    CAST(NULL AS VARCHAR) AS address_line1, CAST(NULL AS VARCHAR) AS address_line2,
    CAST(NULL AS VARCHAR) AS address_line3, 'Country' AS address_country, 'CC' AS address_country_code,
    latitude, longitude, latitude BETWEEN 6 AND 37 AND longitude BETWEEN 68 AND 98 AS has_valid_coords,
    '2024' AS recency_of_page_update, {try_int('social')} AS social_media_presence_count,
    lower(staff) = 'true' AS has_affiliated_staff, lower(logo) = 'true' AS has_custom_logo,
    CAST(c_custkey AS INTEGER) AS facts_count, CAST(NULL AS VARCHAR) AS official_phone,
    CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS official_website,
    unique_id AS source_content_id, c_mktsegment AS cluster_id
  FROM facility_source),
facility AS (
  SELECT c.*, p.district AS district_raw, p.district AS district,
    coalesce(p.statename, CASE WHEN c.state_raw IN (SELECT state FROM canonical) THEN c.state_raw END) AS state,
    CASE WHEN p.statename IS NOT NULL THEN 'pincode'
         WHEN c.state_raw IN (SELECT state FROM canonical) THEN 'source' ELSE 'unresolved' END AS state_source
  FROM cleaned c LEFT JOIN pincode p ON c.pincode = p.pincode)
"""

DISTRICT = f"""
per_customer AS (
  SELECT o_custkey AS c_custkey, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f,
    count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u,
    count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS l FROM orders GROUP BY 1),
district_source AS (
  SELECT ' ' || lower(c_mktsegment) || '  area ' AS district_name, replace(n_name, '_', '  ') AS state_ut,
    round(100.0e0 * sum(f) / sum(n), 4) AS women_age_15_49_who_are_literate_pct,
    round(100.0e0 * sum(u) / sum(n), 4) AS hh_member_covered_health_insurance_pct,
    round(100.0e0 * sum(l) / sum(n), 4) AS institutional_birth_5y_pct,
    round(CAST(coalesce(sum(n), 0) AS DOUBLE) / count(*), 4) AS births_delivered_by_csection_5y_pct
  FROM customer LEFT JOIN per_customer USING (c_custkey) LEFT JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2),
district AS (
  SELECT {normalized('district_name')} AS district, {normalized('state_ut')} AS state, *
  FROM district_source)
"""

VERDICT = """
verdict AS (
  SELECT json_extract_string(props, '$.k') AS facility_id,
    CASE WHEN event_type <> 'view' THEN 'claim ' || json_extract_string(props, '$.k') END AS claim_id,
    'planner ' || user_id AS planner_id,
    CASE event_type WHEN 'purchase' THEN 'verified' WHEN 'error' THEN 'rejected'
         WHEN 'click' THEN 'clicked' ELSE 'needs_info' END AS status,
    event_type AS reason, CAST(value AS VARCHAR) AS notes, ts AS created_at, event_id AS seq
  FROM events),
valid AS (
  SELECT * FROM verdict WHERE facility_id IS NOT NULL AND claim_id IS NOT NULL
    AND planner_id IS NOT NULL AND status IN ('verified', 'rejected', 'needs_info')),
latest AS (
  SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY facility_id, claim_id, planner_id
    ORDER BY created_at DESC, seq DESC) = 1)
"""

SCENARIO = """
scenario AS (
  SELECT CAST(doc_id AS VARCHAR) AS facility_id, 'common' AS claim_value,
    CASE WHEN toxic = 1 THEN 'contradicted' WHEN quality = 1 THEN 'verified' ELSE 'unclear' END AS expected_status,
    'quality ' || quality || ' toxic ' || toxic AS rationale
  FROM labels),
predicted AS (
  SELECT s.*, coalesce(t.status, 'absent') AS predicted_status,
    round(coalesce(t.trust_score, 0.0e0), 2) AS trust,
    coalesce(t.supporting_evidence_count, 0) AS supports,
    coalesce(t.contradicting_evidence_count, 0) AS contradicts,
    coalesce(t.claim_count, 0) AS claim_count
  FROM scenario s LEFT JOIN trust t ON t.facility_id = s.facility_id AND t.capability = s.claim_value)
"""
