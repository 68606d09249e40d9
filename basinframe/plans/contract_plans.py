"""Assessment of a catalogue whose five tables are drawn from the star schema.

The drawing is text that both engines read; what the rules make of it is written twice.
"""

from ..functions.exprs import UNKNOWN_TOKENS
from ..operators import contract as K
from ..sources import views as V
from .base import Plans

P = Plans()
_KINDS = ("surface_geometry", "surface_property", "qa_scalar", "seismic", "well_log", "trajectory", "well", "culture_polygon", "culture_point", "folder")
_CATEGORY = "CASE k % 10 " + " ".join(f"WHEN {n} THEN '{c}'" for n, c in enumerate(_KINDS)) + " END"
_FULL = "CASE k % 10 " + " ".join(f"WHEN {n} THEN '{K.FULL_ROLES[c]}'" for n, c in enumerate(_KINDS) if c in K.FULL_ROLES) + " ELSE 'data' END"
_TEXT = "CAST(k AS VARCHAR(20))"

#: Columns of ``part`` (k, p_size) and ``lineitem`` (k and the rest).
_ENTITIES = f"SELECT 'E' || {_TEXT} AS entity_key, {_CATEGORY} AS category, CASE WHEN p_size % 9 = 0 THEN 'failed' ELSE 'decoded' END AS source_status, CASE WHEN p_size % 2 = 0 THEN 'converted' END AS materialization_status FROM parts"
_ARTIFACTS = f"""SELECT l_orderkey * 10 + l_linenumber AS artifact_key, 'E' || {_TEXT} AS entity_key,
  CASE l_linenumber WHEN 4 THEN 'node_mask' WHEN 3 THEN 'preview' ELSE {_FULL} END AS role,
  CASE WHEN l_discount < 0.005 THEN 'checkpoint' ELSE 'files' END AS index_section, CASE WHEN l_tax > 0.075 THEN 'failed' ELSE 'exported' END AS original_status,
  CASE WHEN l_suppkey % 8 = 0 THEN 'none' ELSE 'exact_readback' END AS numerical_qc,
  CASE WHEN l_suppkey % 13 <> 0 THEN md5(CAST(l_orderkey AS VARCHAR(20))) || md5(CAST(l_orderkey AS VARCHAR(20))) END AS recorded_sha256,
  CASE WHEN l_orderkey % 17 = 0 THEN 'other' WHEN l_orderkey % 5 = 0 THEN NULL ELSE md5(CAST(l_orderkey AS VARCHAR(20))) || md5(CAST(l_orderkey AS VARCHAR(20))) END AS current_sha256,
  l_orderkey AS expected_bytes, CASE WHEN l_orderkey % 23 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN l_orderkey + 1 ELSE l_orderkey END AS current_bytes,
  CASE k % 29 WHEN 0 THEN 'pruned' WHEN 1 THEN 'external_reference' WHEN 2 THEN 'retained' END AS retention FROM items WHERE l_quantity > 44"""


def _links(relation: str, where: str, target: str) -> str:
    return f"SELECT 'E' || {_TEXT} AS source_key, 'E' || CAST({target} AS VARCHAR(20)) AS target_key, '{relation}' AS relation, CASE WHEN k % 11 = 0 THEN 'candidate' ELSE '{K.EXACT}' END AS status FROM parts WHERE {where}"


_RELATIONSHIPS = " UNION ALL ".join(
    (
        _links("native_parent", "k % 10 = 1", "CASE WHEN k % 7 = 0 THEN k + 1 ELSE k - 1 END"),
        _links("native_parent", "k % 10 = 1 AND k % 13 = 0", "k - 1"),
        _links("source_well", "k % 10 = 4", "k + 2"),
        _links("source_well", "k % 10 = 4 AND k % 16 = 0", "k + 12"),
        _links("source_well", "k % 10 = 5", "k + 1"),
        _links("trajectory_provider", "k % 10 = 4", "k + 1"),
        _links("materialized_payload", "k % 40 = 3", "k + 10"),
        _links("materialized_payload", "k % 40 = 13", "k - 10"),
        _links("materialized_payload", "k % 40 = 23", "k - 10"),
    )
)


def _said(field: str, where: str, value: str) -> str:
    return f"SELECT 'E' || {_TEXT} AS entity_key, '{field}' AS field, {value} AS raw_value FROM parts WHERE {where}"


_PLAN = """'{"size":[2,3,4],"native_axis":{"count":' || CASE WHEN k % 70 = 3 THEN '5' ELSE '4' END || ',"origin":0,"increment":' || CASE WHEN k % 90 = 13 THEN '2' ELSE '4' END
  || '},"domain":"' || CASE k % 60 WHEN 23 THEN 'other' WHEN 33 THEN 'depth' ELSE 'time' END || '","source_vertical_unit":"' || CASE WHEN k % 80 = 43 THEN 'unknown' ELSE 'ms' END
  || '","horizontal_unit":"m","crs_verified":' || CASE WHEN k % 30 = 13 THEN 'false' ELSE 'true' END || ',"segy_header_profile":"p","time_convention":"' || CASE WHEN k % 50 = 3 THEN '' ELSE 'TWT' END || '"}'"""
_GRID = """'{"dimensions":[3,4]}'"""
_NODES = f"""'{{"validated":true,"parent_entity_key":"E' || CAST(k - 1 AS VARCHAR(20)) || '","count":' || CASE WHEN k % 50 = 31 THEN '11' ELSE '12' END || '}}'"""
_EVIDENCE = " UNION ALL ".join(
    (
        _said("unit", "k % 6 <> 0", "CASE WHEN k % 5 = 0 THEN 'ft' ELSE 'm' END"),
        _said("unit", "k % 12 = 1", "'km'"),
        _said("unit", "k % 12 = 2", "'Unknown'"),
        _said("unit_status", "k % 4 <> 0", f"'{K.UNIT_PROFILE}'"),
        _said("unit_status", "k % 28 = 5", "'unknown'"),
        _said("crs_status", "k % 9 <> 0", f"'{K.CRS_VERIFIED}'"),
        _said("depth_unit", "k % 8 <> 0", "'m'"),
        _said("horizontal_unit", "k % 14 <> 0", "CASE WHEN k % 3 = 0 THEN NULL ELSE 'm' END"),
        _said("index_declared_units", "k % 3 = 0", "CASE WHEN k % 15 = 0 THEN 'm' WHEN k % 5 = 0 THEN 'ft' ELSE 'm' END"),
        _said("measurement", "k % 31 = 0", "'a'"),
        _said("measurement", "k % 62 = 0", "'b'"),
        _said("missing_vertex_slots", "k % 10 IN (7, 8)", "CASE WHEN k % 4 = 0 THEN '3' ELSE '0' END"),
        _said("seismic_conversion", "k % 10 = 3", _PLAN),
        _said("seismic_conversion", "k % 110 = 3", _PLAN),
        _said("seismic_source", "k % 10 = 3", """'{"size":[2,3,4],"zstart":0,"zinc":4}'"""),
        _said("conversion_qc", "k % 10 = 3", """'{"all_decoded_samples_exact":true,"headers_verified":' || CASE WHEN k % 20 = 3 THEN 'true' ELSE 'false' END || '}'"""),
        _said("grid_registration", "k % 10 = 1", _GRID),
        _said("node_registration", "k % 10 = 1", _NODES),
    )
)
_BINDINGS = f"SELECT 'E' || {_TEXT} AS entity_key, CASE WHEN k % 10 = 3 THEN 'metadata' ELSE 'head' END AS kind, 'x' AS bound_sha256, CASE WHEN k % 26 = 0 THEN 'y' WHEN k % 26 = 13 THEN NULL ELSE 'x' END AS current_sha256 FROM parts WHERE k % 2 = 0 OR k % 10 = 3"


def _tables(spark, d):
    p, items = V.table(spark, d, "part"), V.table(spark, d, "lineitem")
    given = {"parts": p.selectExpr("p_partkey AS k", "p_size"), "items": items.withColumnRenamed("l_partkey", "k")}
    made = []
    for text in (_ENTITIES, _ARTIFACTS, _RELATIONSHIPS, _EVIDENCE, _BINDINGS):
        name = "items" if "FROM items" in text else "parts"
        text = text.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}")
        made.append(spark.sql(text, **{name: given[name]}))
    return made


_SQL_TABLES = f"""parts AS (SELECT p_partkey AS k, p_size FROM part), items AS (SELECT * RENAME (l_partkey AS k) FROM lineitem),
n AS ({_ENTITIES}), a AS ({_ARTIFACTS}), r AS ({_RELATIONSHIPS}), e AS ({_EVIDENCE}), b AS ({_BINDINGS}),
s AS (SELECT *, coalesce(current_bytes = expected_bytes, false) AS same, coalesce(retention, 'none') AS held, coalesce(current_sha256 <> recorded_sha256, false) AS bad,
  index_section = 'files' AND original_status = 'exported' AS accepted FROM a),
t AS (SELECT *, same AND held NOT IN ('pruned', 'unavailable', 'external_reference') AND NOT bad AS available FROM s)"""


@P.query(f"""WITH {_SQL_TABLES}
SELECT artifact_key, available, array_to_string(list_sort(list_filter([
  CASE WHEN (held = 'pruned' AND current_bytes IS NOT NULL) OR (held = 'retained' AND NOT same) THEN 'RETENTION_STATE_CONFLICT' END,
  CASE WHEN same AND held NOT IN ('pruned', 'unavailable', 'external_reference') AND bad THEN 'HASH_MISMATCH' END, CASE WHEN NOT available THEN 'ARTIFACT_UNAVAILABLE' END,
  CASE WHEN NOT available THEN CASE WHEN held = 'pruned' THEN 'ARTIFACT_PRUNED' WHEN held = 'external_reference' THEN 'ARTIFACT_EXTERNAL_REFERENCE' WHEN current_bytes IS NOT NULL AND NOT same THEN 'ARTIFACT_SIZE_MISMATCH' END END,
  CASE WHEN NOT accepted THEN 'PARTIAL_ARTIFACT' END], lambda x: x IS NOT NULL)), ',') AS codes FROM t""")
def artifact_states(spark, d):
    """Whether each artifact can be taken now, and what speaks against it."""
    out = K.artifact_states(_tables(spark, d)[1])
    return out.selectExpr("artifact_key", "available", "array_join(codes, ',') AS codes")


_KNOWN = f"""(raw_value IS NOT NULL AND lower(trim(raw_value)) NOT IN ({", ".join(f"'{x}'" for x in UNKNOWN_TOKENS)}))"""


def _one(field):
    """The one known value of a field of each entity, in SQL."""
    return f"(SELECT CASE WHEN count(DISTINCT raw_value) = 1 THEN min(raw_value) END FROM e WHERE e.entity_key = n.entity_key AND field = '{field}' AND {_KNOWN})"


def _all_say(field, value):
    return f"coalesce((SELECT bool_and(coalesce(raw_value = '{value}', false)) FROM e WHERE e.entity_key = n.entity_key AND field = '{field}'), false)"


def _has(field):
    return f"EXISTS (SELECT 1 FROM e WHERE e.entity_key = n.entity_key AND field = '{field}')"


def _code(code, condition):
    return f"SELECT entity_key, '{code}' AS code FROM f WHERE {condition}"


_BOUND = "category = 'seismic' AND plans = 1 AND sources = 1"
_PLACED = "('surface_geometry', 'surface_property', 'qa_scalar', 'well', 'trajectory', 'well_log', 'culture_point', 'culture_polygon')"
_RULES = " UNION ".join(
    (
        _code("HEAD_METADATA_STALE", "stale_head"),
        _code("SEISMIC_METADATA_STALE", "category = 'seismic' AND stale_metadata"),
        _code("NO_AVAILABLE_ACCEPTED_FULL_PAYLOAD", "NOT has_full"),
        _code("SOURCE_RECOVERY_NOT_COMPLETE", "source_status = 'failed' AND NOT (category = 'seismic' AND coalesce(materialization_status, '') = 'converted')"),
        _code("PARTIAL_PUBLICATION_PRESENT", "has_partial"),
        _code("NUMERICAL_QC_UNVALIDATED", "has_unchecked"),
        _code("RECORDED_PAYLOAD_IDENTITY_MISSING", "has_unhashed"),
        _code("CONFLICTING_UNIT", "units > 1"),
        _code("CONFLICTING_MEASUREMENT", "measurements > 1"),
        _code("CONFLICTING_UNIT_DECLARATION", "len(unit_set) > 0 AND len(declared_set) > 0 AND unit_set <> declared_set"),
        _code("UNRESOLVED_VALUE_UNIT", "category IN ('surface_geometry', 'surface_property', 'qa_scalar', 'well_log') AND (units <> 1 OR NOT unit_ok)"),
        _code("UNRESOLVED_CRS", f"category IN {_PLACED} AND NOT crs_ok"),
        _code("SEISMIC_METADATA_UNBOUND", "category = 'seismic' AND (plans <> 1 OR sources <> 1)"),
        _code("SEISMIC_GEOMETRY_CONFLICT", f"{_BOUND} AND json_extract_string(plan, '$.native_axis.count') <> '4'"),
        _code("SEISMIC_AXIS_CONFLICT", f"{_BOUND} AND json_extract_string(plan, '$.native_axis.increment') <> '4'"),
        _code("SEISMIC_DOMAIN_UNRESOLVED", f"{_BOUND} AND json_extract_string(plan, '$.domain') = 'other'"),
        _code("VERTICAL_UNIT_UNRESOLVED", f"{_BOUND} AND json_extract_string(plan, '$.source_vertical_unit') = 'unknown'"),
        _code("UNRESOLVED_CRS", f"{_BOUND} AND json_extract_string(plan, '$.crs_verified') = 'false'"),
        _code("TIME_CONVENTION_UNRESOLVED", f"{_BOUND} AND json_extract_string(plan, '$.domain') = 'time' AND json_extract_string(plan, '$.time_convention') = ''"),
        _code("VERTICAL_REFERENCE_UNRESOLVED", f"{_BOUND} AND json_extract_string(plan, '$.domain') = 'depth'"),
        _code("SEISMIC_NUMERICAL_QC_UNVALIDATED", "category = 'seismic' AND NOT exact_qc"),
        _code("PARENT_GEOMETRY_UNRESOLVED", "category = 'surface_property' AND coalesce(parent_category, '') <> 'surface_geometry'"),
        _code("NODE_REGISTRATION_UNVERIFIED", "category = 'surface_property' AND NOT (coalesce(parent_category, '') = 'surface_geometry' AND json_extract_string(nodes, '$.parent_entity_key') = parent AND json_extract_string(nodes, '$.count') = '12')"),
        _code("NODE_MASK_UNAVAILABLE", "category = 'surface_property' AND NOT (has_mask AND parent_mask)"),
        _code("NATIVE_VERTEX_GAPS_UNRESOLVED", "category IN ('culture_point', 'culture_polygon') AND vertex_gaps"),
        _code("SOURCE_WELL_UNRESOLVED", "category = 'well_log' AND NOT well_ok"),
        _code("VERTICAL_UNIT_UNRESOLVED", f"category IN {_PLACED} AND category <> 'qa_scalar' AND NOT has_depth_unit"),
        _code("HORIZONTAL_UNIT_UNRESOLVED", f"category IN {_PLACED} AND category NOT IN ('qa_scalar', 'well_log') AND NOT has_horizontal_unit"),
        _code("DEPENDENCY_CYCLE", "entity_key IN (SELECT source_key FROM behind)"),
        _code("REQUIRED_DEPENDENCY_UNAVAILABLE", "unfit"),
    )
)
_ROLE = "CASE category " + " ".join(f"WHEN '{c}' THEN '{r}'" for c, r in K.FULL_ROLES.items()) + " END"
_READY_KIND = "CASE relation " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in K.REQUIRED_KIND.items()) + " END"


@P.query(f"""WITH RECURSIVE {_SQL_TABLES},
g AS (SELECT n.*, {_ROLE} AS full_role FROM n),
m AS (SELECT g.entity_key, g.category,
  coalesce(bool_or(accepted AND available AND role = full_role), false) AND NOT coalesce(bool_or(accepted AND available AND role = full_role AND (numerical_qc <> 'exact_readback' OR recorded_sha256 IS NULL)), false) AS ready,
  coalesce(bool_or(accepted AND available AND role = 'node_mask'), false) AS mask, coalesce(bool_or(accepted AND available AND role = full_role), false) AS has_full,
  coalesce(bool_or(NOT accepted), false) AS has_partial, coalesce(bool_or(accepted AND role = full_role AND numerical_qc <> 'exact_readback'), false) AS has_unchecked,
  coalesce(bool_or(accepted AND available AND role = full_role AND recorded_sha256 IS NULL), false) AS has_unhashed FROM g LEFT JOIN t USING (entity_key) GROUP BY ALL),
l AS (SELECT r.*, m.category AS target_category, m.mask AS target_mask, coalesce(m.ready AND m.category = {_READY_KIND} AND status = '{K.EXACT}', false) AS fit FROM r LEFT JOIN m ON m.entity_key = r.target_key),
p AS (SELECT source_key, CASE WHEN count(DISTINCT target_key) FILTER (status = '{K.EXACT}') = 1 THEN min(target_key) FILTER (status = '{K.EXACT}') END AS parent FROM l WHERE relation = 'native_parent' GROUP BY source_key),
walks AS (SELECT source_key, target_key, 1 AS hops FROM r JOIN n ON n.entity_key = target_key WHERE status = '{K.EXACT}' AND relation <> 'native_parent'
  UNION SELECT w.source_key, r.target_key, hops + 1 FROM walks w JOIN r ON w.target_key = r.source_key AND status = '{K.EXACT}' AND relation <> 'native_parent' WHERE hops < 12),
behind AS (SELECT DISTINCT source_key FROM walks WHERE hops >= 12),
f AS (SELECT n.*, m.* EXCLUDE (entity_key, category),
  coalesce((SELECT bool_or(coalesce(current_sha256 <> bound_sha256, true)) FROM b WHERE b.entity_key = n.entity_key AND kind = 'head'), false) AS stale_head,
  coalesce((SELECT bool_or(coalesce(current_sha256 <> bound_sha256, true)) FROM b WHERE b.entity_key = n.entity_key AND kind = 'metadata'), false) AS stale_metadata,
  (SELECT count(DISTINCT raw_value) FROM e WHERE e.entity_key = n.entity_key AND field = 'unit' AND {_KNOWN}) AS units,
  (SELECT count(DISTINCT raw_value) FROM e WHERE e.entity_key = n.entity_key AND field = 'measurement' AND {_KNOWN}) AS measurements,
  coalesce((SELECT list(DISTINCT raw_value ORDER BY raw_value) FROM e WHERE e.entity_key = n.entity_key AND field = 'unit'), []) AS unit_set,
  coalesce((SELECT list(DISTINCT raw_value ORDER BY raw_value) FROM e WHERE e.entity_key = n.entity_key AND field = 'index_declared_units'), []) AS declared_set,
  {_all_say('unit_status', K.UNIT_PROFILE)} AS unit_ok, {_all_say('crs_status', K.CRS_VERIFIED)} AS crs_ok, {_has('depth_unit')} AS has_depth_unit, {_has('horizontal_unit')} AS has_horizontal_unit,
  (SELECT count(*) FROM e WHERE e.entity_key = n.entity_key AND field = 'seismic_conversion') AS plans, (SELECT count(*) FROM e WHERE e.entity_key = n.entity_key AND field = 'seismic_source') AS sources,
  CAST({_one('seismic_conversion')} AS JSON) AS plan, CAST({_one('node_registration')} AS JSON) AS nodes,
  coalesce({_one('conversion_qc')} LIKE '%"headers_verified":true%', false) AS exact_qc, coalesce({_one('missing_vertex_slots')} = '3', false) AS vertex_gaps,
  parent, (SELECT category FROM n AS o WHERE o.entity_key = parent) AS parent_category, m.mask AS has_mask, coalesce((SELECT mask FROM m AS o WHERE o.entity_key = parent), false) AS parent_mask,
  coalesce((SELECT count(DISTINCT target_key) = 1 AND bool_and(status = '{K.EXACT}') AND min(target_category) = 'well' FROM l WHERE l.source_key = n.entity_key AND relation = 'source_well'), false) AS well_ok,
  coalesce((SELECT bool_or(NOT fit) FROM l WHERE l.source_key = n.entity_key AND relation IN ('source_well', 'trajectory_provider', 'materialized_payload')), false) AS unfit
  FROM n JOIN m USING (entity_key) LEFT JOIN p ON p.source_key = n.entity_key),
c AS ({_RULES})
SELECT n.entity_key, category, CASE WHEN count(code) = 0 THEN 'source_prerequisites_satisfied' ELSE 'source_blocked' END AS source_state,
  coalesce(string_agg(code, ',' ORDER BY code), '') AS codes, CAST(count(code) AS INT) AS n_codes FROM n LEFT JOIN c USING (entity_key) GROUP BY n.entity_key, category""")
def contract_assessment(spark, d):
    """All source rules over each entity of the catalogue."""
    return K.assessed(K.facts_of(*_tables(spark, d)))
