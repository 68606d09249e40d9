"""Receiving rules over parts as objects: each object is sound but for one change, and the SQL says literally what that change must lead to."""

import json
from functools import reduce

from pyspark.sql import functions as F

from ..operators import contract as K
from ..sources.views import table
from .base import Plans

P = Plans()
_PLACED = {"crs": "c", "crs_status": K.CRS_VERIFIED, "horizontal_unit": "m", "vertical_domain": "depth", "vertical_unit": "m", "vertical_reference": "msl"}
_GRID = {"dimensions": [2, 3], "origin_xy": [0, 0], "i_basis": [1, 0], "j_basis": [0, 1], "index_order": "i_major_j_minor"}
_NODES = {"parent_entity_key": "", "method": "m", "count": 6, "validated": True}
_ON_WELL = {"md_unit": "m", "md_reference": "kb"}
_VALUED = {"unit": "API", "unit_status": K.UNIT_PROFILE}
_PROOF = {"source_role": "r", "reference_validation": "v"}
_TRACK = {"station_order": "stored", "md_source": "stored_measured_depth", "vertical_reference": "msl", "full_track": True}
_POLYGON = {"parts": "p", "vertex_order": "o", "ring_roles": "r", "attribute_binding": "b"}
_HEAD = {"xyz_roles": "x", "vertical_reference": "msl", "source_locator": "l"}
_NULLS = {"representation": "nan", "source_rule": "r"}
#: What a sound object of each category says.
_GOOD = {
    "well": _PLACED | {"well_identity": "w", "head_semantics": _HEAD},
    "well_log": _VALUED | _ON_WELL | {"log_kind": "continuous_scalar", "index_kind": "measured_depth", "sampling_kind": "point_samples", "index_shape": "scalar_1d", "value_shape": "scalar_1d", "null_semantics": _NULLS},
    "trajectory": _PLACED | _ON_WELL | {"track_semantics": _TRACK},
    "marker": _ON_WELL | {"marker_semantics": _PROOF},
    "checkshot": _ON_WELL | {"checkshot_semantics": _PROOF, "time_convention": "TWT", "vertical_reference": "msl"},
    "culture_polygon": _PLACED | {"polygon_topology": _POLYGON},
    "surface_geometry": _PLACED | {"surface_role": "horizon_geometry", "grid_registration": _GRID},
    "surface_property": _PLACED | _VALUED | {"surface_role": "mapped_property", "grid_registration": _GRID, "node_registration": _NODES},
}
_CATEGORIES = tuple(_GOOD)
_ROUTES = tuple(c for c in _CATEGORIES if c != "marker")
_SOUND, _META, _LINK, _UNSUPPORTED = "qualified_for_planned_mapping", "blocked_metadata", "blocked_relationship", "unsupported_target_mapping"
#: Changes of what is said (null: not said; a list: several values), of the decision (keys with an at sign) or of links, with the codes and the state they lead to. A category has them in turn.
_ANY = (
    ({}, "", _SOUND), ({"@target_version": "2"}, "TARGET_PROFILE_DECISION_REQUIRED", _META), ({"@target_object_id": "unknown"}, "TARGET_OBJECT_DECISION_REQUIRED", _META),
    ({"@target_object_id": None}, "TARGET_OBJECT_DECISION_REQUIRED", _META),
)
_ANY_PLACED = (
    ({"crs": None}, "CRS_UNRESOLVED", _META), ({"crs": ["c", "d"]}, "CONFLICTING_CRS", _META), ({"crs_status": "candidate"}, "CRS_EVIDENCE_UNVALIDATED", _META),
    ({"crs_status": "candidate", "@assert": {"crs": "c"}}, "", _SOUND), ({"@assert": {"crs": "d"}}, "SOURCE_DECISION_CONFLICT", _META), ({"horizontal_unit": "Unknown"}, "HORIZONTAL_UNIT_UNRESOLVED", _META),
    ({"horizontal_unit": None, "@assert": {"horizontal_unit": "m"}}, "", _SOUND), ({"vertical_unit": None}, "VERTICAL_UNIT_UNRESOLVED", _META), ({"vertical_reference": None}, "VERTICAL_REFERENCE_UNRESOLVED", _META),
)
_ANY_ON_WELL = (
    ({"md_unit": None}, "MD_UNIT_UNRESOLVED", _META), ({"md_reference": ["a", "b"]}, "CONFLICTING_MD_REFERENCE", _META), ({"link": "candidate"}, "RELATIONSHIP_UNRESOLVED,WELL_TARGET_BINDING_UNRESOLVED", _LINK),
    ({"link": None}, "RELATIONSHIP_UNRESOLVED,WELL_TARGET_BINDING_UNRESOLVED", _LINK), ({"link": "twice"}, "RELATIONSHIP_UNRESOLVED,WELL_TARGET_BINDING_UNRESOLVED", _LINK),
    ({"@well_target_key": "other"}, "WELL_TARGET_BINDING_UNRESOLVED", _LINK), ({"@well_target_state": "planned"}, "TARGET_DEPENDENCY_CREATION_UNSUPPORTED", _UNSUPPORTED),
    ({"@well_target_state": "gone"}, "WELL_TARGET_BINDING_UNRESOLVED", _LINK),
)
_ANY_SURFACE = (
    ({"surface_role": "other"}, "SURFACE_VALUE_ROLE_UNRESOLVED", _META), ({"@survey": {"crs": "d"}}, "SURVEY_CONTEXT_CONFLICT", _META), ({"@survey": {"target_id": None}}, "SURVEY_DECISION_REQUIRED", _META),
    ({"@survey": {"crs": "d"}, "@derived": True}, "SURVEY_CONTEXT_CONFLICT", "requires_derived_mapping"), ({"@survey": {"grid_registration": "{}"}}, "SURVEY_LATTICE_MISMATCH", _META),
    ({"@survey": {"grid_registration": "{}"}, "@derived": True}, "SURVEY_LATTICE_MISMATCH", "requires_derived_mapping"), ({"@derived": True}, "", "requires_derived_mapping"),
)


def _timed(**more):
    return {"vertical_domain": "time", "vertical_reference": None} | more


_CHANGES = {
    "well": (*_ANY, *_ANY_PLACED, ({"well_identity": None}, "WELL_IDENTITY_UNRESOLVED", _META), ({"head_semantics": _HEAD | {"xyz_roles": None}}, "HEAD_SEMANTICS_UNRESOLVED", _META),
             (_timed(), "TIME_CONVENTION_UNRESOLVED", _META), (_timed(time_convention="OWT"), "", _SOUND), ({"vertical_domain": "other"}, "VERTICAL_DOMAIN_UNRESOLVED", _META)),
    "well_log": (*_ANY, *_ANY_ON_WELL, ({"unit": None}, "STORED_VALUE_UNIT_UNRESOLVED", _META), ({"unit_status": None}, "STORED_UNIT_PROFILE_UNVALIDATED", _META), ({"unit": ["a", "b"]}, "CONFLICTING_UNIT", _META),
                 ({"log_kind": "discrete"}, "LOG_KIND_UNSUPPORTED", _UNSUPPORTED), ({"index_kind": "time"}, "LOG_INDEX_SEMANTICS_UNRESOLVED", _META), ({"sampling_kind": None}, "LOG_INTERVAL_SEMANTICS_UNRESOLVED", _META),
                 ({"index_shape": None}, "LOG_INDEX_SHAPE_UNRESOLVED", _META), ({"index_shape": "matrix"}, "LOG_INDEX_SHAPE_UNSUPPORTED", _UNSUPPORTED), ({"value_shape": None}, "LOG_VALUE_SHAPE_UNRESOLVED", _META),
                 ({"value_shape": "matrix"}, "LOG_VALUE_SHAPE_UNSUPPORTED", _UNSUPPORTED), ({"curve_kind": "discrete"}, "LOG_SOURCE_SEMANTICS_CONFLICT", _META), ({"curve_kind": "continuous_scalar"}, "", _SOUND),
                 ({"interval_records": "true"}, "LOG_SOURCE_SEMANTICS_CONFLICT", _META), ({"null_semantics": _NULLS | {"source_rule": None}}, "NULL_SEMANTICS_UNRESOLVED", _META)),
    "trajectory": (*_ANY, *_ANY_PLACED, *_ANY_ON_WELL, ({"track_semantics": _TRACK | {"full_track": False}}, "TRACK_SEMANTICS_UNRESOLVED", _META), ({"track_semantics": _TRACK | {"full_track": "true"}}, "TRACK_SEMANTICS_UNRESOLVED", _META),
                   ({"track_semantics": _TRACK | {"md_source": "derived"}}, "TRACK_SEMANTICS_UNRESOLVED", _META), ({"track_semantics": None}, "TRACK_SEMANTICS_UNRESOLVED", _META)),
    "marker": (({}, "TARGET_MAPPING_UNSUPPORTED", _UNSUPPORTED), ({"marker_semantics": _PROOF | {"source_role": None}}, "MARKER_SEMANTICS_UNRESOLVED,TARGET_MAPPING_UNSUPPORTED", _UNSUPPORTED)),
    "checkshot": (*_ANY, *_ANY_ON_WELL, ({"checkshot_semantics": None}, "CHECKSHOT_SEMANTICS_UNRESOLVED", _META), ({"time_convention": "unknown"}, "TIME_CONVENTION_UNRESOLVED", _META), ({"vertical_reference": None}, "VERTICAL_REFERENCE_UNRESOLVED", _META)),
    "culture_polygon": (*_ANY, *_ANY_PLACED, ({"polygon_topology": _POLYGON | {"ring_roles": None}}, "POLYGON_TOPOLOGY_UNRESOLVED", _META)),
    "surface_geometry": (*_ANY, *_ANY_SURFACE, *(({"grid_registration": _GRID | c, "@survey": {"grid_registration": json.dumps(_GRID | c)}}, "GRID_REGISTRATION_UNRESOLVED", _LINK)
                         for c in ({"dimensions": [2, 0]}, {"dimensions": ["2", 3]}, {"origin_xy": [0]}, {"j_basis": [2, 0]}, {"index_order": "other"}))),
    "surface_property": (*_ANY, *_ANY_SURFACE, *(({"node_registration": _NODES | c}, "NODE_REGISTRATION_UNVERIFIED", _LINK) for c in ({"count": 5}, {"validated": "true"}, {"method": None}, {"parent_entity_key": "else"})),
                         ({"link": None}, "NODE_MASK_UNAVAILABLE,NODE_REGISTRATION_UNVERIFIED,PARENT_GEOMETRY_UNRESOLVED,RELATIONSHIP_UNRESOLVED", _LINK), ({"unit": None}, "STORED_VALUE_UNIT_UNRESOLVED", _META)),
}
_SURVEY = {"target_id": "s", "crs": "c", "horizontal_unit": "m", "vertical_domain": "depth", "vertical_unit": "m", "vertical_reference": "msl", "grid_registration": json.dumps(_GRID)}
#: Numbers of changes that a category has room for; it has the first again after its last.
_ROOM = max(map(len, _CHANGES.values()))
_CASES = [(c, k, *_CHANGES[c][k % len(_CHANGES[c])]) for c in _CATEGORIES for k in range(_ROOM)]


def _text(v):
    return v if isinstance(v, str) else json.dumps(v)


def _spec(spark):
    """(category, change) to what is said and decided: a row for each of the fixed cases."""
    rows = []
    for category, change, changes, _, _ in _CASES:
        said = _GOOD[category] | {f: v for f, v in changes.items() if f != "link" and f[0] != "@"}
        said = [(f, _text(x)) for f, v in said.items() if v is not None for x in (v if isinstance(v, list) else [v])]
        told = {"target_version": "1", "target_object_id": "o", "well_target_state": "existing", "well_target_key": "", "derived": False} | {k[1:]: v for k, v in changes.items() if k[0] == "@" and k not in ("@assert", "@survey")}
        survey = {k: v for k, v in (_SURVEY | changes.get("@survey", {})).items() if v is not None}
        rows.append((category, change, said, changes.get("link", K.EXACT), changes.get("@assert"), survey, *(told[k] for k in ("target_version", "target_object_id", "well_target_state", "well_target_key", "derived"))))
    schema = "category string, change int, said array<struct<field: string, raw_value: string>>, link string, assertions map<string,string>, survey map<string,string>, target_version string, target_object_id string, well_target_state string, well_target_key string, derived boolean"
    return spark.createDataFrame(rows, schema)


#: Categories that no payload is known of, whatever else holds.
_NO_PAYLOAD = ("marker", "checkshot")


def _literal(category, change, codes, state):
    if category in _NO_PAYLOAD:
        codes, state = ",".join(sorted(["NO_AVAILABLE_ACCEPTED_FULL_PAYLOAD", *filter(None, codes.split(","))])), "blocked_missing_payload"
    return f"('{category}', {change}, '{codes}', '{state}')"


_LITERAL = ", ".join(_literal(c, k, codes, state) for c, k, _, codes, state in _CASES)


@P.query(f"""WITH p AS (SELECT p_partkey AS k, {list(_CATEGORIES)!r}[1 + p_partkey % {len(_CATEGORIES)}] AS category, CAST((p_partkey // {len(_CATEGORIES)}) % {_ROOM} AS INT) AS change FROM part),
v(category, change, codes, receiving_state) AS (VALUES {_LITERAL})
SELECT 'E' || k AS entity_key, category, receiving_state, codes FROM p JOIN v USING (category, change)""")
def receiving_mapping(spark, d):
    """Whether each object can be mapped to a receiver, and what speaks against it."""
    n = len(_CATEGORIES)
    k = F.col("p_partkey")
    parts = table(spark, d, "part").select(k.alias("k"), F.element_at(F.array(*map(F.lit, _CATEGORIES)), (k % n + 1).cast("int")).alias("category"), (F.floor(k / n) % _ROOM).cast("int").alias("change"))
    key = lambda c: F.concat(F.lit("E"), c.cast("string"))
    own = parts.join(F.broadcast(_spec(spark)), ["category", "change"]).withColumn("entity_key", key(F.col("k")))  # as many rows as there are fixed cases
    entities = own.select("entity_key", "category", F.lit("decoded").alias("source_status"), F.lit(None).cast("string").alias("materialization_status"))
    roles = F.create_map(*(F.lit(x) for pair in K.FULL_ROLES.items() for x in pair))
    role = F.explode(F.array(F.coalesce(roles[F.col("category")], F.lit("data")), F.lit("node_mask")))
    none, sha = F.lit(None).cast("string"), F.sha2("entity_key", 256)
    artifacts = own.select(F.concat("entity_key", F.lit("/"), F.monotonically_increasing_id()).alias("artifact_key"), "entity_key", role.alias("role"), sha.alias("sha")).select(
        "artifact_key", "entity_key", "role", F.lit("files").alias("index_section"), F.lit("exported").alias("original_status"), F.lit("exact_readback").alias("numerical_qc"),
        F.col("sha").alias("recorded_sha256"), F.col("sha").alias("current_sha256"), F.lit(5).cast("long").alias("expected_bytes"), F.lit(5).cast("long").alias("current_bytes"), none.alias("retention"),
    )
    on_well = F.col("category").isin("well_log", "marker", "checkshot", "trajectory")
    target = F.when(on_well, F.col("k") - F.col("k") % n + 0).when(F.col("category") == "surface_property", F.col("k") - 1)
    linked = own.where("link is not null").withColumn("target", target).where("target is not null")
    relation = F.when(on_well, "source_well").otherwise("native_parent")
    status = F.when(F.col("link") == "twice", K.EXACT).otherwise(F.col("link"))
    one = linked.select(F.col("entity_key").alias("source_key"), key(F.col("target")).alias("target_key"), relation.alias("relation"), status.alias("status"))
    second = linked.where("link = 'twice'").select(F.col("entity_key").alias("source_key"), key(F.col("target") + n).alias("target_key"), relation.alias("relation"), F.lit(K.EXACT).alias("status"))
    said = own.select("entity_key", "k", F.explode("said").alias("s")).select("entity_key", F.col("s.field").alias("field"), F.col("s.raw_value").alias("raw_value"), "k")
    parent = F.regexp_replace("raw_value", '"parent_entity_key": ""', F.concat(F.lit('"parent_entity_key": "'), key(F.col("k") - 1), F.lit('"')))
    evidence = said.select("entity_key", "field", F.when(F.col("field") == "node_registration", parent).otherwise(F.col("raw_value")).alias("raw_value"))
    well = F.when(F.col("well_target_key") == "", key(target)).otherwise(F.col("well_target_key"))
    decisions = own.select(
        "entity_key", "target_version", none.alias("target_api_version"), "target_object_id", well.alias("well_target_key"), F.lit("t").alias("well_target_id"), "well_target_state",
        none.alias("reference_volume_key"), "assertions", "survey", "derived",
    )
    facts = K.facts_of(entities, artifacts, reduce(lambda a, b: a.unionByName(b), [one, second]), evidence)
    return K.mapped(facts, decisions, K.Receiver("1", None, _ROUTES, existing_wells_only=True, needs_lattice=True))
