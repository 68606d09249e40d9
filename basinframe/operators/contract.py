"""Assessment of a delivery catalogue: one table of rules over one row of facts for each entity.

Tables: ``entities`` (entity_key, category, source_status, materialization_status), ``artifacts`` (artifact_key, entity_key, role, index_section,
original_status, numerical_qc, recorded_sha256, current_sha256, expected_bytes, current_bytes, retention), ``relationships`` (source_key,
target_key, relation, status) and ``evidence`` (entity_key, field, raw_value). Artifacts, evidence and relationships are summed up for each entity
where they lie, so an entity with very many rows is one row of each task; the rules are then columns over the facts. Nothing is inferred: what
is not recorded, or recorded in two ways, blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import known
from .catalogue import levels

# Roles that make a full payload of a category, numerical checks that count, states that a recovery may end in, and
# what an index may say of itself.
FULL_ROLES = {
    "surface_geometry": "geometry_values", "surface_property": "property_values", "qa_scalar": "property_values", "seismic": "full_payload",
    "well_log": "data", "trajectory": "data", "well": "data", "culture_polygon": "data", "culture_point": "data",
}
RECORDED_QC = ("exact_readback", "every_amplitude_and_trace_geometry", "native_decoder; row-preserving split; count checked", "native_model_cross_checks")
RECOVERED = ("decoded", "converted", "definition_recovered", "missing_metadata")
FINAL_INDEX = ("delivery_indexed", "partial")
GONE = ("pruned", "unavailable", "external_reference")
DEPENDENCIES = ("source_well", "trajectory_provider", "materialized_payload", "preparation_dependency")
REQUIRED_KIND = {"source_well": "well", "trajectory_provider": "trajectory", "materialized_payload": "seismic"}
EXACT = "exact_id_reference"
UNIT_PROFILE, CRS_VERIFIED = "validated_metric_profile", "verified"

_SURFACES = ("surface_geometry", "surface_property", "qa_scalar")
_WELLS = ("well", "trajectory", "well_log")
_CULTURE = ("culture_point", "culture_polygon")


def artifact_states(artifacts: DataFrame) -> DataFrame:
    """``artifacts`` with ``available`` and ``codes``: why a current copy cannot be taken, or contradicts what is declared."""
    there, same = F.col("current_bytes").isNotNull(), F.coalesce(F.col("current_bytes") == F.col("expected_bytes"), F.lit(False))
    held = F.coalesce(F.col("retention"), F.lit("not_declared"))
    hashes = F.coalesce((F.col("current_sha256") != F.col("recorded_sha256")), F.lit(False))
    available = same & ~held.isin(*GONE)
    accepted = _true((F.col("index_section") == "files") & (F.col("original_status") == "exported"))
    gone = (
        F.when(held == "pruned", "ARTIFACT_PRUNED").when(held == "external_reference", "ARTIFACT_EXTERNAL_REFERENCE")
        .when(there & ~same, "ARTIFACT_SIZE_MISMATCH")
    )
    codes = F.array(
        F.when(((held == "pruned") & there) | ((held == "retained") & ~same), "RETENTION_STATE_CONFLICT"),
        F.when(available & hashes, "HASH_MISMATCH"),
        F.when(~available | hashes, "ARTIFACT_UNAVAILABLE"),
        F.when(~available | hashes, gone),
        F.when(~accepted, "PARTIAL_ARTIFACT"),
    )
    return artifacts.withColumn("available", available & ~hashes).withColumn("accepted", accepted).withColumn("codes", F.array_sort(F.array_compact(codes)))


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def payload_facts(entities: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(entity_key, category, ...) with counts of artifacts, and whether the full payload can be built on."""
    roles = F.create_map(*[F.lit(x) for pair in FULL_ROLES.items() for x in pair])
    rows = artifact_states(artifacts).join(entities.select("entity_key", "category"), "entity_key")
    full = F.col("accepted") & _true(F.col("role") == F.try_element_at(roles, F.col("category")))
    checked = _true(F.col("numerical_qc").isin(*RECORDED_QC))
    hashed = _true(F.col("recorded_sha256").rlike("^[0-9a-f]{64}$"))
    counts = rows.groupBy("entity_key").agg(
        F.count("*").alias("artifacts"), F.count_if(~F.col("accepted")).alias("partial"),
        F.count_if(full & F.col("available")).alias("full"), F.count_if(full & ~checked).alias("full_unchecked"),
        F.count_if(full & F.col("available") & ~hashed).alias("full_unhashed"),
        F.count_if(full & F.col("available") & ~checked).alias("ready_unchecked"),
        F.count_if(F.col("accepted") & F.col("available") & _true(F.col("role") == "node_mask")).alias("masks"),
    )
    out = entities.join(counts, "entity_key", "left").fillna(0, counts.columns[1:])
    return out.withColumn("ready", (F.col("full") > 0) & (F.col("ready_unchecked") == 0) & (F.col("full_unhashed") == 0))


def field_facts(evidence: DataFrame) -> DataFrame:
    """(entity_key, fields): for each field a struct of how many observations there are, how many different known values, the one value if
    there is one, what all observations say if they agree word for word, and a mark of the set of values."""
    one = evidence.groupBy("entity_key", "field", "raw_value").agg(F.count("*").alias("n"))
    said = F.when(known(F.col("raw_value")), F.col("raw_value"))
    alternatives, every = F.count(said), F.count("*")
    by_field = one.groupBy("entity_key", "field").agg(
        F.struct(
            F.sum("n").alias("n"), alternatives.alias("alternatives"), F.when(alternatives == 1, F.min(said)).alias("value"),
            F.when((every == 1) & (F.count("raw_value") == 1), F.min("raw_value")).alias("same"),
            F.struct(every, F.sum(F.xxhash64("raw_value").cast("decimal(20,0)"))).cast("string").alias("mark"),
        ).alias("fact")
    )
    return by_field.groupBy("entity_key").agg(F.map_from_entries(F.collect_list(F.struct("field", "fact"))).alias("fields"))


def link_facts(relationships: DataFrame, payloads: DataFrame) -> DataFrame:
    """(entity_key, links): for each relation how many links, whether all are exact, the one target if there is one, its category and masks,
    and how many required targets are not ready."""
    target = payloads.select(F.col("entity_key").alias("target_key"), "category", "ready", "masks")
    rows = relationships.join(target, "target_key", "left")
    kinds = F.create_map(*[F.lit(x) for pair in REQUIRED_KIND.items() for x in pair])
    exact = _true(F.col("status") == EXACT)
    fits = exact & _true(F.col("ready")) & _true(F.col("category") == F.try_element_at(kinds, F.col("relation")))
    single = F.min("target_key") == F.max("target_key")
    exact_target = lambda c: F.when(F.min(F.when(exact, c)) == F.max(F.when(exact, c)), F.min(F.when(exact, c)))
    by_relation = rows.groupBy(F.col("source_key").alias("entity_key"), "relation").agg(
        F.struct(
            F.count("*").alias("n"), (F.bool_and(exact) & single).alias("exact"), F.min("category").alias("category"),
            exact_target(F.col("target_key")).alias("target"), F.min(F.when(exact, F.col("category"))).alias("target_category"),
            F.min(F.when(exact, F.col("masks"))).alias("target_masks"), F.count_if(~fits).alias("unfit"),
        ).alias("fact")
    )
    return by_relation.groupBy("entity_key").agg(F.map_from_entries(F.collect_list(F.struct("relation", "fact"))).alias("links"))


def on_cycles(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Entities on or behind a cycle of exact dependencies; targets that are no entity do not count."""
    names = entities.select(F.col("entity_key").alias("target_key"))
    needed = relationships.where(F.col("relation").isin(*DEPENDENCIES) & (F.col("status") == EXACT)).join(names, "target_key", "left_semi")
    edges = needed.select(F.col("source_key").alias("entity_key"), "target_key").distinct()
    alone = entities.join(edges, "entity_key", "left_anti").select("entity_key", F.lit(None).cast(dict(edges.dtypes)["target_key"]).alias("target_key"))
    return levels(edges.unionByName(alone), "entity_key", "target_key").where("level is null").select("entity_key")


@dataclass(frozen=True)
class Delivery:
    """What is known of the delivery as a whole."""

    committed: bool = True
    index_status: str = "delivery_indexed"
    revision_verified: bool = True


def _field(name: str) -> Column:
    return F.try_element_at(F.col("fields"), F.lit(name))


def _link(name: str) -> Column:
    return F.try_element_at(F.col("links"), F.lit(name))


def _value(name: str) -> Column:
    return _field(name)["value"]


def _absent(name: str) -> Column:
    return _field(name).isNull()


def _is(name: str, expected: str) -> Column:
    return _true(_field(name)["same"] == expected)


def _json(name: str, path: str) -> Column:
    return F.get_json_object(_value(name), f"$.{path}")


def _unsaid(c: Column) -> Column:
    return ~_true(~F.lower(c).isin("", "unknown"))


def _in(*categories: str) -> Column:
    return F.col("category").isin(*categories)


def _seismic() -> list[tuple[str, Column]]:
    plan = lambda path: _json("seismic_conversion", path)
    source = lambda path: _json("seismic_source", path)
    seismic = _in("seismic")
    bound = _true((_field("seismic_conversion")["n"] == 1) & (_field("seismic_source")["n"] == 1))
    own = seismic & bound
    size = F.from_json(source("size"), "array<int>")
    sized = _true((F.size(size) == 3) & F.forall(size, lambda v: _true(v > 0)) & (plan("size") == source("size")))
    counted = _true(plan("native_axis.count").try_cast("int") == F.try_element_at(size, F.lit(3)))
    axis = plan("native_axis.origin").eqNullSafe(source("zstart")) & plan("native_axis.increment").eqNullSafe(source("zinc"))
    exact = _true((_field("conversion_qc")["n"] == 1) & (_json("conversion_qc", "all_decoded_samples_exact") == "true") & (_json("conversion_qc", "headers_verified") == "true"))
    return [
        ("SEISMIC_METADATA_UNBOUND", seismic & ~bound),
        ("SEISMIC_GEOMETRY_CONFLICT", own & ~(sized & counted)),
        ("SEISMIC_AXIS_CONFLICT", own & ~axis),
        ("SEISMIC_DOMAIN_UNRESOLVED", own & ~_true(plan("domain").isin("time", "depth", "length"))),
        ("VERTICAL_UNIT_UNRESOLVED", own & _unsaid(plan("source_vertical_unit"))),
        ("HORIZONTAL_UNIT_UNRESOLVED", own & _unsaid(plan("horizontal_unit"))),
        ("UNRESOLVED_CRS", own & ~_true(plan("crs_verified") == "true")),
        ("SEGY_HEADER_PROFILE_UNSPECIFIED", own & ~_true(F.length(plan("segy_header_profile")) > 0)),
        ("TIME_CONVENTION_UNRESOLVED", own & _true(plan("domain") == "time") & ~_true(F.length(plan("time_convention")) > 0)),
        ("VERTICAL_REFERENCE_UNRESOLVED", own & _true(plan("domain").isin("depth", "length")) & ~_true(F.length(plan("vertical_reference")) > 0)),
        ("SEISMIC_NUMERICAL_QC_UNVALIDATED", seismic & ~exact),
    ]


def source_rules(delivery: Delivery) -> list[tuple[str, Column]]:
    """(code, condition) over the facts; a code may stand more than once."""
    seismic, prop = _in("seismic"), _in("surface_property")
    placed = (*_SURFACES, *_WELLS, *_CULTURE)
    parent = _link("native_parent")
    has_parent = _true((parent["target"].isNotNull()) & (parent["target_category"] == "surface_geometry"))
    registered = _true(
        (_json("node_registration", "validated") == "true") & (_json("node_registration", "parent_entity_key") == parent["target"].cast("string"))
        & (_json("node_registration", "count").try_cast("long") == _json("grid_registration", "dimensions[0]").try_cast("long") * _json("grid_registration", "dimensions[1]").try_cast("long"))
    )
    units = _field("unit").isNotNull() & _field("index_declared_units").isNotNull() & _true(_field("unit")["mark"] != _field("index_declared_units")["mark"])
    unfit = F.lit(False)
    for kind in REQUIRED_KIND:
        unfit = unfit | _true(_link(kind)["unfit"] > 0)
    well = _link("source_well")
    return [
        ("HEAD_METADATA_STALE", _true(F.col("stale_heads"))),
        ("SEISMIC_METADATA_STALE", seismic & _true(F.col("stale_metadata"))),
        ("NO_AVAILABLE_ACCEPTED_FULL_PAYLOAD", F.col("full") == 0),
        ("PUBLICATION_NOT_FINAL", F.lit(not delivery.committed or delivery.index_status not in FINAL_INDEX)),
        ("SOURCE_REVISION_IDENTITY_UNRESOLVED", F.lit(not delivery.revision_verified)),
        ("SOURCE_RECOVERY_NOT_COMPLETE", ~_true(F.col("source_status").isin(*RECOVERED)) & ~(seismic & _true(F.col("materialization_status") == "converted"))),
        ("PARTIAL_PUBLICATION_PRESENT", F.col("partial") > 0),
        ("NUMERICAL_QC_UNVALIDATED", F.col("full_unchecked") > 0),
        ("RECORDED_PAYLOAD_IDENTITY_MISSING", F.col("full_unhashed") > 0),
        *((f"CONFLICTING_{f.upper()}", _true(_field(f)["alternatives"] > 1)) for f in ("unit", "measurement", "well_id")),
        ("CONFLICTING_UNIT_DECLARATION", units),
        ("UNRESOLVED_VALUE_UNIT", _in(*_SURFACES, "well_log") & (_value("unit").isNull() | ~_is("unit_status", UNIT_PROFILE))),
        ("UNRESOLVED_CRS", _in(*placed) & ~_is("crs_status", CRS_VERIFIED)),
        *_seismic(),
        ("PARENT_GEOMETRY_UNRESOLVED", prop & ~has_parent),
        ("NODE_REGISTRATION_UNVERIFIED", prop & ~(has_parent & registered)),
        ("NODE_MASK_UNAVAILABLE", prop & ~((F.col("masks") > 0) & _true(parent["target"].isNotNull() & (parent["target_masks"] > 0)))),
        ("NATIVE_VERTEX_GAPS_UNRESOLVED", _in(*_CULTURE) & _true(_value("missing_vertex_slots").try_cast("long") > 0)),
        ("SOURCE_WELL_UNRESOLVED", _in("well_log") & ~_true(well["exact"] & (well["category"] == "well"))),
        ("VERTICAL_UNIT_UNRESOLVED", _in(*(c for c in placed if c != "qa_scalar")) & _absent("depth_unit")),
        ("HORIZONTAL_UNIT_UNRESOLVED", _in(*(c for c in placed if c not in ("qa_scalar", "well_log"))) & _absent("horizontal_unit")),
        ("DEPENDENCY_CYCLE", _true(F.col("cycle"))),
        ("REQUIRED_DEPENDENCY_UNAVAILABLE", unfit),
    ]


def facts_of(entities: DataFrame, artifacts: DataFrame, relationships: DataFrame, evidence: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """One row of facts for each entity. ``bindings`` (entity_key, kind, bound_sha256, current_sha256) are metadata files that must not have
    changed: kind ``head`` or ``metadata``."""
    payloads = payload_facts(entities, artifacts)
    facts = payloads.join(field_facts(evidence), "entity_key", "left").join(link_facts(relationships, payloads), "entity_key", "left")
    facts = facts.join(on_cycles(entities, relationships).withColumn("cycle", F.lit(True)), "entity_key", "left")
    if bindings is None:
        return facts.withColumns({"stale_heads": F.lit(False), "stale_metadata": F.lit(False)})
    stale = ~_true(F.col("bound_sha256") == F.col("current_sha256"))
    marks = [F.bool_or(stale & (F.col("kind") == k)).alias(n) for k, n in (("head", "stale_heads"), ("metadata", "stale_metadata"))]
    return facts.join(bindings.groupBy("entity_key").agg(*marks), "entity_key", "left")


def _codes(rules: Sequence[tuple[str, Column]]) -> Column:
    """The codes that hold, sorted, each once. None of these functions takes a lambda: within one that does, all rules would be interpreted row by row."""
    return F.sort_array(F.array_except(F.array(*[F.when(found, code) for code, found in rules]), F.array(F.lit(None).cast("string"))))


def assessed(facts: DataFrame, delivery: Delivery = Delivery(), rules: Callable[[Delivery], Sequence[tuple[str, Column]]] = source_rules) -> DataFrame:
    """(entity_key, category, source_state, codes, n_codes) of ``facts_of``."""
    out = facts.select("entity_key", "category", _codes(rules(delivery)).alias("codes"))
    state = F.when(F.size("codes") == 0, "source_prerequisites_satisfied").otherwise("source_blocked")
    return out.select("entity_key", "category", state.alias("source_state"), F.array_join("codes", ",").alias("codes"), F.size("codes").alias("n_codes"))


# Source codes that also block a mapping.
CORE_BLOCKERS = (
    "NO_AVAILABLE_ACCEPTED_FULL_PAYLOAD", "SOURCE_REVISION_IDENTITY_UNRESOLVED", "SOURCE_RECOVERY_NOT_COMPLETE", "PUBLICATION_NOT_FINAL",
    "PARTIAL_PUBLICATION_PRESENT", "NUMERICAL_QC_UNVALIDATED", "RECORDED_PAYLOAD_IDENTITY_MISSING", "FILE_INTEGRITY_UNAVAILABLE", "DEPENDENCY_CYCLE",
    "SEISMIC_METADATA_UNBOUND", "SEISMIC_METADATA_STALE", "SEISMIC_AXIS_CONFLICT", "SEISMIC_GEOMETRY_CONFLICT", "SEISMIC_NUMERICAL_QC_UNVALIDATED",
    "NODE_MASK_UNAVAILABLE", "HEAD_METADATA_STALE", "NATIVE_VERTEX_GAPS_UNRESOLVED",
)


@dataclass(frozen=True)
class Receiver:
    """A program that is to receive objects: its version, the categories that it takes, and whether wells must be there already."""

    version: str
    api_version: str | None
    routes: tuple[str, ...]
    existing_wells_only: bool = False
    needs_lattice: bool = False


@dataclass(frozen=True)
class Need:
    """A field that a category needs: any known value, one of ``values``, or JSON that has all ``members`` and of them has those in ``exactly`` as the JSON text given."""

    categories: tuple[str, ...]
    field: str
    code: str | None = None
    values: tuple[str, ...] = ()
    members: tuple[str, ...] = ()
    exactly: tuple[tuple[str, str], ...] = ()


# Categories, fields, values and members that a receiver's rules ask for.
_PLACED = ("surface_geometry", "surface_property", "well", "trajectory", "culture_polygon", "culture_point")
_LOG, _ON_WELL, _SURFACE = ("well_log",), ("well_log", "marker", "checkshot", "trajectory"), ("surface_geometry", "surface_property")
NEEDS = (
    Need(_PLACED, "crs", "CRS_UNRESOLVED"), Need(_PLACED, "horizontal_unit"), Need(_PLACED, "vertical_domain", None, ("time", "depth", "elevation")),
    Need(_PLACED, "vertical_unit"), Need(("well_log", "surface_property"), "unit", "STORED_VALUE_UNIT_UNRESOLVED"),
    Need(_ON_WELL, "md_unit"), Need(_ON_WELL, "md_reference"),
    Need(_LOG, "log_kind", "LOG_KIND_UNSUPPORTED", ("continuous_scalar",)), Need(_LOG, "index_kind", "LOG_INDEX_SEMANTICS_UNRESOLVED", ("measured_depth",)),
    Need(_LOG, "sampling_kind", "LOG_INTERVAL_SEMANTICS_UNRESOLVED", ("point_samples",)), Need(_LOG, "null_semantics", None, (), ("representation", "source_rule")),
    Need(("well",), "well_identity"), Need(("well",), "head_semantics", None, (), ("xyz_roles", "vertical_reference", "source_locator")),
    Need(("trajectory",), "track_semantics", None, (), ("station_order", "md_source", "vertical_reference", "full_track"), (("full_track", "true"), ("md_source", '"stored_measured_depth"'))),
    Need(("marker",), "marker_semantics", None, (), ("source_role", "reference_validation")),
    Need(("checkshot",), "checkshot_semantics", None, (), ("source_role", "reference_validation")),
    Need(("checkshot",), "time_convention", None, ("OWT", "TWT")), Need(("checkshot",), "vertical_reference"),
    Need(("culture_polygon",), "polygon_topology", None, (), ("parts", "vertex_order", "ring_roles", "attribute_binding")),
    Need(("surface_geometry",), "surface_role", "SURFACE_VALUE_ROLE_UNRESOLVED", ("horizon_geometry",)),
    Need(("surface_property",), "surface_role", "SURFACE_VALUE_ROLE_UNRESOLVED", ("mapped_property",)),
)
#: What native records of a log must say where they say anything.
LOG_SEMANTICS = (("interval_records", "false"), ("curve_kind", "continuous_scalar"), ("index_type", "measured_depth"), ("value_role", "native_scalar_values"), ("blob_type", "FloatWellLog"))


INDEX_ORDERS = ("i_major_j_minor", "j_major_i_minor", "i_fastest_j_slowest", "j_fastest_i_slowest")


def _member(value: Column, path: str) -> Column:
    """A member of a JSON text as compact JSON, so that 3, "3" and true keep their types."""
    return F.to_json(F.try_variant_get(F.try_parse_json(value), path, "variant"))


def _is_grid(value: Column) -> Column:
    """Whether JSON states a lattice: two positive whole dimensions, an origin and two axes of two finite numbers that span an area, and a known order."""
    number = r"-?\d+(\.\d+)?([eE][+-]?\d+)?"
    good = _true(F.get_json_object(value, "$.dimensions").rlike(r"^\[[1-9]\d*,[1-9]\d*\]$"))
    for axis in ("origin_xy", "i_basis", "j_basis"):
        good = good & _true(_member(value, f"$.{axis}").rlike(rf"^\[{number},{number}\]$"))
    i, j = ([F.try_variant_get(F.try_parse_json(value), f"$.{a}[{k}]", "double") for k in (0, 1)] for a in ("i_basis", "j_basis"))
    area = i[0] * j[1] - i[1] * j[0]
    return good & _true((area != 0) & ~F.isnan(area) & (F.abs(area) < float("inf"))) & _true(F.get_json_object(value, "$.index_order").isin(*INDEX_ORDERS))


def _nodes_registered(value: Column, grid: Column, parent: Column) -> Column:
    """Whether JSON says that a property's nodes were validated against the parent's lattice, as many as that has."""
    whole = F.get_json_object(value, "$.count").rlike(r"^[1-9]\d*$") & ~_member(value, "$.count").startswith('"')
    count = F.when(whole, F.try_variant_get(F.try_parse_json(value), "$.count", "decimal(38,0)"))
    sides = [F.try_variant_get(F.try_parse_json(grid), f"$.dimensions[{k}]", "decimal(19,0)") for k in (0, 1)]
    said = _well_said(F.get_json_object(value, "$.method")) & _true(F.get_json_object(value, "$.parent_entity_key") == parent)
    return said & _true(_member(value, "$.validated") == "true") & _is_grid(grid) & _true(count == sides[0] * sides[1])


def _effective(field: str) -> Column:
    """The recorded value, or what a decision asserts where nothing else is recorded."""
    return F.coalesce(F.try_element_at(F.col("assertions"), F.lit(field)), _value(field))


def _well_said(c: Column) -> Column:
    return known(c) & c.isNotNull()


def _needed(need: Need, applies: Column | None = None) -> list[tuple[str, Column]]:
    where = _in(*need.categories) if applies is None else _in(*need.categories) & applies
    value, conflict = _effective(need.field), _true(_field(need.field)["alternatives"] > 1)
    good = _well_said(value)
    if need.values:
        good = _true(value.isin(*need.values))
    for member in need.members:
        good = good & _well_said(F.get_json_object(value, f"$.{member}"))
    for member, text in need.exactly:
        good = good & _true(_member(value, f"$.{member}") == text)
    code = need.code or f"{need.field.upper()}_UNRESOLVED"
    return [(f"CONFLICTING_{need.field.upper()}", where & conflict), (code, where & ~conflict & ~good)]


def mapping_rules(receiver: Receiver) -> list[tuple[str, Column]]:
    """(code, condition) over facts and the columns of a decision."""
    rules = [("TARGET_MAPPING_UNSUPPORTED", ~_in(*receiver.routes))]
    version = F.col("target_version").eqNullSafe(F.lit(receiver.version)) & F.col("target_api_version").eqNullSafe(F.lit(receiver.api_version).cast("string"))
    rules += [("TARGET_PROFILE_DECISION_REQUIRED", ~version), ("TARGET_OBJECT_DECISION_REQUIRED", ~_well_said(F.col("target_object_id")))]
    for need in NEEDS:
        rules += _needed(need)
    timed = _true(_effective("vertical_domain") == "time")
    rules += _needed(Need(_PLACED, "time_convention", None, ("OWT", "TWT")), timed) + _needed(Need(_PLACED, "vertical_reference"), ~timed)
    for field in ("index_shape", "value_shape"):
        value, conflict = _effective(field), _true(_field(field)["alternatives"] > 1)
        bad = _in(*_LOG) & ~conflict & ~_true(value == "scalar_1d")
        rules += [
            (f"CONFLICTING_{field.upper()}", _in(*_LOG) & conflict), (f"LOG_{field.upper()}_UNSUPPORTED", bad & _well_said(value)),
            (f"LOG_{field.upper()}_UNRESOLVED", bad & ~_well_said(value)),
        ]
    said_otherwise = F.lit(False)
    for field, expected in LOG_SEMANTICS:
        fact = _field(field)
        said_otherwise = said_otherwise | _true((fact["alternatives"] > 1) | ((fact["alternatives"] == 1) & (fact["value"] != expected)))
    asserted = lambda f: _true(F.try_element_at(F.col("assertions"), F.lit(f)).isNotNull())
    well, parent = _link("source_well"), _link("native_parent")
    exact_well = _true(well["exact"] & (well["category"] == "well"))
    exact_parent = _true(parent["exact"] & (parent["category"] == "surface_geometry"))
    bound = exact_well & _true(F.col("well_target_key") == well["target"]) & _true(F.col("well_target_state").isin("existing", "planned")) & _well_said(F.col("well_target_id"))
    differs = F.coalesce(F.exists(F.map_entries("assertions"), lambda e: _true((F.try_element_at(F.col("fields"), e["key"])["alternatives"] > 1) | (F.try_element_at(F.col("fields"), e["key"])["value"] != e["value"]))), F.lit(False))
    survey = lambda f: F.try_element_at(F.col("survey"), F.lit(f))
    has_survey = F.lit(True)
    for f in ("target_id", "crs", "horizontal_unit", "vertical_domain", "vertical_unit"):
        has_survey = has_survey & _well_said(survey(f))
    other = F.lit(False)
    for f in ("crs", "horizontal_unit", "vertical_domain", "vertical_unit"):
        other = other | ~survey(f).eqNullSafe(_effective(f))
    other = other | F.when(timed, ~survey("time_convention").eqNullSafe(_effective("time_convention"))).otherwise(~survey("vertical_reference").eqNullSafe(_effective("vertical_reference")))
    surface, on_well = _in(*_SURFACE), _in(*_ON_WELL)
    grid, nodes = _effective("grid_registration"), _effective("node_registration")
    for field, code, where, good in (
        ("grid_registration", "GRID_REGISTRATION_UNRESOLVED", surface, _is_grid(grid)),
        ("node_registration", "NODE_REGISTRATION_UNVERIFIED", _in("surface_property"), exact_parent & _nodes_registered(nodes, grid, parent["target"])),
    ):
        conflict = _true(_field(field)["alternatives"] > 1)
        rules += [(f"CONFLICTING_{field.upper()}", where & conflict), (code, where & ~conflict & ~good)]
    volume = _link("reference_seismic")
    with_volume = _true(volume["exact"] & (volume["category"] == "seismic") & (F.col("reference_volume_key") == volume["target"]))
    rules += [
        ("SOURCE_DECISION_CONFLICT", differs),
        ("CRS_EVIDENCE_UNVALIDATED", _in(*_PLACED) & ~_is("crs_status", CRS_VERIFIED) & ~asserted("crs")),
        ("STORED_UNIT_PROFILE_UNVALIDATED", _in("well_log", "surface_property") & ~_is("unit_status", UNIT_PROFILE) & ~asserted("unit")),
        ("RELATIONSHIP_UNRESOLVED", (on_well & ~exact_well) | (_in("surface_property") & ~exact_parent)),
        ("WELL_TARGET_BINDING_UNRESOLVED", on_well & ~bound),
        ("LOG_SOURCE_SEMANTICS_CONFLICT", _in(*_LOG) & said_otherwise),
        ("PARENT_GEOMETRY_UNRESOLVED", _in("surface_property") & ~exact_parent),
        ("SURVEY_DECISION_REQUIRED", surface & ~has_survey),
        ("SURVEY_CONTEXT_CONFLICT", surface & has_survey & other),
    ]
    if receiver.existing_wells_only:
        rules.append(("TARGET_DEPENDENCY_CREATION_UNSUPPORTED", on_well & bound & (F.col("well_target_state") != "existing")))
    if receiver.needs_lattice:
        rules.append(("SURVEY_LATTICE_MISMATCH", surface & has_survey & ~survey("grid_registration").eqNullSafe(_effective("grid_registration"))))
    else:
        rules.append(("REFERENCE_VOLUME_BINDING_UNRESOLVED", surface & has_survey & ~with_volume))
    return rules


def mapped(facts: DataFrame, decisions: DataFrame, receiver: Receiver, delivery: Delivery = Delivery()) -> DataFrame:
    """(entity_key, category, receiving_state, codes). ``decisions`` has at most one row for an entity: entity_key, target_version,
    target_api_version, target_object_id, well_target_key, well_target_id, well_target_state, reference_volume_key, assertions (map), survey (map)
    and derived (true if a derivation with its losses is agreed). Codes are of the source rules that also block a mapping and of the receiver's."""
    core = [(code, found) for code, found in source_rules(delivery) if code in CORE_BLOCKERS or code.startswith("CONFLICTING_")]
    made = facts.join(decisions, "entity_key", "left").select("entity_key", "category", "derived", _codes(core + mapping_rules(receiver)).alias("codes"))
    has = lambda pattern: F.exists("codes", lambda c: c.rlike(pattern))
    only_survey = F.size(F.array_except("codes", F.array(F.lit("SURVEY_LATTICE_MISMATCH"), F.lit("SURVEY_CONTEXT_CONFLICT")))) == 0
    derived = _true(F.col("derived"))
    state = (
        F.when(F.array_contains("codes", "NO_AVAILABLE_ACCEPTED_FULL_PAYLOAD"), "blocked_missing_payload")
        .when(has("QC|INTEGRITY|PUBLICATION|HASH|STALE"), "blocked_qc")
        .when(has("^(TARGET_MAPPING_UNSUPPORTED|TARGET_DEPENDENCY_CREATION_UNSUPPORTED|LOG_KIND_UNSUPPORTED|LOG_INDEX_SHAPE_UNSUPPORTED|LOG_VALUE_SHAPE_UNSUPPORTED)$"), "unsupported_target_mapping")
        .when(has("RELATIONSHIP|BINDING|REGISTRATION|DEPENDENCY"), "blocked_relationship")
        .when((F.size("codes") > 0) & ~(derived & only_survey), "blocked_metadata").when(derived, "requires_derived_mapping")
        .otherwise("qualified_for_planned_mapping")
    )
    return made.select("entity_key", "category", state.alias("receiving_state"), F.array_join("codes", ",").alias("codes"))
