"""Five catalogue tables out of nested receipts and a file index, in one pass.

Receipts are rows (source, number, item): the item is JSON text, the source one of ``SOURCES``, in that order, and the number its place there. A file index is rows (section, number, item). Every item is parsed once and gives tagged rows:
an entity it is about, entities it refers to, links, evidence, gaps and artifacts. They are written once, partitioned by tag, and each table is a fold of its own part. Rows that no table asked for needs are not told.

*Entities.* The key is project, lane and source id. Of an entity's mentions the first creates it: a reference before the item itself leaves it ``referenced``. A name that is only the id, or a category that is unknown, is replaced by
the first that is better; the last status of a receipt holds. ``origin`` tells who speaks of it: a ``receipt``, a file ``index`` only, or a ``reference`` only.

*Links.* ``exact_id_reference`` if a receipt or index speaks of the target, ``dangling`` if it is only referred to, ``unresolved`` if the source states several targets for one relation.

*Artifacts.* The key is the owner's and a hash of the canonical representation (base, path, role, format); equal ones are ``duplicate``, none is dropped. An entity that only an index knows is rebuilt from it, and the loss is a
gap, so packages without receipts pass through the same code and can't be taken for complete.

Items that are no JSON object, or have no object_id, give a row in ``rejected`` and nothing else. Repeated items are mentions each. Empty tables give empty tables. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle, written

#: Order of the sources: of mentions of one entity the earlier comes first.
SOURCES = ("context", "native", "spatial")
RECEIPTS = ("native", "spatial")
#: Relation and the field that names its target.
RELATIONS = (("native_parent", "parent_id"), ("source_well", "well_id"), ("reference_seismic", "reference_seismic_id"))
UNKNOWN = ("unknown", "numeric_grid_unclassified")
EXACT, DANGLING, UNRESOLVED = "exact_id_reference", "dangling", "unresolved"
# Fields of a receipt that are evidence as they stand.
FIELDS = (
    "unit", "unit_status", "depth_unit", "horizontal_unit", "declared_template_unit", "measurement", "crs_status", "native_unit_evidence", "project_units",
    "template_id", "blob_type", "subject_type", "node_size", "well_id", "crs", "vertical_domain", "vertical_unit", "vertical_reference", "time_convention", "md_unit",
    "md_reference", "log_kind", "index_kind", "sampling_kind", "null_semantics", "curve_kind", "value_role", "null_count", "surface_role", "grid_registration",
    "node_registration", "well_identity", "track_semantics", "head_semantics", "marker_semantics", "checkshot_semantics", "polygon_topology", "missing_vertex_slots",
)
#: Tables, and the tags of the rows that each is made of.
TABLES = {
    "entities": ("entity",), "relationships": ("entity", "relationship"), "evidence": ("evidence",), "gaps": ("entity", "gap"), "artifacts": ("artifact",), "rejected": ("rejected",),
}
TAGS = ("entity", "relationship", "evidence", "gap", "artifact", "rejected")
_ROW = "tag, entity_key, other, field, value, locator, name, category, status, source, place"


@dataclass(frozen=True)
class Catalogue:
    """Tables; None: not asked for."""

    entities: DataFrame | None = None
    relationships: DataFrame | None = None
    evidence: DataFrame | None = None
    gaps: DataFrame | None = None
    artifacts: DataFrame | None = None
    rejected: DataFrame | None = None


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", f"$.{path}", kind)


def _text(path: str) -> Column:
    """A text that says something."""
    value = _get(path)
    return F.when(F.trim(value) != "", value)


def _row(tag: str, key: Column, **columns: Column) -> Column:
    named = {"tag": F.lit(tag), "entity_key": key, **columns}
    kinds = {"place": "array<bigint>"}
    return F.struct(*(named.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in _ROW.split(", ")))


def _mention(key: Column, source_id: Column, locator: Column, place: Column, order: int, name=None, category=None, status=None, source=None) -> Column:
    none = F.lit(None).cast("string")
    at = F.concat(place, F.array(F.lit(order).cast("long")))
    return _row("entity", key, other=source_id, locator=locator, name=none if name is None else name, category=none if category is None else category, status=none if status is None else status, source=F.col("source") if source is None else source, place=at)


def _category(field: str = "category") -> Column:
    return F.coalesce(_text(field), F.lit("unknown"))


def _parsed(items: DataFrame, sources: Sequence[str], group: str) -> DataFrame:
    rank = F.lit(0).cast("long")
    for k, s in enumerate(sources, 1):
        rank = F.when(F.col(group) == s, k).otherwise(rank)
    out = items.select(F.col(group).alias("source"), F.col("number").cast("long").alias("number"), F.try_parse_json("item").alias("v"), F.col("item"))
    return out.withColumn("place", F.array(rank, F.col("number"))).withColumn("object_id", _get("object_id"))


def _key(project: str, source_id: Column, lane: str = "native") -> Column:
    return F.concat(F.lit(f"{project}:{lane}:"), source_id)


def receipt_rows(receipts: DataFrame, project: str, tags: Sequence[str] = TAGS) -> DataFrame:
    """Tagged rows of receipt items, of these tags."""
    own, key = F.col("object_id"), _key(project, F.col("object_id"))
    locator = F.concat("source", F.lit("#/objects/"), "number")
    name = F.coalesce(_text("name"), _text("object_name"))
    rows = [F.array(_mention(key, own, locator, F.col("place"), 0, name, _category(), _text("status")))] if "entity" in tags else []
    receipt = F.col("source").isin(*RECEIPTS)
    for k, (relation, field) in enumerate(RELATIONS, 1):
        target = _text(field)
        if k == 1:  # the first of the ancestry stands in for a parent
            target = F.coalesce(target, F.when(receipt, _text("ancestry[0].parent")))
        stated = target.isNotNull() if k == 1 else target.isNotNull() & receipt
        at = F.concat(locator, F.lit(f"/{field}"))
        link = _row("relationship", key, other=_key(project, target), field=F.lit(relation), locator=at, source=F.col("source"), place=F.col("place"))
        mention = _mention(_key(project, target), target, at, F.col("place"), k, status=F.lit("referenced"), source=F.lit("reference"))
        told = [row for tag, row in (("entity", mention), ("relationship", link)) if tag in tags]
        rows += [F.when(stated, F.array(*told)).otherwise(F.slice(F.array(*told), 1, 0))] if told else []
    if "evidence" in tags:
        rows.append(_evidence_rows(key, locator, receipt))
    if "gap" in tags:
        rows += _gap_rows(key, locator, receipt)
    return _tagged(_parsed(receipts, SOURCES, "source"), rows, tags)


def _evidence_rows(key: Column, locator: Column, receipt: Column) -> Column:
    said = [F.struct(F.lit(f).alias("field"), F.to_json(F.try_variant_get("v", f"$.{f}", "variant")).alias("value")) for f in FIELDS]
    said = F.filter(F.array(*said), lambda x: x["value"].isNotNull() & ~x["value"].isin("null", '""'))
    evidence = F.transform(said, lambda x: _row("evidence", key, field=x["field"], value=x["value"], locator=F.concat(locator, F.lit("/"), x["field"]), source=F.col("source"), place=F.col("place")))
    return F.when(receipt, evidence).otherwise(F.slice(evidence, 1, 0))


def _gap_rows(key: Column, locator: Column, receipt: Column) -> list[Column]:
    rows, slots = [], _get("missing_vertex_slots", "bigint")
    gaps = [
        (f"{f}_status", f, "SOURCE_SEMANTICS_UNRESOLVED", _get(f"{f}_status") == "unresolved") for f in ("unit", "crs")
    ] + [("missing_vertex_slots", "geometry_vertices", "NATIVE_VERTEX_GAPS", slots > 0)]
    for field, what, code, holds in gaps:
        gap = F.array(_row("gap", key, field=F.lit(what), value=F.lit(code), locator=F.concat(locator, F.lit(f"/{field}")), source=F.col("source"), place=F.col("place")))
        rows.append(F.when(receipt & F.coalesce(holds, F.lit(False)), gap).otherwise(F.slice(gap, 1, 0)))
    return rows


def index_rows(index: DataFrame, project: str, tags: Sequence[str] = TAGS) -> DataFrame:
    """Tagged rows of a file index, of these tags."""
    own, key = F.col("object_id"), _key(project, F.col("object_id"))
    locator = F.concat(F.lit("FILE_INDEX#/"), "source", F.lit("/"), "number")
    mention = _mention(key, own, locator, F.array(F.lit(9).cast("long"), F.col("number")), 0, _text("name"), _category(), source=F.lit("index"))
    fields = ("path_base", "path", "role", "format")
    canonical = F.concat_ws("\n", *(F.concat(F.lit(f"{f}="), F.coalesce(F.to_json(F.try_variant_get("v", f"$.{f}", "variant")), F.lit("null"))) for f in fields))
    artifact = _row(
        "artifact", key, other=F.concat(key, F.lit(":artifact:"), F.sha2(canonical, 256)), field=_get("role"), value=_get("path"), locator=locator, name=_get("format"),
        category=_get("bytes", "bigint").cast("string"), status=F.coalesce(_text("status"), F.lit("unknown")), source=F.col("source"), place=F.col("place"),
    )
    told = [row for tag, row in (("entity", mention), ("artifact", artifact)) if tag in tags]
    return _tagged(_parsed(index, (), "section"), [F.array(*told)] if told else [], tags)


def artifacts(index: DataFrame, project: str) -> DataFrame:
    """The artifacts alone: they are told from the index, so neither receipts nor entities are read or written for them."""
    return _artifacts(settle(index_rows(index, project, ("artifact",)).drop("tag"), "artifacts"))


def _tagged(parsed: DataFrame, rows: Sequence[Column], tags: Sequence[str]) -> DataFrame:
    good = F.coalesce(_text("object_id").isNotNull(), F.lit(False))
    bad = F.array(_row("rejected", F.lit(None), value=F.col("item"), locator=F.concat("source", F.lit("#"), "number"), source=F.col("source"), place=F.col("place")))
    none = F.slice(bad, 1, 0)
    told = F.when(good, F.concat(*rows) if rows else none).otherwise(bad if "rejected" in tags else none)
    return parsed.select(F.explode(told).alias("r")).select("r.*")


def built(receipts: DataFrame, index: DataFrame, project: str, tables: Sequence[str] = tuple(TABLES)) -> Catalogue:
    """The tables asked for. Tagged rows are written once, a folder for each tag; a table reads its own. Rows of one tag are not written."""
    tags = tuple(t for t in TAGS if any(t in TABLES[name] for name in tables))
    rows = receipt_rows(receipts, project, tags)
    if {"entity", "artifact", "rejected"} & {*tags}:
        rows = rows.unionByName(index_rows(index, project, tags))
    spark, schema = rows.sparkSession, rows.schema
    path = written(rows, "tagged", ["tag"]) if len(tags) > 1 else None

    def part(tag: str) -> DataFrame:
        return (spark.read.schema(schema).parquet(path) if path else rows).where(F.col("tag") == tag).drop("tag")

    made = {}
    if "entity" in tags:
        entities = made["entities"] = settle(_entities(part("entity"), project), "entities")
    if "relationships" in tables:
        made["relationships"] = _relationships(part("relationship"), entities)
    if "evidence" in tables:
        made["evidence"] = part("evidence").select("entity_key", "field", F.col("value").alias("raw_value"), "locator")
    if "gaps" in tables:
        lost = entities.where("origin = 'index'").select("entity_key", F.lit("entity").alias("field"), F.lit("RECEIPT_ABSENT").alias("code"), F.col("source_locator").alias("locator"))
        made["gaps"] = part("gap").select("entity_key", "field", F.col("value").alias("code"), "locator").unionByName(lost)
    if "artifacts" in tables:
        made["artifacts"] = _artifacts(part("artifact"))
    if "rejected" in tables:
        made["rejected"] = part("rejected").select("locator", F.col("value").alias("item"))
    return Catalogue(**made)


def _entities(mentions: DataFrame, project: str) -> DataFrame:
    """Folds of mentions: all are least or greatest values by place, so an entity of any number of mentions is summed on the map side."""
    place = F.col("place")
    named = F.col("name").isNotNull() & (F.col("name") != F.col("other"))
    known = F.col("category").isNotNull() & ~F.col("category").isin(*UNKNOWN)
    told = F.col("source").isin(*RECEIPTS) & F.col("status").isNotNull()
    made = mentions.groupBy("entity_key").agg(
        F.min("other").alias("source_id"), F.min_by("name", F.when(named, place)).alias("given"), F.min_by("category", F.when(known, place)).alias("better"),
        F.min_by(F.coalesce("category", F.lit("unknown")), place).alias("first_category"), F.max_by("status", F.when(told, place)).alias("stated"),
        F.min_by(F.coalesce("status", F.lit("unknown")), place).alias("first_status"), F.min_by("locator", place).alias("source_locator"), F.count("*").alias("mentions"),
        F.bool_or(F.col("source").isin(*SOURCES)).alias("receipt"), F.bool_or(F.col("source") == "index").alias("indexed"),
    )
    origin = F.when(F.col("receipt"), "receipt").when(F.col("indexed"), "index").otherwise("reference")
    return made.select(
        "entity_key", F.lit(project).alias("project_revision"), "source_id", F.coalesce("given", "source_id").alias("name"), F.coalesce("better", "first_category").alias("category"),
        F.coalesce("stated", "first_status").alias("source_status"), "source_locator", "mentions", origin.alias("origin"),
    )


def _relationships(links: DataFrame, entities: DataFrame) -> DataFrame:
    one = links.groupBy("entity_key", "other", "field").agg(F.min_by("locator", "place").alias("locator"), F.count("*").alias("stated"))
    targets = one.groupBy("entity_key", "field").agg(F.count("*").alias("targets"))
    there = entities.where("origin <> 'reference'").select(F.col("entity_key").alias("other"), F.lit(True).alias("there"))
    met = one.join(targets, ["entity_key", "field"]).join(there, "other", "left")
    status = F.when(F.col("targets") > 1, UNRESOLVED).when(F.col("there"), EXACT).otherwise(DANGLING)
    return met.select(F.col("entity_key").alias("source_key"), F.col("other").alias("target_key"), F.col("field").alias("relation"), status.alias("status"), "locator", "stated")


def _artifacts(rows: DataFrame) -> DataFrame:
    copies = rows.groupBy("other").agg(F.count("*").alias("copies"))
    status = F.when(F.col("copies") > 1, "duplicate").otherwise("single")
    return rows.join(copies, "other").select(
        F.col("other").alias("artifact_key"), "entity_key", F.col("field").alias("role"), F.col("name").alias("format"), F.col("value").alias("path"),
        F.col("category").cast("long").alias("expected_bytes"), F.col("status").alias("original_status"), F.col("source").alias("section"), status.alias("representation"), "locator",
    )
