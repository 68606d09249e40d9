"""Receipts of odd rows, and packages without any."""

import json

from basinframe.operators import assembly as A

RECEIPT, INDEX = "source string, number long, item string, tag string", "section string, number long, item string"


def rows(spark, items, schema):
    return spark.createDataFrame([(*x[:2], x[2] if x[2] is None or isinstance(x[2], str) else json.dumps(x[2]), *(["clash"] if "tag" in schema else [])) for x in items], schema)


def by(frame, key):
    return {getattr(r, key): r for r in frame.collect()}


def test_mentions_links_and_losses(spark):
    receipts = [
        ("context", 0, {"object_id": "a", "parent_id": "b"}), ("context", 1, {"object_id": "b", "name": "B", "category": "unknown"}), ("context", 2, {"object_id": "c", "name": "c", "parent_id": "gone"}),
        ("native", 0, {"object_id": "b", "category": "well", "status": "decoded", "unit": "m", "unit_status": "unresolved", "native_unit_evidence": {"x": [1, "1", True]}, "md_unit": "", "crs": None}),
        ("native", 1, {"object_id": "b", "category": "grid", "name": "later", "status": None}), ("spatial", 0, {"object_id": "c", "ancestry": [{"parent": "b"}], "missing_vertex_slots": 2}),
        ("spatial", 1, {"object_id": "a", "missing_vertex_slots": "two", "null_count": 0}), ("context", 3, None), ("context", 4, "[1, 2]"), ("native", 2, '{"object_id": '), ("native", 3, {"object_id": " "}),
        ("native", 4, {"object_id": 7, "well_id": "a"}), ("native", 4, {"object_id": 7, "well_id": "a"}),
    ]
    index = [("files", 0, {"object_id": "a", "path": "x", "role": "r", "format": "LAS", "bytes": 5}), ("files", 1, {"object_id": "a", "format": "LAS", "role": "r", "path": "x"}), ("files", 2, {"object_id": "z", "path": "y", "bytes": "many"})]
    made = A.built(rows(spark, receipts, RECEIPT), rows(spark, index, INDEX), "p")
    e = by(made.entities, "source_id")
    assert {k: (r.name, r.category, r.source_status, r.origin) for k, r in e.items()} == {
        "a": ("a", "unknown", "unknown", "receipt"), "b": ("B", "well", "decoded", "receipt"), "c": ("c", "unknown", "unknown", "receipt"), "gone": ("gone", "unknown", "referenced", "reference"),
        "7": ("7", "unknown", "unknown", "receipt"), "z": ("z", "unknown", "unknown", "index"),
    }
    assert e["b"].source_locator == "context#/objects/0/parent_id" and e["7"].mentions == 2
    links = {(r.source_key, r.target_key): (r.relation, r.status, r.stated) for r in made.relationships.collect()}
    assert links == {
        ("p:native:a", "p:native:b"): ("native_parent", A.EXACT, 1), ("p:native:c", "p:native:gone"): ("native_parent", A.UNRESOLVED, 1),
        ("p:native:c", "p:native:b"): ("native_parent", A.UNRESOLVED, 1), ("p:native:7", "p:native:a"): ("source_well", A.EXACT, 2),
    }
    said = {(r.entity_key[9:], r.field): r.raw_value for r in made.evidence.collect()}
    assert said["b", "native_unit_evidence"] == '{"x":[1,"1",true]}' and said["a", "missing_vertex_slots"] == '"two"' and said["a", "null_count"] == "0"
    assert ("b", "md_unit") not in said and ("b", "crs") not in said
    assert {(r.entity_key[9:], r.field, r.code) for r in made.gaps.collect()} == {
        ("b", "unit", "SOURCE_SEMANTICS_UNRESOLVED"), ("c", "geometry_vertices", "NATIVE_VERTEX_GAPS"), ("z", "entity", "RECEIPT_ABSENT"),
    }
    assert sorted(((r.path, r.expected_bytes, r.representation) for r in made.artifacts.collect()), key=str) == [("x", 5, "duplicate"), ("x", None, "duplicate"), ("y", None, "single")]
    assert {r.representation for r in made.artifacts.where("path = 'x'").collect()} == {"duplicate"}
    assert sorted(r.locator for r in made.rejected.collect()) == ["context#3", "context#4", "native#2", "native#3"]


def test_a_package_without_receipts_is_rebuilt_and_said_to_be(spark):
    index = rows(spark, [("files", k, {"object_id": f"o{k % 3}", "name": "n", "category": "log", "path": str(k)}) for k in range(7)], INDEX)
    made = A.built(rows(spark, [("context", 0, None)], RECEIPT).limit(0), index, "p")
    assert {(r.source_id, r.name, r.category, r.origin) for r in made.entities.collect()} == {(f"o{k}", "n", "log", "index") for k in range(3)}
    assert made.gaps.where("code = 'RECEIPT_ABSENT'").count() == 3 and made.artifacts.count() == 7 and made.relationships.count() == 0
    none = A.built(rows(spark, [("context", 0, None)], RECEIPT).limit(0), index.limit(0), "p")
    assert [t.count() for t in (none.entities, none.relationships, none.evidence, none.gaps, none.artifacts, none.rejected)] == [0] * 6


def test_artifacts_alone_are_those_of_the_catalogue(spark):
    item = '{"object_id":"P1","path":"o","role":"R","format":"LAS","bytes":3}'
    index = spark.createDataFrame([("files", 1, item), ("files", 2, item), ("files", 3, "junk"), ("files", 4, '{"object_id":"P2"}')], "section string, number long, item string")
    receipts = spark.createDataFrame([], "source string, number long, item string")
    got, want = A.artifacts(index, "p"), A.built(receipts, index, "p").artifacts
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert sorted(r.representation for r in got.collect()) == ["duplicate", "duplicate", "single"]


def test_only_rows_of_the_tables_asked_for_are_told(spark, monkeypatch):
    receipts = [
        ("context", 0, {"object_id": "a", "parent_id": "b"}), ("native", 0, {"object_id": "b", "unit": "m", "unit_status": "unresolved", "well_id": "w"}),
        ("spatial", 0, {"object_id": "c", "missing_vertex_slots": 2}), ("native", 1, "junk"),
    ]
    index = [("files", 0, {"object_id": "a", "path": "x", "bytes": 5}), ("files", 1, {"object_id": "w", "path": "y"}), ("files", 2, {"object_id": "z", "path": "y"}), ("files", 3, {})]
    tables = rows(spark, receipts, RECEIPT), rows(spark, index, INDEX)
    whole, told = A.built(*tables, "p"), []

    def written(df, name, by=(), real=A.written):
        if by:
            told.extend(r.tag for r in df.select("tag").distinct().collect())
        return real(df, name, by)

    monkeypatch.setattr(A, "written", written)
    for name in A.TABLES:
        told.clear()
        one = A.built(*tables, "p", [name])
        assert sorted(getattr(one, name).collect()) == sorted(getattr(whole, name).collect()) != []
        assert {*told} <= {*A.TABLES[name]}
