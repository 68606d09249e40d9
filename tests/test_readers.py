"""Readers on small files, good and bad."""

import json
import sqlite3

import pytest

from basinframe.sources import readers


def test_json_lines_with_bad_ones(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"a": 1}\n\n{"a": "x"}\n{broken\n{"a": 2, "b": 3}\n')
    rows, issues = readers.read_jsonl(spark, str(tmp_path / "e.jsonl"), "a int")
    assert sorted(r.a for r in rows.collect()) == [1, 2]
    assert sorted(r.value for r in issues.collect()) == ['{"a": "x"}', "{broken"]


def test_csv_header_and_required_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿path,sha\nx,1\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "m.csv"), ["path", "sha"]).collect()] == [("x", "1")]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "m.csv"), ["bytes"])


def test_tops(spark):
    text = 'VERSION 2\nBEGIN HEADER\nX\nWell\nSurface\nEND HEADER\n1.5 "W 1" Top\n2 W2\n\n3 W3 "B C"\n'
    d = spark.createDataFrame([("f", text), ("g", "nothing"), ("h", None)], "n string, t string")
    got = [(r.line, r.row, r.status) for r in readers.tops_rows(d, "n", "t").orderBy("line").collect()]
    assert got == [
        (0, {"X": "1.5", "Well": "W 1", "Surface": "Top"}, "ok"),
        (1, None, "value_count"),
        (2, {"X": "3", "Well": "W3", "Surface": "B C"}, "ok"),
    ]


def test_xml_rows(spark, tmp_path):
    (tmp_path / "m.xml").write_text("<model><fault><name>F1</name></fault><zone/><fault><name>F2</name></fault></model>")
    got = readers.read_xml(spark, str(tmp_path / "m.xml"), "fault", "name string").collect()
    assert sorted(r.name for r in got) == ["F1", "F2"]


def test_sqlite_files(spark, tmp_path):
    path = tmp_path / "p.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE data (pk INTEGER, name TEXT, b BLOB)")
    con.executemany("INSERT INTO data VALUES (?, ?, ?)", [(1, "x", b"\x01"), (2, None, None)])
    con.execute("CREATE TABLE empty (z INTEGER)")
    con.commit()
    con.close()
    files = spark.createDataFrame([("p", bytearray(path.read_bytes())), ("q", bytearray(b"no database, but long enough" * 40))], "path string, content binary")
    rows = readers.sqlite_tables(files)
    got = rows.collect()
    assert [json.loads(r.json) for r in got if r.path == "p"] == [{"pk": 1, "name": "x", "b": "01"}, {"pk": 2, "name": None, "b": None}]
    assert [r.status.split(":")[0] for r in got if r.path == "q"] == ["rejected"]
    assert [(r.table, r.rows, r.columns) for r in readers.table_inventory(rows).collect()] == [("data", 2, "b,name,pk")]
    assert readers.sqlite_tables(files, most_rows=1).where("path = 'p'").first().status == "rejected: too many rows"


def test_features(spark):
    d = spark.createDataFrame([("l", 1, 3.0, 4.0), ("l", 0, 1.0, 2.0)], "k string, o int, x double, y double")
    made = json.loads(readers.line_features(d, "k", ["o"], "x", "y").first().feature)
    assert made["geometry"] == {"type": "LineString", "coordinates": [[1.0, 2.0], [3.0, 4.0]]}


def test_coordinate_systems_need_name_and_code(spark):
    names = spark.createDataFrame([("Alpha 31", 23031), ("Beta 32", 23032)], "system string, code int")
    rows = [("a", "Alpha 31 EPSG:23031 then Beta 32 EPSG 23032"), ("b", "Alpha 31 only"), ("c", "EPSG:23032"), ("d", "Beta 32 EPSG:23032 Alpha 31 EPSG:23031 Beta 32"), ("e", None)]
    got = {r.n: (r.system, r.code, r.status) for r in readers.crs_evidence(spark.createDataFrame(rows, "n string, t string"), "n", "t", names).collect()}
    none = (None, None, "unresolved")
    assert got == {"a": ("Beta 32", 23032, "recorded"), "b": none, "c": none, "d": ("Beta 32", 23032, "recorded"), "e": none}


def test_databases_are_refused_for_a_reason(spark, tmp_path):
    import sqlite3

    path = tmp_path / "d.db"
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (a INT)")
        con.execute("INSERT INTO t VALUES (1)")
    con.close()
    raw = bytearray(path.read_bytes())
    logged = bytearray(raw)
    logged[18:20] = b"\x02\x02"
    files = spark.createDataFrame([("good", raw), ("logged", logged), ("text", bytearray(b"no database")), ("none", None)], "path string, content binary")
    status = {r.path: r.status for r in readers.sqlite_tables(files, required=("t",)).collect()}
    assert status["good"] == "ok" and "write-ahead" in status["logged"] and status["text"].startswith("rejected")
    (one,) = readers.sqlite_tables(files.where("path = 'good'"), required=("t", "u")).collect()
    assert one.status == "rejected: tables are missing: u"


def test_modelling_objects(spark, tmp_path):
    (tmp_path / "m.xml").write_text('<m><Fault name="f1" framework="a"/><Fault name="f2"/><Horizon><Name> h1 </Name></Horizon><Zone/></m>')
    got = readers.modelling_objects(spark, str(tmp_path / "m.xml"), {"fault": "Fault", "horizon": "Horizon"}).collect()
    assert sorted((r.kind, r["name"], r.framework) for r in got) == [("fault", "f1", "a"), ("fault", "f2", None), ("horizon", "h1", None)]
