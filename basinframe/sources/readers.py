"""Text, XML and SQLite sources, GeoJSON, and evidence in raw text. What cannot be read is a row with an issue."""

from __future__ import annotations

import json
import sqlite3

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of JSON lines; a line that does not parse is an issue, not a failure."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    read = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return read.where(~bad).select("r.*").drop("_bad"), read.where(bad).select("value")


def read_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV table with a header, a byte-order mark allowed; missing required columns are an error, not nulls."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    first = df.columns[0] if df.columns else ""
    df = df.withColumnRenamed(first, first.lstrip("﻿")) if first else df
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"columns are missing: {lacking}")
    return df


def tops_rows(texts: DataFrame, name: str, text: str) -> DataFrame:
    """Well tops in text form: a header block names the columns, each later line has that many bare or quoted values. Rows are maps;
    a line with another count has a status and no map."""
    head = F.regexp_extract(F.col(text), r"(?s)BEGIN HEADER\r?\n(.*?)END HEADER", 1)
    body = F.regexp_extract(F.col(text), r"(?s)END HEADER\r?\n(.*)", 1)
    columns = F.filter(F.transform(F.split(head, r"\r?\n"), lambda c: F.trim(c)), lambda c: F.length(c) > 0)
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)
    rows = texts.select(name, columns.alias("columns"), F.posexplode(lines).alias("line", "raw"))
    values = F.transform(
        F.regexp_extract_all("raw", F.lit(r'"([^"]*)"|(\S+)'), F.lit(0)), lambda v: F.regexp_replace(v, r'^"|"$', "")
    )
    read = rows.withColumn("values", values).withColumn("ok", F.size("values") == F.size("columns"))
    return read.select(
        name, "line", F.when(F.col("ok"), F.map_from_arrays("columns", "values")).alias("row"), F.when(F.col("ok"), "ok").otherwise("value_count").alias("status")
    )


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Elements of XML files as rows; an element that does not parse has a null row."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def _sqlite_rows(most_rows: int, required: tuple[str, ...] = ()):
    def read(batches):
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                made, issue = [], None
                try:
                    data = raw.as_py() or b""
                    if not data:
                        raise ValueError("empty")
                    if data[18:20] == b"\x02\x02":  # what its log holds is not in the file
                        raise ValueError("database with a write-ahead log")
                    with sqlite3.connect(":memory:") as con:
                        con.deserialize(data)
                        con.execute("PRAGMA query_only = 1")
                        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name")]
                        if lacking := sorted(set(required) - set(names)):
                            raise ValueError(f"tables are missing: {', '.join(lacking)}")
                        for t in names:
                            found = con.execute('SELECT * FROM "{}"'.format(t.replace('"', '""')))
                            columns = [c[0] for c in found.description]
                            for k, row in enumerate(found):
                                if len(made) >= most_rows:
                                    raise ValueError("too many rows")
                                values = {c: v.hex() if isinstance(v, bytes) else v for c, v in zip(columns, row, strict=True)}
                                made.append((path, t, k, json.dumps(values, sort_keys=True), "ok"))
                except (sqlite3.Error, ValueError) as why:
                    made, issue = [], f"rejected: {why}"
                if issue:
                    made = [(path, None, None, None, issue)]
                for k in range(0, len(made), 10_000):
                    columns = [list(c) for c in zip(*made[k : k + 10_000], strict=True)]
                    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["path", "table", "row", "json", "status"])

    return read


def sqlite_tables(files: DataFrame, path: str = "path", content: str = "content", most_rows: int = 200_000, required: tuple[str, ...] = ()) -> DataFrame:
    """Tables of SQLite files, read from their bytes and never written: (path, table, row, json, status). A file is read by one task, so its
    rows are bounded; one beyond the bound, that is no database, that has a write-ahead log beside it or lacks a required table is one row
    with a status."""
    return files.select(path, content).mapInArrow(_sqlite_rows(most_rows, required), "path string, table string, row long, json string, status string")


def table_inventory(rows: DataFrame) -> DataFrame:
    """Row counts and columns of the tables that ``sqlite_tables`` found."""
    keys = F.array_join(F.array_sort(F.json_object_keys("json")), ",")
    return rows.where("status = 'ok'").groupBy("path", "table").agg(F.count("*").alias("rows"), F.max(keys).alias("columns"))


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT ("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def line_features(vertices: DataFrame, key: str, order: list[str], x: str, y: str) -> DataFrame:
    """One GeoJSON feature for each line, in projected coordinates: (key, feature)."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, F.array(x, y).alias("xy"))))
    grouped = vertices.groupBy(key).agg(F.transform(ordered, lambda v: v["xy"]).alias("coordinates"))
    geometry = F.struct(F.lit("LineString").alias("type"), "coordinates")
    properties = F.struct(F.col(key).alias("id"))
    return grouped.select(key, F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("feature"))


def crs_evidence(texts: DataFrame, name: str, text: str, names: DataFrame) -> DataFrame:
    """The coordinate system a text names: a (system, code) pair counts only if both its name and its EPSG code are there; of several, the
    one whose name comes last. ``names`` is (system, code)."""
    codes = F.array_distinct(F.transform(F.regexp_extract_all(F.col(text), F.lit(r"EPSG[:\s]+(\d{4,6})"), F.lit(1)), lambda c: c.try_cast("int")))
    pairs = texts.select(name, text, F.explode(codes).alias("code")).join(names, "code")
    at = F.char_length(text) - F.position(F.reverse("system"), F.reverse(text))
    there = pairs.where(F.col(text).contains(F.col("system"))).select(name, "system", "code", at.alias("at"))
    best = there.groupBy(name).agg(F.max_by(F.struct("system", "code"), F.struct("at", "system")).alias("b"), F.count("*").alias("pairs"))
    return texts.select(name).join(best, name, "left").select(
        name, F.col("b.system").alias("system"), F.col("b.code").alias("code"), F.when(F.col("b").isNull(), "unresolved").otherwise("recorded").alias("status")
    )


def modelling_objects(spark: SparkSession, path: str, tags: dict[str, str]) -> DataFrame:
    """Objects of modelling metadata in XML files, by kind (fault, horizon, zone, ...): ``tags`` maps a kind to the tag of its elements. Rows
    (file, kind, name, framework); an element without a name is a row with a null name."""
    made = None
    for kind, tag in tags.items():
        rows = spark.read.format("xml").option("rowTag", tag).schema("_name string, Name string, _framework string, Framework string").load(path)
        one = rows.select(
            F.input_file_name().alias("file"), F.lit(kind).alias("kind"), F.coalesce("_name", F.trim("Name")).alias("name"),
            F.coalesce("_framework", F.trim("Framework")).alias("framework"),
        )
        made = one if made is None else made.unionByName(one)
    return made


def xml_scan(texts: DataFrame, text_id: str, text: str, terms: dict[str, str], most: int = 20) -> DataFrame:
    """What texts that may be XML say without being parsed: whether they look like XML, the first tag, up to ``most`` different names and
    object ids, and which ``terms`` (flag to pattern) occur."""
    t = F.col(text)
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r'(?i)\bname\s*=\s*"([^"]*)"'), F.lit(1))))
    ids = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"([0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})"), F.lit(1))))
    root = F.nullif(F.regexp_extract(t, r"<([A-Za-z_][\w.:-]*)", 1), F.lit(""))
    state = F.when(t.isNull() | (F.length(F.trim(t)) == 0), "empty").when(t.rlike(r"^\s*<"), "markup").when(root.isNotNull(), "embedded").otherwise("text")
    flags = F.array_sort(F.array_compact(F.array(*[F.when(t.rlike(p), n) for n, p in terms.items()])))
    return texts.select(
        text_id, state.alias("status"), root.alias("root"), F.array_join(F.slice(names, 1, most), "|").alias("names"), F.size(names).alias("n_names"),
        F.array_join(F.slice(ids, 1, most), "|").alias("ids"), F.array_join(flags, ",").alias("flags"),
    )
