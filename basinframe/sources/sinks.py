"""Writers: snapshots behind a pointer, read-back checks, canonical JSON lines, LAS and ZMAP text, one folder per object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import LAS_NULL, ZMAP_NULL


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _pointers(spark: SparkSession, target: str) -> DataFrame | None:
    """(sequence, generation) of each snapshot whose pointer is complete."""
    fs, p = _fs(spark, f"{target}/_pointers")
    if not fs.exists(p):
        return None
    done = [str(s.getPath()) for s in fs.listStatus(p) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.schema("sequence long, generation string").json(done) if done else None


def publish(df: DataFrame, target: str, generation: str) -> str:
    """Write a snapshot into ``target/generation`` and make it current. The pointer is a one-row table that is written last, so readers see
    the old snapshot or the new one. A generation that is there is never overwritten: that fails. Pointers are numbered; of two
    writers that take the same number, the greater generation counts."""
    spark, path = df.sparkSession, f"{target}/{generation}"
    df.write.mode("error").parquet(path)
    there = _pointers(spark, target)
    last = there.agg(F.max("sequence")).first()[0] if there is not None else None
    pointer = spark.createDataFrame([((last or 0) + 1, generation)], "sequence long, generation string")
    pointer.coalesce(1).write.mode("error").json(f"{target}/_pointers/{generation}")
    return path


def published(spark: SparkSession, target: str) -> DataFrame | None:
    """The snapshot with the last pointer, or None."""
    there = _pointers(spark, target)
    newest = there.agg(F.max(F.struct("sequence", "generation")).alias("last")).first()["last"] if there is not None else None
    return spark.read.parquet(f"{target}/{newest['generation']}") if newest is not None else None


def write_if_any(df: DataFrame, path: str, form: str = "parquet") -> bool:
    """Write unless there is no row; a stale table of an earlier run is removed then."""
    if df.isEmpty():
        fs, p = _fs(df.sparkSession, path)
        fs.delete(p, True)
        return False
    df.write.mode("overwrite").format(form).save(path)
    return True


def read_back_equal(df: DataFrame, back: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted."""
    return df.exceptAll(back).isEmpty() and back.exceptAll(df).isEmpty()


def canonical_json(*columns: str) -> Column:
    """A row as JSON with fields in name order and nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> DataFrame:
    """Canonical JSON lines, and a manifest of (rows, sha256). The hash is of the sums of the lines' SHA-256 digests, taken as eight numbers of
    32 bits each: it does not depend on the order of the lines, and sums are added up where the rows are."""
    lines = df.select(canonical_json(*df.columns).alias("value"))
    lines.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path)
    digest = F.sha2("value", 256)
    sums = [F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")) for k in range(8)]
    spelt = F.concat_ws(",", F.count("*").cast("string"), *(F.coalesce(x, F.lit(0)).cast("string") for x in sums))
    return lines.agg(F.count("*").alias("rows"), F.sha2(spelt, 256).alias("sha256"))


def write_by_object(df: DataFrame, key: str, path: str) -> bool:
    """One folder per object; whether the rows written add up."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)
    back = df.sparkSession.read.parquet(path)
    a = df.groupBy(F.col(key).cast("string").alias("k")).count()
    return read_back_equal(a, back.groupBy(F.col(key).cast("string").alias("k")).count())


def null_code(values: Column, start: float) -> Column:
    """A code for null that no value has: ``start``, or else the first of ten times that, and so on, that is beyond all values in size.
    ``values`` is an array."""
    sizes = F.transform(F.array_compact(values), lambda v: F.abs(v))
    beyond = F.greatest(F.lit(1.0), F.floor(F.log10(F.array_max(sizes) / abs(start))) + 1)
    return F.when(F.array_contains(F.array_compact(values), F.lit(start)), F.lit(start) * F.pow(F.lit(10.0), beyond)).otherwise(F.lit(start))


def las_lines(logs: DataFrame, well: str, depth: str, value: str) -> DataFrame:
    """LAS 2.0 text of each well, one curve: (well, las). A well's curve is one array, as its file is one text."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(depth).alias("d"), F.col(value).alias("v"))))
    grouped = logs.groupBy(well).agg(rows.alias("rows"))
    code = null_code(F.transform("rows", lambda r: r["v"]), LAS_NULL)
    steps = F.transform(F.sequence(F.lit(1), F.size("rows") - 1), lambda k: F.get("rows", k)["d"] - F.get("rows", k - 1)["d"])
    even = F.when(F.size("rows") < 2, F.lit(0.0)).when(F.array_max(steps) - F.array_min(steps) <= 1e-8, F.array_min(steps)).otherwise(0.0)
    made = grouped.withColumn("code", code).withColumn("step", even)
    data = F.transform("rows", lambda r: F.concat_ws(" ", r["d"].cast("string"), F.coalesce(r["v"], F.col("code")).cast("string")))
    head = F.concat(
        F.lit("~VERSION\nVERS. 2.0 :\nWRAP. NO :\n~WELL\nSTRT. "), F.element_at("rows", 1)["d"].cast("string"), F.lit(" :\nSTOP. "),
        F.element_at("rows", -1)["d"].cast("string"), F.lit(" :\nSTEP. "), F.col("step").cast("string"), F.lit(" :\nNULL. "),
        F.col("code").cast("string"), F.lit(" :\nWELL. "), F.col(well).cast("string"), F.lit(" :\n~CURVE\nDEPT. :\nVALUE. :\n~ASCII\n"),
    )
    return made.select(well, F.concat(head, F.array_join(data, "\n"), F.lit("\n")).alias("las"))


def read_las(texts: DataFrame, name: str, text: str) -> DataFrame:
    """Rows of LAS texts: (name, depth, value), nulls decoded by the file's own code."""
    code = F.regexp_extract(text, r"(?m)^NULL\.\s*(\S+)", 1).try_cast("double")
    body = F.element_at(F.split(text, r"~A[^\n]*\n"), -1)
    cells = F.split(F.trim("line"), r"\s+")
    rows = texts.select(name, code.alias("code"), body.alias("body")).select(name, "code", F.explode(F.filter(F.split("body", "\n"), lambda x: F.length(F.trim(x)) > 0)).alias("line"))
    v = F.get(cells, 1).try_cast("double")
    return rows.select(name, F.get(cells, 0).try_cast("double").alias("depth"), F.when(v != F.col("code"), v).alias("value"))


def typed_number(v: Column) -> Column:
    """A number as JSON that keeps what JSON cannot spell: NaN and the infinities are objects that name them."""
    named = F.when(F.isnan(v), "NaN").when(v == float("inf"), "Infinity").when(v == float("-inf"), "-Infinity")
    return F.when(named.isNotNull(), F.concat(F.lit('{"non_finite":"'), named, F.lit('"}'))).otherwise(F.coalesce(v.cast("string"), F.lit("null")))


def xyz_lines(nodes: DataFrame, x: str, y: str, value: str, defined: str) -> DataFrame:
    """A line ``x y value`` for each defined node; nodes without a finite number are not defined."""
    v = F.col(value)
    return nodes.where(F.col(defined) & ~F.isnan(v) & v.isNotNull()).select(F.concat_ws(" ", x, y, value).alias("line"))


def _written_value() -> Column:
    """What a lattice node says: a defined finite number, else null."""
    v = F.col("raw").cast("double")
    return F.when(F.col("defined") & ~F.isnan(v) & (F.abs(v) < float("inf")), v)


def zmap_head(nodes: DataFrame, name: str, rows_to_a_line: int = 5) -> DataFrame:
    """The ZMAP header of a lattice (i, j, x, y, raw, defined): (head, code, rows, columns), one row. The code for null is one that no written value has: -1e30, or else
    the negative power of ten beyond them all. NaN and infinities are written as null, so they have no say in it."""
    most = F.max(F.abs(_written_value()))
    code = F.when(most >= abs(ZMAP_NULL), -F.pow(F.lit(10.0), F.floor(F.log10(most)) + 1)).otherwise(F.lit(ZMAP_NULL))
    sizes = nodes.agg((F.max("j") + 1).alias("rows"), (F.max("i") + 1).alias("columns"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))], code.alias("code"))
    lines = (
        F.lit(f"@{name} HEADER, GRID, {rows_to_a_line}"), F.concat_ws(", ", F.lit("15"), "code", F.lit(""), F.lit("7"), F.lit("1")),
        F.concat_ws(", ", "rows", "columns", "low_x", "high_x", "low_y", "high_y"), F.lit("0.0, 0.0, 0.0"), F.lit("@"),
    )
    return sizes.select(F.concat_ws("\n", *lines).alias("head"), "code", "rows", "columns")


def zmap_lines(nodes: DataFrame, head: DataFrame, rows_to_a_line: int = 5) -> DataFrame:
    """Body lines under a ``head`` of ``zmap_head``: (i, k, line), column by column from the top row down, so many values to a line, each column from a new line.
    Null and what no node states have the header's code. A line is a group of its own, so no task holds a column."""
    every = head.select("code", "rows", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("i"))
    every = every.select("code", "i", "rows", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("j"))
    met = every.join(nodes.select("i", "j", _written_value().alias("v")), ["i", "j"], "left").withColumn("place", F.col("rows") - 1 - F.col("j"))
    value = F.struct("place", F.coalesce("v", "code").cast("string").alias("v"))
    groups = met.groupBy("i", F.floor(F.col("place") / rows_to_a_line).cast("int").alias("k")).agg(F.array_sort(F.collect_list(value)).alias("values"))
    return groups.select("i", "k", F.array_join(F.transform("values", lambda r: r["v"]), " ").alias("line"))
