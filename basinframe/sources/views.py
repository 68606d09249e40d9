"""The star-schema tables seen as subsurface tables.

Every adapter is a narrow projection, so column pruning and pushed filters reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)
NX = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, d: str) -> DataFrame:
    """Versioned objects: droid, name, version, data_pk, blob_type."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("droid"), F.col("o_orderstatus").alias("name"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("version"), F.col("o_orderkey").alias("data_pk"),
        F.col("o_orderpriority").alias("blob_type"),
    )


def log_samples(spark: SparkSession, d: str) -> DataFrame:
    """Well logs: well, curve, seq (event order), md, raw, is_null. Every 97th sample holds the null sentinel."""
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    return table(spark, d, "events").select(
        F.col("user_id").alias("well"), F.col("event_type").alias("curve"), F.col("event_id").alias("seq"),
        seconds.cast("double").alias("md"), F.col("value").alias("raw"), (F.col("event_id") % 97 == 0).alias("is_null"),
    )


def stations(spark: SparkSession, d: str) -> DataFrame:
    """Trajectory stations: well, seq, md, x, y."""
    return log_samples(spark, d).select("well", "seq", "md", F.col("raw").alias("x"), (F.col("raw") * (F.col("seq") % 7)).alias("y"))


def grid_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A lattice of NX columns: node, i, j, raw, defined."""
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        key.alias("node"), (key % NX).cast("int").alias("i"), F.floor(key / NX).cast("int").alias("j"),
        F.col("p_retailprice").alias("raw"), (F.col("p_size") % 7 != 0).alias("defined"),
    )


def grid_nodes_b(spark: SparkSession, d: str) -> DataFrame:
    """Another property on the same lattice."""
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        key.alias("node"), (key % NX).cast("int").alias("i"), F.floor(key / NX).cast("int").alias("j"),
        (F.col("p_size") * 10.0).alias("raw"), (F.col("p_size") % 5 != 0).alias("defined"),
    )


def vertices(spark: SparkSession, d: str) -> DataFrame:
    """Polyline vertices: line, part, ordinal keys, x, y, missing."""
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("line"), F.col("l_linenumber").alias("part"), F.col("l_orderkey").alias("k1"),
        F.col("l_partkey").alias("k2"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"),
        (F.col("l_discount") >= 0.09).alias("missing"),
    )


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Delivered files: path, sha256, bytes, kind, format."""
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("bytes"),
        F.col("source").alias("kind"), F.col("lang").alias("format"),
    )


def evidence(spark: SparkSession, d: str) -> DataFrame:
    """Metadata observations, long: entity, field, value."""
    return (
        table(spark, d, "part")
        .select(F.col("p_name").alias("entity"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("string").alias("size"))
        .unpivot("entity", ["brand", "type", "size"], "field", "value")
    )


def traces(spark: SparkSession, d: str) -> DataFrame:
    """Seismic traces: trace, inline, samples."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("trace"), F.col("label").alias("inline"), F.col("embedding").alias("samples"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Parent edges: child, parent, as text keys."""
    r = table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("child"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("child"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("child"), F.concat(F.lit("N"), "s_nationkey").alias("parent"))
    c = table(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("child"), F.concat(F.lit("N"), "c_nationkey").alias("parent"))
    return r.union(n).union(s).union(c)


def needs(spark: SparkSession, d: str) -> DataFrame:
    """A graph of needs: chains of customers of up to twelve, some broken off, some closed to cycles; suppliers that need two customers."""
    k = F.col("c_custkey")
    other = F.when(k % 97 == 5, F.lit("gone")).when(k % 61 == 7, F.concat(F.lit("C"), k + 2)).when(k % 12 != 0, F.concat(F.lit("C"), k - 1))
    chains = table(spark, d, "customer").select(F.concat(F.lit("C"), k).alias("child"), other.alias("parent"))
    s = F.col("s_suppkey")
    both = F.explode(F.array(F.concat(F.lit("C"), s), F.concat(F.lit("C"), s + 5)))
    return chains.union(table(spark, d, "supplier").select(F.concat(F.lit("S"), s).alias("child"), both.alias("parent")))
