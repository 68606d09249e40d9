"""Containers packed from the tables, decoded again and read: what comes out must be what went in."""

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import wells as W
from ..sources import packing
from ..sources import streamed as S
from ..sources.scratch import settle
from ..sources.views import table
from .base import Plans

P = Plans()
_SENTINEL = float(2**128 - 2**104)


def _decoded(spark, containers, run_bytes, slice_of):
    written = settle(containers, "containers")
    return S.streamed(written, settle(S.runs(written, run_bytes=run_bytes), "runs"), slice_of=slice_of)


def _packed(rows, pack):
    """(path, documents array) to (path, content)."""

    def packed(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a container at a time
                content = packing.container(pack(d.as_py()) for d in batch.column(1)[k].values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([content], pa.binary())], names=["path", "content"])

    return rows.mapInArrow(packed, "path string, content binary")


def _log(document):
    return packing.element("log", packing.array("md", document["md"]), packing.array("float_values", document["raw"], "<f4"))


@P.query(f"""WITH l AS (SELECT 's' || l_suppkey AS path, l_returnflag AS flag, CAST(l_orderkey * 8 + l_linenumber AS DOUBLE) AS md,
  CASE WHEN l_discount < 0.02 THEN {_SENTINEL!r} ELSE l_quantity END AS raw FROM lineitem)
SELECT path, CAST(dense_rank() OVER (PARTITION BY path ORDER BY flag) - 1 AS INT) AS document, CAST(row_number() OVER (PARTITION BY path, flag ORDER BY md, raw) - 1 AS INT) AS sample_index,
  md, raw AS raw_value, raw = {_SENTINEL!r} AS is_null FROM l""")
def container_log_samples(spark, d):
    """Orders as well logs: packed to a container for each supplier, decoded in runs and slices, and read as samples."""
    raw = F.when(F.col("l_discount") < 0.02, F.lit(_SENTINEL)).otherwise(F.col("l_quantity"))
    md = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("double")
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("path"), F.col("l_returnflag").alias("flag"), F.struct(md.alias("md"), raw.alias("raw")).alias("s"))
    logs = rows.groupBy("path", "flag").agg(F.array_sort(F.collect_list("s")).alias("s"))
    one = F.struct("flag", F.col("s.md").alias("md"), F.col("s.raw").alias("raw"))
    containers = _packed(logs.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("documents")), _log)
    return S.streamed_log_samples(_decoded(spark, containers, 4096, 64))


def _well(w):
    """A subject of a customer; every some a departure from the profile."""
    k = w["k"]
    tag, provider = (uuid.UUID(w[c]) for c in ("tag", "provider"))
    level = lambda name, offset: packing.element(name, packing.scalar("name", "KB"), packing.scalar("offset", offset), packing.scalar("description", f"level {k}"))
    parts = [packing.scalar(W.TAG, str(tag) if k % 2 else tag), packing.scalar(W.NAME, "" if k % 13 == 5 else w["name"])]
    parts += [] if k % 23 == 1 else [packing.scalar(W.UWI, f"uwi {k}")]
    parts += [packing.scalar(W.PROVIDER, 0 if k % 17 == 7 else provider)]
    parts += [packing.element(W.HEAD, packing.array("double", [w["x"], float(k)] + [1.0] * (k % 19 == 2)))]
    parts += [level(W.LEVEL, float("nan") if k % 29 == 4 else k / 2), packing.element(W.LEVELS, *(level(W.ITEM, float(i)) for i in range(k % 3)), Size=k % 3 + (k % 41 == 9))]
    parts += [packing.scalar(W.CONVERGENCE, -0.25)]
    version = [34, *W.VERSION[1:]] if k % 11 == 3 else list(W.VERSION)
    return packing.element(W.SUBJECT, *parts, namespace=W.NAMESPACE, Version=version)


def _wells(spark, d):
    """Node rows of containers of 500 customers."""
    k = F.col("c_custkey")
    tag = F.md5(F.concat(F.lit("well"), (k - (k % 37 == 8).cast("int")).cast("string")))
    provider = F.md5(F.concat(F.lit("provider"), (k - (k % 31 == 6).cast("int")).cast("string")))
    one = F.struct(k.alias("k"), tag.alias("tag"), provider.alias("provider"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("x"))
    rows = table(spark, d, "customer").groupBy(F.concat(F.lit("w"), F.floor(k / 500)).alias("path")).agg(F.array_sort(F.collect_list(one)).alias("documents"))
    return settle(_decoded(spark, _packed(rows, _well), 8192, 64), "nodes")


_WELLS = """w AS (SELECT c_custkey AS k, 'w' || (c_custkey // 500) AS path, CAST(row_number() OVER (PARTITION BY c_custkey // 500 ORDER BY c_custkey) - 1 AS INT) AS document,
  regexp_replace(md5('well' || (c_custkey - CAST(c_custkey % 37 = 8 AS INT))), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') AS tag,
  CASE WHEN c_custkey % 17 <> 7 THEN regexp_replace(md5('provider' || (c_custkey - CAST(c_custkey % 31 = 6 AS INT))), '(.{8})(.{4})(.{4})(.{4})(.{12})', '\\1-\\2-\\3-\\4-\\5') END AS provider,
  CASE WHEN c_custkey % 13 <> 5 THEN c_name ELSE '' END AS name, c_acctbal AS x, CAST(c_custkey AS DOUBLE) AS y FROM customer),
s AS (SELECT *, CASE WHEN k % 11 = 3 THEN 'rejected: profile' WHEN k % 19 = 2 THEN 'rejected: head' ELSE 'recorded' END AS first FROM w),
t AS (SELECT *, CASE WHEN first = 'recorded' AND count(*) FILTER (first = 'recorded') OVER (PARTITION BY tag) > 1 THEN 'duplicate' ELSE first END AS status FROM s)"""


@P.query(f"""WITH {_WELLS} SELECT path, document, status, CASE WHEN status = 'recorded' THEN tag END AS object_id, CASE WHEN status = 'recorded' THEN name END AS name,
  CASE WHEN status = 'recorded' THEN provider END AS provider_id, CASE WHEN status = 'recorded' THEN x END AS x, CASE WHEN status = 'recorded' THEN y END AS y,
  CASE WHEN status = 'recorded' AND k % 23 <> 1 THEN 'uwi ' || k END AS uwi, CASE WHEN status = 'recorded' AND k % 29 <> 4 THEN k / 2 END AS level_offset,
  CASE WHEN status = 'recorded' AND k % 41 <> 9 THEN k % 3 END AS n_levels, CASE WHEN status = 'recorded' THEN -0.25::DOUBLE END AS convergence,
  CASE WHEN status = 'recorded' THEN concat_ws(',', CASE WHEN k % 23 = 1 THEN 'uwi_:not present' END, CASE WHEN k % 29 = 4 THEN 'working_reference_level:outside the profile' END,
    CASE WHEN k % 41 = 9 THEN 'reference_levels:outside the profile' END) END AS gaps FROM t""")
def well_subjects(spark, d):
    """Typed subjects out of packed containers, departures and all."""
    found = W.subjects(_wells(spark, d))
    gaps = F.array_join(F.transform("gaps", lambda g: F.concat(g["field"], F.lit(":"), g["reason"])), ",")
    return found.select(
        "path", "document", "status", "object_id", "name", "provider_id", "x", "y", "uwi", F.col("working_level.offset").alias("level_offset"),
        F.when(F.col("levels").isNotNull(), F.size("levels")).cast("long").alias("n_levels"), "convergence", gaps.alias("gaps"),
    )


@P.query(f"""WITH {_WELLS}, h AS (SELECT *, CASE WHEN name = '' THEN 'rejected: name' WHEN k % 19 = 2 THEN 'rejected: coordinates' ELSE 'decoded' END AS head FROM t),
g AS (SELECT *, CASE WHEN head = 'decoded' THEN provider END AS p, count(*) FILTER (head = 'decoded') OVER (PARTITION BY provider) AS claims,
  count(*) FILTER (status = 'recorded') OVER (PARTITION BY provider) AS owners FROM h),
e AS (SELECT *, CASE WHEN p IS NULL OR claims <> 1 OR owners <> 1 THEN 'unresolved' WHEN status = 'recorded' THEN 'exact' ELSE 'conflict' END AS identity FROM g)
SELECT path, document, document AS subject, head AS status, CASE WHEN head = 'decoded' THEN name END AS well_name, p AS provider_id,
  CASE WHEN head = 'decoded' THEN CASE WHEN provider IS NULL THEN 'unrecognized' ELSE 'exact' END END AS provider_status,
  CASE WHEN head = 'decoded' THEN x END AS x, CASE WHEN head = 'decoded' THEN y END AS y, CASE WHEN head = 'decoded' THEN 1 END AS same_name, identity,
  CASE WHEN identity = 'exact' THEN tag END AS object_id, CASE WHEN identity = 'exact' AND k % 23 <> 1 THEN 'uwi ' || k END AS uwi FROM e""")
def well_heads_bound(spark, d):
    """Heads out of the same containers and their exact binding to subjects."""
    nodes = _wells(spark, d)
    found = settle(W.fields(nodes), "fields")
    return W.bound_heads(settle(W.heads(nodes, found), "heads"), settle(W.subjects(nodes, found), "subjects"))
