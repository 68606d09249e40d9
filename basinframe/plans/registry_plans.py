"""Versions, blobs, manifests and differences."""

from pyspark.sql import functions as F

from ..operators import registry as R
from ..sources import views as V
from .base import Plans

P = Plans()
_REGISTRY = """registry AS (SELECT o_custkey AS droid, o_orderstatus AS name, strftime(o_orderdate, '%Y-%m-%d') AS version,
  o_orderkey AS data_pk, o_orderpriority AS blob_type FROM orders)"""
_MANIFEST = """manifest AS (SELECT doc_id AS path, sha256(text) AS sha256, n_chars AS bytes, source AS kind, lang AS format FROM documents)"""
TYPES = ("1-URGENT", "2-HIGH")


@P.query(f"""WITH {_REGISTRY}, r AS (SELECT *, row_number() OVER (PARTITION BY droid, name ORDER BY version DESC, data_pk DESC) AS k FROM registry)
SELECT droid, name, version, data_pk, blob_type FROM r WHERE k = 1 AND blob_type IN ('1-URGENT', '2-HIGH')""")
def latest_registry_version(spark, d):
    """Latest version of each object, then the type filter."""
    return R.latest_then_filter(V.registry(spark, d), ["droid", "name"], ["version", "data_pk"], F.col("blob_type").isin(*TYPES))


@P.query(f"""WITH {_REGISTRY}, r AS (SELECT *, row_number() OVER (PARTITION BY droid, blob_type ORDER BY version DESC, data_pk DESC) AS k
  FROM registry WHERE blob_type IN ('1-URGENT', '2-HIGH')) SELECT droid, name, version, data_pk, blob_type FROM r WHERE k = 1""")
def latest_of_type(spark, d):
    """The type filter, then the latest version of each object and type."""
    rows = V.registry(spark, d).where(F.col("blob_type").isin(*TYPES))
    return R.latest(rows, ["droid", "blob_type"], ["version", "data_pk"]).select("droid", "name", "version", "data_pk", "blob_type")


@P.query(f"""WITH {_REGISTRY}, r AS (SELECT *, row_number() OVER (PARTITION BY droid ORDER BY version DESC, data_pk DESC) AS k FROM registry),
a AS (SELECT droid FROM r WHERE k = 1 AND blob_type = '5-LOW'), b AS (SELECT DISTINCT droid FROM registry WHERE blob_type = '5-LOW')
SELECT droid, CASE WHEN a.droid IS NULL THEN 'filtered_before' ELSE 'both' END AS visible FROM b LEFT JOIN a USING (droid)""")
def latest_before_after_filter_diff(spark, d):
    """Objects that only a filter before the latest-version step lets through."""
    rows, low = V.registry(spark, d), F.col("blob_type") == "5-LOW"
    after = R.latest_then_filter(rows, ["droid"], ["version", "data_pk"], low).select("droid", F.lit("both").alias("visible"))
    before = rows.where(low).select("droid").distinct()
    return before.join(after, "droid", "left").select("droid", F.coalesce("visible", F.lit("filtered_before")).alias("visible"))


@P.query("""SELECT conv_id, count(*) AS parts, CASE WHEN min(turn) = 0 AND max(turn) + 1 = count(*) AND count(DISTINCT turn) = count(*)
  THEN sha256(string_agg(text, '' ORDER BY turn, text)) END AS sha256, CASE WHEN min(turn) = 0 AND max(turn) + 1 = count(*)
  AND count(DISTINCT turn) = count(*) THEN 'complete' ELSE 'gap' END AS status FROM conversations GROUP BY conv_id""")
def blob_reassembly(spark, d):
    """Ordered parts of each payload as one."""
    whole = R.reassembled(V.table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")
    return whole.select("conv_id", "parts", F.sha2("text", 256).alias("sha256"), "status")


@P.query(f"""WITH {_MANIFEST}, a AS (SELECT path, sha256 FROM manifest WHERE path % 10 <> 1),
b AS (SELECT path, CASE WHEN path % 7 = 3 THEN sha256(sha256) ELSE sha256 END AS sha256 FROM manifest WHERE path % 10 <> 2)
SELECT coalesce(a.path, b.path) AS path, a.sha256 AS was, b.sha256 AS now, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed'
  WHEN a.sha256 = b.sha256 THEN 'unchanged' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.path = b.path""")
def manifest_diff(spark, d):
    """Two deliveries of one package by path and hash."""
    m = V.manifest(spark, d).select("path", "sha256")
    a = m.where("path % 10 <> 1")
    b = m.where("path % 10 <> 2").withColumn("sha256", F.when(F.col("path") % 7 == 3, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    return R.keyed_diff(a, b, "path", "sha256")


@P.query(f"""WITH {_MANIFEST} SELECT kind, format, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (bytes < 1000) AS small,
  min(bytes) AS least, max(bytes) AS most FROM manifest GROUP BY kind, format""")
def manifest_status_counts(spark, d):
    """Files and bytes by kind and format."""
    return V.manifest(spark, d).groupBy("kind", "format").agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes") < 1000).alias("small"),
        F.min("bytes").alias("least"), F.max("bytes").alias("most"),
    )


@P.query(f"""WITH {_MANIFEST}, g AS (SELECT bytes, sha256, min(path) AS survivor, count(*) AS copies FROM manifest GROUP BY bytes, sha256)
SELECT path, survivor, copies FROM manifest JOIN g USING (bytes, sha256)""")
def content_dedup(spark, d):
    """Equal files: a cheap size group, then the full hash."""
    return R.content_groups(V.manifest(spark, d), "path", ["bytes"], "sha256")


@P.query("""WITH g AS (SELECT l_partkey, count(DISTINCT l_tax) AS declared FROM lineitem GROUP BY l_partkey)
SELECT l_partkey, l_orderkey, declared, CASE WHEN declared > 1 THEN 'conflict' ELSE 'pass' END AS status
FROM lineitem JOIN g USING (l_partkey)""")
def artifact_conflict_owners(spark, d):
    """Every owner of an artifact that is declared in more than one way."""
    rows = V.table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_tax")
    return R.shared_owner_conflicts(rows, "l_partkey", "l_orderkey", ["l_tax"])


@P.query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def missing_deliveries(spark, d):
    """Decoded but not delivered: an anti-join."""
    o = V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return o.join(V.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@P.query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def accepted_semi(spark, d):
    """Objects that some accepted row names."""
    c = V.table(spark, d, "customer").select("c_custkey", "c_name")
    done = V.table(spark, d, "orders").where("o_orderstatus = 'F'")
    return c.join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@P.query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_partkey % 5 <> 4
UNION ALL SELECT p_partkey, p_retailprice + 1 FROM part WHERE p_partkey % 5 = 4 AND p_partkey % 3 = 0""")
def manifest_upsert(spark, d):
    """Changed rows replace those of their key; new ones are added."""
    p = V.table(spark, d, "part").select("p_partkey", "p_retailprice")
    changes = p.where("p_partkey % 3 = 0").withColumn("p_retailprice", F.col("p_retailprice") + 1)
    return R.upsert(p.where("p_partkey % 5 <> 4"), changes, "p_partkey")


@P.query("""WITH b AS (SELECT source, doc_id // 64 AS bucket, sha256(string_agg(sha256(doc_id || ' ' || n_chars || ' ' || lang), '' ORDER BY doc_id)) AS part
  FROM documents GROUP BY source, doc_id // 64)
SELECT source AS kind, sha256(string_agg(part, '' ORDER BY bucket)) AS fingerprint FROM b GROUP BY source""")
def package_fingerprint(spark, d):
    """A hash of each package's ordered file lines, by ranges of paths first."""
    return R.fingerprint(V.manifest(spark, d), "kind", "path", F.floor(F.col("path") / 64), "bytes", "format")


@P.query("""SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value, count(*) AS seen, count(DISTINCT event_type) > 1 AS conflict
FROM events GROUP BY user_id""")
def first_event_wins(spark, d):
    """The first event of each identity; repeats that differ are flagged."""
    e = V.table(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    return R.first_of_repeats(e, "user_id", ["event_id"], F.col("event_type")).select("user_id", "event_id", "value", "seen", "conflict")


@P.query("""SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey,
  l_partkey, l_linenumber, l_quantity, l_extendedprice) - 1 AS record_index FROM lineitem""")
def record_numbers(spark, d):
    """Rows of each object numbered in a total order."""
    cols = ["l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"]
    out = R.numbered(V.table(spark, d, "lineitem").select(*cols), ["l_suppkey"], cols[1:])
    return out.withColumn("record_index", F.col("record_index").cast("long"))


@P.query(f"""WITH {_MANIFEST} SELECT sha256, bytes, count(*) AS passes, CAST(sum(bytes) AS BIGINT) AS hashed, CAST(sum(bytes) - max(bytes) AS BIGINT) AS repeated
FROM manifest GROUP BY sha256, bytes""")
def hash_pass_totals(spark, d):
    """How often each content was hashed, and the bytes that repeats cost."""
    return V.manifest(spark, d).groupBy("sha256", "bytes").agg(
        F.count("*").alias("passes"), F.sum("bytes").alias("hashed"), (F.sum("bytes") - F.max("bytes")).alias("repeated")
    )


@P.query(f"""WITH {_MANIFEST}, r AS (SELECT kind, path, bytes, row_number() OVER (PARTITION BY kind ORDER BY bytes DESC, path) AS k FROM manifest)
SELECT kind, path, bytes, k AS place FROM r WHERE k <= 3""")
def largest_by_kind(spark, d):
    """The three largest files of each kind."""
    m = V.manifest(spark, d).select("kind", "path", "bytes")
    k = F.row_number().over(R.Window.partitionBy("kind").orderBy(F.desc("bytes"), "path"))
    return m.withColumn("place", k.cast("long")).where("place <= 3")


@P.query(f"""WITH {_MANIFEST} SELECT path, bytes FROM manifest ORDER BY bytes DESC, path LIMIT 20""")
def top_k_largest(spark, d):
    """The twenty largest files: a top-k, no full sort."""
    return V.manifest(spark, d).select("path", "bytes").orderBy(F.desc("bytes"), "path").limit(20)


@P.query("""SELECT path, array_to_string(list_sort(list_filter([CASE WHEN NOT regexp_matches(sha, '^[0-9a-f]{64}$') THEN 'BAD_HASH' END,
  CASE WHEN size < 20 THEN 'TOO_SMALL' END, CASE WHEN path IS NULL THEN 'NO_PATH' END, CASE WHEN text LIKE '%%%' THEN 'x' END], lambda x: x IS NOT NULL AND x <> 'x')), ',') AS codes
FROM (SELECT doc_id AS path, text, CASE WHEN doc_id % 50 = 0 THEN 'none' ELSE sha256(text) END AS sha, n_chars AS size FROM documents)""")
def manifest_validation(spark, d):
    """Each row's broken rules."""
    m = V.manifest(spark, d).withColumn("sha256", F.when(F.col("path") % 50 == 0, "none").otherwise(F.col("sha256")))
    rules = [(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "BAD_HASH"), (F.col("bytes") < 20, "TOO_SMALL"), (F.col("path").isNull(), "NO_PATH")]
    codes = F.array_compact(F.array(*[F.when(c, code) for c, code in rules]))
    return m.select("path", F.array_join(F.array_sort(codes), ",").alias("codes"))
