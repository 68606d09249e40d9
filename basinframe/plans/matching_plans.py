"""Joins with a status, and what they agree on."""

from pyspark.sql import functions as F

from ..operators import binding as B
from ..operators import matching as M
from ..sources import views as V
from .base import Plans

P = Plans()


@P.query("""WITH h AS (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS k FROM customer), t AS (SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS k FROM supplier),
a AS (SELECT k, count(*) AS n FROM h GROUP BY k), b AS (SELECT k, count(*) AS n, min(s_suppkey) AS one FROM t GROUP BY k)
SELECT c_custkey, h.k, CASE WHEN b.n IS NULL THEN 'unresolved' WHEN a.n > 1 AND b.n > 1 THEN 'ambiguous_both' WHEN a.n > 1 THEN 'ambiguous_left' WHEN b.n > 1 THEN 'ambiguous_right' ELSE 'matched' END AS status,
  CASE WHEN a.n = 1 AND b.n = 1 THEN b.one END AS match FROM h JOIN a USING (k) LEFT JOIN b USING (k)""")
def unique_match_status(spark, d):
    """Heads and tracks by a key that must be unique on both sides."""
    heads = V.table(spark, d, "customer").select("c_custkey", F.floor("c_acctbal").alias("k"))
    tracks = V.table(spark, d, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("k"))
    return M.unique_match(heads, tracks, "k", "c_custkey", "s_suppkey")


@P.query("""WITH e AS (SELECT event_id, user_id % 10 AS k, date_diff('second', TIMESTAMP '1970-01-01', ts) AS p FROM events WHERE event_type = 'click'),
n AS (SELECT user_id % 10 AS k, date_diff('second', TIMESTAMP '1970-01-01', ts) AS p, event_type || '-' || user_id AS name FROM events WHERE event_type <> 'click'),
g AS (SELECT event_id, name, min(abs(e.p - n.p)) AS gap FROM e JOIN n ON e.k = n.k AND abs(e.p - n.p) <= 128 GROUP BY event_id, name),
b AS (SELECT event_id, min(gap) AS gap FROM g GROUP BY event_id), t AS (SELECT event_id, gap, count(*) AS names, min(name) AS name FROM g JOIN b USING (event_id, gap) GROUP BY event_id, gap)
SELECT event_id, CASE WHEN names = 1 THEN name END AS name, gap, coalesce(names, 0) AS names FROM e LEFT JOIN t USING (event_id)""")
def band_nearest_name(spark, d):
    """The nearest name within 128 positions; a tie between names is null."""
    p = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    e = V.table(spark, d, "events").select("event_id", "user_id", "event_type", (F.col("user_id") % 10).alias("k"), p.cast("long").alias("p"))
    left = e.where("event_type = 'click'")
    right = e.where("event_type <> 'click'").withColumn("name", F.concat_ws("-", "event_type", F.col("user_id").cast("string")))
    return M.nearest_in_band(left, right, "k", "p", "name", 128, "event_id")


@P.query("""WITH f AS (SELECT l_suppkey AS s, min(struct_pack(o := l_orderkey, p := l_partkey, x := l_quantity, y := l_extendedprice)) AS r FROM lineitem GROUP BY l_suppkey)
SELECT s_suppkey, round(abs(s_acctbal - r.y), 6) AS gap, CASE WHEN r IS NULL THEN 'no_track' WHEN round(abs(s_acctbal - r.y), 6) <= 20000 THEN 'confirmed' ELSE 'conflict' END AS status
FROM supplier LEFT JOIN f ON s_suppkey = s""")
def head_track_crosscheck(spark, d):
    """Well heads against the first station of their track."""
    heads = V.table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("y"))
    rows = V.table(spark, d, "lineitem")
    first = rows.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.min(F.struct("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")).alias("r"))
    return M.cross_check(heads, first.select("s_suppkey", F.col("r.l_extendedprice").alias("y")), "s_suppkey", ["y"], 20000.0)


@P.query("""WITH p AS (SELECT DISTINCT p_size AS g, p_brand AS code, p_type AS label FROM part), c AS (SELECT g, code, count(*) AS n FROM p GROUP BY ALL),
l AS (SELECT g, label, count(*) AS n FROM p GROUP BY ALL), a AS (SELECT g, max(n) AS labels_per_code, count(*) AS codes FROM c GROUP BY g),
b AS (SELECT g, max(n) AS codes_per_label, count(*) AS labels FROM l GROUP BY g)
SELECT g, labels_per_code, codes, codes_per_label, labels, labels_per_code = 1 AND codes_per_label = 1 AS bijective FROM a JOIN b USING (g)""")
def bijection_check(spark, d):
    """Whether codes and labels stand one to one in each group."""
    p = V.table(spark, d, "part").select(F.col("p_size").alias("g"), F.col("p_brand").alias("code"), F.col("p_type").alias("label"))
    return M.bijection(p, ["g"], "code", "label")


@P.query("""SELECT l_suppkey, count(*) AS n, bool_and(l_discount <= 0.1 AND l_quantity >= 1 AND l_tax < 0.08 + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END) AS accepted FROM lineitem GROUP BY l_suppkey""")
def attribute_bind_gate(spark, d):
    """All rows of an object bind, or none."""
    rows = V.table(spark, d, "lineitem").select("l_suppkey", "l_discount", "l_quantity", "l_tax")
    limit = F.lit(0.08) + F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0)
    return M.gate(rows, "l_suppkey", (F.col("l_discount") <= 0.1) & (F.col("l_quantity") >= 1) & (F.col("l_tax") < limit))


@P.query("""WITH a AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS a FROM part),
b AS (SELECT regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g') AS b, n_nationkey AS k FROM nation UNION ALL SELECT regexp_replace(lower(w), '[^a-z0-9]+', '', 'g'), 100 + i FROM (VALUES ('ring', 1), ('red widget x', 2), ('Gizmo', 3), ('bo', 4), ('bolt', 5)) t(w, i)),
m AS (SELECT a, min(k) AS k FROM (SELECT DISTINCT a FROM a WHERE length(a) >= 3) JOIN b ON length(b) >= 3 AND (contains(b, a) OR contains(a, b)) GROUP BY a)
SELECT p_partkey, k AS match FROM a LEFT JOIN m USING (a)""")
def name_containment_match(spark, d):
    """The first inventory name that contains a row's name or lies in it."""
    inventory = V.table(spark, d, "nation").select(F.col("n_name").alias("item"), F.col("n_nationkey").alias("k"))
    extra = spark.createDataFrame([("ring", 101), ("red widget x", 102), ("Gizmo", 103), ("bo", 104), ("bolt", 105)], "item string, k int")
    rows = V.table(spark, d, "part").select("p_partkey", "p_name")
    return M.names_contained(rows, inventory.union(extra), "p_partkey", "p_name", "item", "k")


@P.query("""WITH p AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), r AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') AS root FROM p WHERE page_id % 2 = 0
  UNION SELECT DISTINCT string_split(path, '/')[1] FROM p WHERE page_id % 3 = 0), m AS (SELECT path, arg_max(root, length(root)) AS root FROM p JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY path)
SELECT DISTINCT path, root FROM p LEFT JOIN m USING (path)""")
def longest_root_alias(spark, d):
    """Each path's longest known root."""
    p = V.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))
    parts = F.split("path", "/")
    roots = p.where("page_id % 2 = 0").select(F.array_join(F.slice(parts, 1, 2), "/").alias("root"))
    roots = roots.union(p.where("page_id % 3 = 0").select(F.get(parts, 0))).distinct()
    return M.longest_root(p.select("path").distinct(), roots, "path", "root")


@P.query("""WITH a AS (SELECT conv_id, turn, length(text) AS v FROM conversations WHERE role = 'user'), n AS (SELECT conv_id, turn - 1 AS turn, length(text) AS v FROM conversations WHERE role = 'assistant')
SELECT coalesce(a.conv_id, n.conv_id) AS conv_id, coalesce(a.turn, n.turn) AS turn, a.v AS "left", n.v AS "right", a.v IS NOT NULL AND n.v IS NOT NULL AS paired
FROM a FULL JOIN n ON a.conv_id = n.conv_id AND a.turn = n.turn""")
def positional_zip(spark, d):
    """Questions and answers side by side; a missing one is marked."""
    c = V.table(spark, d, "conversations").select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("v"))
    return M.zipped(c.where("role = 'user'"), c.where("role = 'assistant'").withColumn("turn", F.col("turn") - 1), ["conv_id"], "turn", "v")


@P.query("""WITH p AS (SELECT l_returnflag AS g, l_extendedprice AS a, CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE round(l_extendedprice, 1) END AS b FROM lineitem)
SELECT g, count(*) AS n, bool_and((a IS NULL) = (b IS NULL)) AS nulls_agree, round(max(abs(a - b)), 6) AS most_error, CAST(sum(CAST(abs(a - b) AS DECIMAL(18,6))) AS DOUBLE) / count(a - b) AS mean_error, coalesce(max(abs(a - b)), 0) <= 0.051 AS within FROM p GROUP BY g""")
def numeric_agreement(spark, d):
    """Error statistics of a reread column."""
    b = F.when(F.col("l_orderkey") % 101 != 0, F.round("l_extendedprice", 1))
    rows = V.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("a"), b.alias("b"))
    return M.agreement(rows, ["g"], "a", "b", 0.051)


@P.query("""WITH c AS (SELECT p_partkey AS k, p_partkey % 700 AS target FROM part WHERE p_size = 7), h AS (SELECT l_partkey AS k, count(*) AS hits FROM lineitem WHERE l_linenumber = 1 GROUP BY k), u AS (SELECT target, count(*) AS uses FROM c GROUP BY target),
r AS (SELECT c.k, c.target, coalesce(hits, 0) AS hits, uses, coalesce(hits, 0) = 1 AND uses = 1 AS ok FROM c LEFT JOIN h USING (k) JOIN u USING (target))
SELECT k, target, hits, uses, ok, (SELECT bool_and(ok) FROM r) AS applied FROM r""")
def reference_map_gate(spark, d):
    """Replacements that must each hit exactly one row, all or nothing."""
    changes = V.table(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 700).alias("target"))
    rows = V.table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("k"))
    return M.exactly_one_target(changes, rows, "k", "target")


@P.query("""WITH a AS (SELECT event_id, user_id AS k, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id AS k, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT a.event_id, a.k, b.value FROM a ASOF LEFT JOIN b ON a.k = b.k AND a.ts >= b.ts""")
def as_of_value(spark, d):
    """The last view at or before each purchase."""
    e = V.table(spark, d, "events").select("event_id", F.col("user_id").alias("k"), "ts", "event_type", "value")
    right = e.where("event_type = 'view'").groupBy("k", "ts").agg(F.max("value").alias("value"))
    out = M.latest_before(e.where("event_type = 'purchase'").select("event_id", "k", "ts"), right, "k", "ts", "value")
    return out.select("event_id", "k", "value")


@P.query("""WITH s AS (SELECT s_suppkey AS g, 1 AS o, s_acctbal AS x FROM supplier UNION ALL SELECT s_suppkey, 2, s_acctbal + 5 FROM supplier), r AS (SELECT s_suppkey AS c, 1 AS o, s_acctbal + 0.004 * (s_suppkey % 5) AS x FROM supplier UNION ALL SELECT s_suppkey, 2, s_acctbal + 5 FROM supplier),
m AS (SELECT g, c, max(abs(s.x - r.x)) AS gap FROM s JOIN r USING (o) GROUP BY g, c HAVING count(*) = 2), k AS (SELECT g, count(*) AS n, min(c) AS one FROM m WHERE gap <= 0.01 GROUP BY g)
SELECT s_suppkey AS g, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN one END AS match FROM supplier LEFT JOIN k ON s_suppkey = g""")
def point_set_calibration(spark, d):
    """Point sets that lie on exactly one reference set within a tolerance."""
    s = V.table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    sets = s.select(F.col("s_suppkey").alias("g"), F.posexplode(F.array("s_acctbal", F.col("s_acctbal") + 5)).alias("o", "x"))
    moved = F.col("s_acctbal") + 0.004 * (F.col("s_suppkey") % 5)
    refs = s.select(F.col("s_suppkey").alias("c"), F.posexplode(F.array(moved, F.col("s_acctbal") + 5)).alias("o", "x"))
    return M.similar_sets(sets, refs, "g", "c", "o", ["x"], 0.01)


_HEADS = """h AS (SELECT s_suppkey AS head, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_name END AS name, s_nationkey AS x, round(s_acctbal, 0) AS y, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 3 END AS provider, s_suppkey // 2 AS slot FROM supplier),
w AS (SELECT well, CASE WHEN well % 9 = 0 THEN NULL ELSE name END AS name, CASE WHEN well % 5 = 0 THEN x + 1 ELSE x END AS x, y, provider, slot FROM (
  SELECT s_suppkey AS well, s_name AS name, s_nationkey AS x, round(s_acctbal, 0) AS y, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 3 END AS provider, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_suppkey // 2 END AS slot FROM supplier)
  UNION ALL SELECT s_suppkey + 1000000, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_name END, s_nationkey, round(s_acctbal, 0), CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_suppkey % 3 END, NULL FROM supplier WHERE s_suppkey % 11 = 0)"""


@P.query(f"""WITH {_HEADS}, e AS (SELECT head, count(well) AS n, min(well) AS one FROM h LEFT JOIN w ON h.name IS NOT DISTINCT FROM w.name AND h.x = w.x AND h.y = w.y AND h.provider IS NOT DISTINCT FROM w.provider GROUP BY head),
s AS (SELECT slot, count(DISTINCT well) AS n, min(well) AS one FROM w WHERE slot IS NOT NULL GROUP BY slot)
SELECT head, CASE WHEN e.n = 1 THEN e.one WHEN e.n = 0 AND s.n = 1 THEN s.one END AS well, CASE WHEN e.n = 1 THEN 'exact' WHEN e.n > 1 THEN 'ambiguous' WHEN s.n = 1 THEN 'fallback_identity' WHEN s.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status
FROM h JOIN e USING (head) LEFT JOIN s USING (slot)""")
def typed_head_match(spark, d):
    """Head rows and typed wells that agree in name, place and provider, else in their slot."""
    s = V.table(spark, d, "supplier")
    k = F.col("s_suppkey")
    name, x, y = F.col("s_name"), F.col("s_nationkey"), F.round("s_acctbal", 0)
    provider, slot = F.when(k % 4 != 0, k % 3), F.floor(k / 2)
    heads = s.select(k.alias("head"), F.when(k % 9 != 0, name).alias("name"), x.alias("x"), y.alias("y"), provider.alias("provider"), slot.alias("slot"))
    wells = s.select(k.alias("well"), F.when(k % 9 != 0, name).alias("name"), F.when(k % 5 == 0, x + 1).otherwise(x).alias("x"), y.alias("y"), provider.alias("provider"), F.when(k % 7 != 0, slot).alias("slot"))
    again = s.where(k % 11 == 0).select((k + 1_000_000).alias("well"), F.when(k % 9 != 0, name), x, y, provider, F.lit(None).cast("long"))
    return B.heads_matched(heads, wells.union(again), ["name", "x", "y", "provider"], "slot", "well").select("head", "well", "status")


@P.query("""WITH b AS (SELECT l_suppkey, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1 FROM lineitem GROUP BY 1),
c AS (SELECT *, CASE l_suppkey % 6 WHEN 0 THEN x0 WHEN 1 THEN x0 + 0.0005 WHEN 2 THEN x0 - 5 WHEN 3 THEN -x1 WHEN 4 THEN x0 + 1 END AS p0, CASE l_suppkey % 6 WHEN 2 THEN x1 + 5 WHEN 3 THEN -x0 ELSE x1 END AS p1,
  CASE WHEN l_suppkey % 6 = 3 THEN -y1 ELSE y0 END AS q0, CASE WHEN l_suppkey % 6 = 3 THEN -y0 ELSE y1 END AS q1 FROM b)
SELECT l_suppkey, CASE WHEN p0 IS NULL THEN 'unresolved' WHEN p0 = x0 AND p1 = x1 AND q0 = y0 AND q1 = y1 THEN 'exact'
  WHEN abs(p0 - x0) <= 1e-3 AND abs(p1 - x1) <= 1e-3 AND abs(q0 - y0) <= 1e-3 AND abs(q1 - y1) <= 1e-3 THEN 'tolerance'
  WHEN p0 <= x0 + 1e-3 AND p1 >= x1 - 1e-3 AND q0 <= y0 + 1e-3 AND q1 >= y1 - 1e-3 THEN 'enclosing'
  WHEN abs(-p1 - x0) <= 1e-3 AND abs(-p0 - x1) <= 1e-3 AND abs(-q1 - y0) <= 1e-3 AND abs(-q0 - y1) <= 1e-3 THEN 'sign_flipped' ELSE 'conflict' END AS state FROM c""")
def model_bounds(spark, d):
    """Declared bounds of objects against what their samples span."""
    b = V.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), F.min("l_discount").alias("y0"), F.max("l_discount").alias("y1"))
    m = F.col("l_suppkey") % 6
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    p0 = F.when(m == 0, x0).when(m == 1, x0 + 0.0005).when(m == 2, x0 - 5).when(m == 3, -x1).when(m == 4, x0 + 1)
    p1 = F.when(m == 2, x1 + 5).when(m == 3, -x0).otherwise(x1)
    q0, q1 = F.when(m == 3, -y1).otherwise(y0), F.when(m == 3, -y0).otherwise(y1)
    return b.select("l_suppkey", B.bounds_state((p0, p1, x0, x1), (q0, q1, y0, y1)).alias("state"))


@P.query("""WITH a AS (SELECT p_partkey AS k, p_brand AS domain, CASE WHEN p_size % 6 = 0 THEN 'unknown' ELSE p_type END AS unit, CAST(p_size AS VARCHAR) AS lattice FROM part),
b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 13 = 0 THEN 'Brand#0' ELSE p_brand END AS domain, p_type AS unit, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size + CAST(p_partkey % 19 = 0 AS INT) AS VARCHAR) END AS lattice FROM part),
c AS (SELECT k, a.domain <> b.domain AS d, b.lattice IS NOT NULL AND a.lattice <> b.lattice AS l, b.lattice IS NULL AS ul, a.unit = 'unknown' AS uu FROM a JOIN b USING (k))
SELECT k, CASE WHEN d OR l THEN 'conflict' WHEN ul OR uu THEN 'unknown_fields' ELSE 'compatible' END AS status,
  array_to_string(list_filter([CASE WHEN d THEN 'domain' END, CASE WHEN l THEN 'lattice' END], lambda x: x IS NOT NULL), ',') AS conflicts,
  array_to_string(list_filter([CASE WHEN ul THEN 'lattice' END, CASE WHEN uu THEN 'unit' END], lambda x: x IS NOT NULL), ',') AS unknown FROM c""")
def calculation_check(spark, d):
    """Whether two surfaces may be calculated with: conflicting and unknown metadata."""
    p = V.table(spark, d, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    a = p.select(k.alias("k"), F.col("p_brand").alias("domain"), F.when(size % 6 == 0, "unknown").otherwise(F.col("p_type")).alias("unit"), size.cast("string").alias("lattice"))
    other = (size + (k % 19 == 0).cast("int")).cast("string")
    b = p.select(k.alias("k"), F.when(k % 13 == 0, "Brand#0").otherwise(F.col("p_brand")).alias("domain"), F.col("p_type").alias("unit"), F.when(k % 17 != 0, other).alias("lattice"))
    return B.metadata_checked(a, b, "k", ["domain", "unit", "lattice"])


@P.query("""WITH f AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest, unnest([source, CASE WHEN doc_id % 50 = 0 THEN lang || CAST(doc_id AS VARCHAR) END]) AS role FROM documents)
SELECT role, count(DISTINCT digest) AS contents, CASE WHEN count(DISTINCT digest) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
  CASE WHEN count(DISTINCT digest) = 1 THEN min(doc_id) END AS path, CASE WHEN count(DISTINCT digest) = 1 THEN min(digest) END AS digest FROM f WHERE role IS NOT NULL GROUP BY role""")
def source_roles(spark, d):
    """Which file plays which role of a project, if its content is not in doubt."""
    t = V.table(spark, d, "documents")
    files = t.select(F.col("doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "source", "lang")
    roles = F.array_compact(F.array("source", F.when(F.col("path") % 50 == 0, F.concat("lang", F.col("path").cast("string")))))
    return B.roles_of(files, "path", "digest", roles)
