"""Bindings and assessments."""

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import assessment as A
from ..operators import binding as B
from ..operators import catalogue as K
from ..operators.scan import ranged
from ..sources import views as V
from .base import Plans
from .catalogue_plans import _NEEDS

P = Plans()


@P.query("""WITH n AS (SELECT p_brand AS tag, p_type AS class, min(p_partkey) AS linked FROM part WHERE p_size <= 25 GROUP BY ALL), t AS (SELECT DISTINCT tag FROM n)
SELECT p_partkey, p.tag, p.class, linked, CASE WHEN linked IS NOT NULL THEN 'linked' WHEN t.tag IS NOT NULL THEN 'class_mismatch' ELSE 'missing_metadata' END AS status
FROM (SELECT p_partkey, p_brand AS tag, CASE WHEN p_size > 45 THEN 'OTHER' ELSE p_type END AS class FROM part) p LEFT JOIN n ON p.tag = n.tag AND p.class = n.class LEFT JOIN t ON p.tag = t.tag""")
def typed_double_link(spark, d):
    """Project items to model nodes on identity and class at once."""
    p = V.table(spark, d, "part")
    nodes = p.where("p_size <= 25").groupBy(F.col("p_brand").alias("tag"), F.col("p_type").alias("class")).agg(F.min("p_partkey").alias("node"))
    rows = p.select("p_partkey", F.col("p_brand").alias("tag"), F.when(F.col("p_size") > 45, "OTHER").otherwise(F.col("p_type")).alias("class"))
    return B.typed_link(rows, nodes, ["tag", "class"], "p_partkey", "node")


@P.query("""WITH m AS (SELECT lower(n_name) AS k, n_regionkey FROM nation WHERE n_nationkey < 15) SELECT n_nationkey, n_name, m.n_regionkey AS region, CASE WHEN k IS NULL THEN 'not_registered' ELSE 'registered' END AS registration
FROM nation n LEFT JOIN m ON lower(n.n_name) = k""")
def manifest_registration(spark, d):
    """Listed files with their manifest rows, without regard to case."""
    n = V.table(spark, d, "nation")
    m = n.where("n_nationkey < 15").select(F.upper("n_name").alias("n_name"), F.col("n_regionkey").alias("region"))
    return B.registered(n.select("n_nationkey", "n_name"), m, "n_name", ["region"])


@P.query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'new' WHEN o_orderpriority = '1-URGENT' THEN 'stale' ELSE 'reuse' END AS status FROM orders""")
def committed_reuse(spark, d):
    """Earlier outputs whose bindings still hold."""
    o = V.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    done = o.where("o_orderstatus <> 'P'").withColumn("o_totalprice", F.when(~urgent, F.col("o_totalprice")))
    return B.reusable(o, done, ["o_orderkey"], ["o_totalprice"])


@P.query("""WITH g AS (SELECT o_custkey AS c_custkey, count(*) AS n, min(o_orderstatus) AS lo, max(o_orderstatus) AS hi FROM orders GROUP BY o_custkey)
SELECT c_custkey, coalesce(n, 0) AS decisions, CASE WHEN n IS NULL THEN 'undecided' WHEN lo = hi THEN 'decided' ELSE 'conflict' END AS status, CASE WHEN lo = hi THEN lo END AS decision FROM customer LEFT JOIN g USING (c_custkey)""")
def decision_conflicts(spark, d):
    """Decisions on entities, and which of them contradict each other."""
    dec = V.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("decision"))
    return B.decided(V.table(spark, d, "customer"), dec, "c_custkey", "decision")


@P.query("""SELECT doc_id, n_chars, source, 'final' AS origin FROM documents WHERE lang = 'en' UNION ALL
SELECT doc_id, n_chars, source, CASE WHEN toxic IS NOT NULL AND toxic = 0 THEN 'checkpoint_only_partial' ELSE 'finding' END FROM documents LEFT JOIN labels USING (doc_id) WHERE lang <> 'en'""")
def checkpoint_merge(spark, d):
    """Final rows and the checkpoint rows that still can be proven."""
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars", "source", "lang")
    cols = ["doc_id", "n_chars", "source"]
    listing = docs.join(V.table(spark, d, "labels"), "doc_id").select("doc_id", (F.col("n_chars") + F.col("toxic")).alias("n_chars"), "source")
    return B.merged_checkpoint(docs.where("lang = 'en'").select(*cols), docs.select(*cols), listing, ["doc_id"], "doc_id", "n_chars", "source")


@P.query("""WITH a AS (SELECT s_nationkey AS k, count(*) AS declared FROM supplier GROUP BY k), b AS (SELECT n_nationkey AS k, count(*) AS indexed FROM nation GROUP BY k)
SELECT k, coalesce(declared, 0) AS declared, coalesce(indexed, 0) AS indexed, CASE WHEN declared = 1 AND indexed = 1 THEN 'bound' ELSE 'METADATA_UNBOUND' END AS status FROM a FULL JOIN b USING (k)""")
def sidecar_binding(spark, d):
    """Sidecars that exactly one declaration and one index row name."""
    a = V.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    b = V.table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    return B.one_to_one(a, b, ["k"], "METADATA_UNBOUND")


@P.query("""WITH s AS (SELECT p_name AS k, p_brand AS v, 0 AS precedence FROM part WHERE p_size = 50 UNION ALL SELECT p_name, p_type, 1 FROM part WHERE p_size > 40 UNION ALL SELECT p_name, 'none', 2 FROM part)
SELECT k, arg_min(v, (precedence, v)) AS v, min(precedence) AS precedence, count(DISTINCT precedence) AS sources FROM s GROUP BY k""")
def association_precedence(spark, d):
    """The most trusted association of each item."""
    p = V.table(spark, d, "part")
    k = F.col("p_name").alias("k")
    a = p.where("p_size = 50").select(k, F.col("p_brand").alias("v"))
    b = p.where("p_size > 40").select(k, F.col("p_type").alias("v"))
    return B.by_precedence([a, b, p.select(k, F.lit("none").alias("v"))], "k", "v")


@P.query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'unsupported' WHEN event_type = 'click' THEN 'field_mismatch' ELSE 'supported' END AS profile FROM events""")
def profile_gate(spark, d):
    """Payloads against the allowed profiles: type and exact field set."""
    rows = V.table(spark, d, "events").select("event_id", "event_type", F.json_object_keys("props").alias("fields"))
    profiles = spark.createDataFrame(
        [("click", ["k", "x"]), ("view", ["k"]), ("purchase", ["k"]), ("signup", ["k"])], "event_type string, fields array<string>"
    )
    return B.profiled(rows, profiles, ["event_type"], "fields").select("event_id", "profile")


@P.query(r"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE NOT contains(regexp_replace(url, '^[a-z]+://', ''), '//') END AS safe FROM pages""")
def path_safety(spark, d):
    """Relative paths that stay inside their root."""
    u = F.regexp_replace("url", "^[a-z]+://", "")
    m = F.col("page_id") % 4
    path = F.when(m == 0, F.concat(F.lit("a/p"), F.col("page_id").cast("string"))).when(m == 1, F.concat(F.lit("../"), u)).when(m == 2, F.concat(F.lit("/"), u)).otherwise(u)
    return V.table(spark, d, "pages").select("page_id", B.safe_path(path).alias("safe"))


@P.query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic = 1 THEN 'different' ELSE 'covered' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def retention_view(spark, d):
    """Whether a retention view covers exactly the artifacts."""
    docs = V.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    view = docs.join(V.table(spark, d, "labels"), "doc_id").select("doc_id", "lang", (F.col("n_chars") + F.col("toxic")).alias("n_chars"))
    return B.retained(view, docs, "doc_id", ["lang", "n_chars"])


@P.query("""SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0""")
def key_intersection(spark, d):
    """Keys that both sides have."""
    a = V.table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return a.intersect(V.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k")))


@P.query("""SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'""")
def key_difference(spark, d):
    """Keys that only the first side has."""
    li = V.table(spark, d, "lineitem")
    return li.where("l_returnflag = 'A'").select(F.col("l_partkey").alias("k")).subtract(li.where("l_returnflag = 'R'").select("l_partkey"))


@P.query("""SELECT 'head' AS kind, s_suppkey AS id, s_name AS name, NULL::BIGINT AS n FROM supplier UNION ALL SELECT 'track', user_id, NULL, count(*) FROM events GROUP BY user_id""")
def aligned_union(spark, d):
    """Sources of different columns as one inventory."""
    a = V.table(spark, d, "supplier").select(F.lit("head").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = V.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).select(F.lit("track").alias("kind"), F.col("user_id").alias("id"), "n")
    return a.unionByName(b, allowMissingColumns=True)


@P.query(f"""WITH RECURSIVE {_NEEDS}, a AS (SELECT 'C' || c_custkey AS child, c_acctbal > 0 AS ok FROM customer UNION ALL SELECT 'S' || s_suppkey, s_acctbal > 0 FROM supplier),
q AS (SELECT child FROM c JOIN a USING (child) WHERE parent IS NULL AND ok UNION ALL SELECT c.child FROM c JOIN q ON c.parent = q.child JOIN a ON a.child = c.child WHERE ok),
b AS (SELECT s.child FROM s LEFT JOIN q ON q.child = s.parent GROUP BY s.child HAVING count(*) = count(q.child))
SELECT n.child, CAST(level AS INT) AS level, coalesce(ok, false) AND (n.child IN (SELECT child FROM q) OR n.child IN (SELECT child FROM b)) AS qualified FROM n JOIN a USING (child)""")
def dependency_qualification(spark, d):
    """Entities that pass and whose needs qualify."""
    e = V.needs(spark, d)
    one = lambda t, p, k, ok: V.table(spark, d, t).select(F.concat(F.lit(p), k).alias("child"), ok.alias("ok"))
    assessed = one("supplier", "S", "s_suppkey", F.col("s_acctbal") > 0).union(one("customer", "C", "c_custkey", F.col("c_acctbal") > 0))
    return A.qualified(assessed, K.levels(e, "child", "parent"), e, "child", "parent", "ok")


@P.query("""WITH c AS (SELECT p_name AS owner, count(*) FILTER (p_size = 1) AS depth_unit, count(*) FILTER (p_size = 2 AND p_type = 'PROMO') AS time_unit FROM part GROUP BY p_name)
SELECT owner, 'depth_unit' AS field, depth_unit AS n, CASE depth_unit WHEN 0 THEN 'absent' WHEN 1 THEN 'recorded' ELSE 'duplicate' END AS status FROM c
UNION ALL SELECT owner, 'time_unit', time_unit, CASE time_unit WHEN 0 THEN 'absent' WHEN 1 THEN 'recorded' ELSE 'duplicate' END FROM c""")
def unit_declarations(spark, d):
    """Unit declarations of each owner: absent, recorded or duplicate."""
    p = V.table(spark, d, "part").withColumnRenamed("p_name", "owner")
    fields = [("depth_unit", F.col("p_size") == 1), ("time_unit", (F.col("p_size") == 2) & (F.col("p_type") == "PROMO"))]
    return A.declarations(p, "owner", fields)


@P.query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS p FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY p, event_type) AS seen FROM f GROUP BY user_id""")
def first_seen_order(spark, d):
    """Distinct values in the order of their first appearance."""
    return A.first_seen(V.table(spark, d, "events"), ["user_id"], "event_id", "event_type")


@P.query("""WITH a AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY k), b AS (SELECT l_orderkey AS k, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY k)
SELECT k, coalesce(a.n, 0) AS declared, CAST(coalesce(b.n, 0) AS BIGINT) AS counted, coalesce(a.n, 0) = coalesce(b.n, 0) AS reconciled FROM a FULL JOIN b USING (k)""")
def count_reconciliation(spark, d):
    """Counts of parts against declared totals."""
    totals = V.table(spark, d, "orders").groupBy(F.col("o_orderkey").alias("k")).agg(F.count("*").alias("n"))
    parts = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_distinct("l_linenumber").alias("n"))
    return A.reconciled(parts, totals, "k", "n")


@P.query("""WITH v AS (SELECT l_suppkey AS line, l_orderkey AS k1, l_partkey AS k2, l_linenumber AS k3, l_quantity AS x, l_extendedprice AS y FROM lineitem),
r AS (SELECT *, sum(CAST(NOT (x BETWEEN 5 AND 45 AND y < 60000) AS INT)) OVER (PARTITION BY line ORDER BY k1, k2, k3, x, y ROWS UNBOUNDED PRECEDING) AS run FROM v)
SELECT line, CAST(run AS BIGINT) AS run, count(*) AS n FROM r WHERE x BETWEEN 5 AND 45 AND y < 60000 GROUP BY line, run HAVING count(*) >= 2""")
def clipped_polylines(spark, d):
    """Polylines clipped to a box, split where they leave it."""
    v = V.vertices(spark, d).withColumnRenamed("part", "k3")
    return A.clipped(v, ["line"], ["k1", "k2", "k3", "x", "y"], F.col("x").between(5, 45) & (F.col("y") < 60000))


@P.query("""WITH g AS (SELECT p_brand, p_size, count(DISTINCT p_type) AS n, min(p_type) AS one FROM part GROUP BY ALL)
SELECT p_brand, p_size, CASE WHEN p_size < 2 OR p_size > 49 THEN 'out_of_bounds' WHEN n = 1 THEN 'recorded' WHEN n = 0 THEN 'unlabelled' ELSE 'conflict' END AS status,
  CASE WHEN p_size BETWEEN 2 AND 49 AND n = 1 THEN one END AS label FROM g""")
def category_legend(spark, d):
    """Labels of category codes within bounds."""
    return A.legend(V.table(spark, d, "part"), "p_brand", "p_size", "p_type", 2, 49)


@P.query("""SELECT doc_id, CASE WHEN l.quality = 0 THEN 'rejected' WHEN l.toxic = 1 THEN 'quarantined' WHEN n_chars < 200 THEN 'incomplete' WHEN l.doc_id IS NULL THEN 'unassessed' ELSE 'ready' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def mapping_state(spark, d):
    """One state for each entity: the first that applies."""
    rows = V.table(spark, d, "documents").select("doc_id", "n_chars").join(V.table(spark, d, "labels"), "doc_id", "left")
    states = [("rejected", F.col("quality") == 0), ("quarantined", F.col("toxic") == 1), ("incomplete", F.col("n_chars") < 200), ("unassessed", F.col("quality").isNull())]
    return rows.select("doc_id", A.state(states, "ready").alias("state"))


@P.query("""SELECT substr(sha256('{"format":"' || lang || '","kind":"' || source || '"}'), 1, 16) AS representation, count(*) AS n FROM documents GROUP BY ALL""")
def representation_keys(spark, d):
    """Keys of representations as hashes of canonical JSON."""
    m = V.manifest(spark, d).select("kind", "format")
    return m.groupBy(A.keyed_name("kind", "format").alias("representation")).agg(F.count("*").alias("n"))


@P.query("""SELECT user_id AS well, event_type AS curve, count(*) AS n, count(*) FILTER (event_id % 97 = 0) AS undefined, round(count(*) FILTER (event_id % 97 = 0) / count(*), 6) AS share FROM events GROUP BY ALL""")
def curve_undefined_counts(spark, d):
    """Undefined samples of each curve."""
    return V.log_samples(spark, d).groupBy("well", "curve").agg(
        F.count("*").alias("n"), F.count_if("is_null").alias("undefined"), F.round(F.count_if("is_null") / F.count("*"), 6).alias("share")
    )


@P.query("""WITH q AS (SELECT source, count(*) AS files, count(*) FILTER (n_chars < 200) AS small, count(DISTINCT sha256(text)) AS contents, count(l.doc_id) AS labelled, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source)
SELECT source, files, small, files - contents AS repeats, labelled, toxic, array_to_string(list_filter([CASE WHEN small > 0 THEN 'SMALL_FILES' END, CASE WHEN files > contents THEN 'REPEATS' END, CASE WHEN toxic > 0 THEN 'TOXIC' END], lambda x: x IS NOT NULL), ',') AS flags FROM q""")
def package_qc_summary(spark, d):
    """Counts of each package and the flags they raise."""
    rows = V.table(spark, d, "documents").select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("h"))
    j = rows.join(V.table(spark, d, "labels").withColumn("there", F.lit(1)), "doc_id", "left")
    out = j.groupBy("source").agg(
        F.count("*").alias("files"), F.count_if(F.col("n_chars") < 200).alias("small"), (F.count("*") - F.count_distinct("h")).alias("repeats"),
        F.count("there").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"),
    )
    flags = F.array(F.when(F.col("small") > 0, "SMALL_FILES"), F.when(F.col("repeats") > 0, "REPEATS"), F.when(F.col("toxic") > 0, "TOXIC"))
    return out.withColumn("flags", F.array_join(F.array_compact(flags), ","))


@P.query("""WITH t AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag, l_linestatus, l_quantity, l_discount, l_tax, l_shipdate FROM lineitem)
SELECT l_suppkey AS well, count(*) AS picks, count(DISTINCT l_returnflag) AS surfaces, min(l_quantity) AS least, max(l_quantity) AS most FROM t GROUP BY l_suppkey""")
def tops_dedup_summary(spark, d):
    """Picks without repeats, by well."""
    key = ["l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    t = V.table(spark, d, "lineitem").select(*key).dropDuplicates()
    return t.groupBy(F.col("l_suppkey").alias("well")).agg(
        F.count("*").alias("picks"), F.count_distinct("l_returnflag").alias("surfaces"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most")
    )


@P.query("""SELECT source AS class, count(*) FILTER (l.doc_id IS NOT NULL) AS available, CAST(coalesce(sum(n_chars) FILTER (l.doc_id IS NOT NULL), 0) AS BIGINT) AS bytes, count(*) FILTER (l.doc_id IS NULL) AS missing FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def workload_summary(spark, d):
    """Available and missing work by class."""
    j = V.table(spark, d, "documents").select("doc_id", "source", "n_chars").join(V.table(spark, d, "labels").select("doc_id", F.lit(1).alias("there")), "doc_id", "left")
    return j.groupBy(F.col("source").alias("class")).agg(
        F.count("there").alias("available"), F.coalesce(F.sum(F.when(F.col("there") == 1, F.col("n_chars"))), F.lit(0)).alias("bytes"),
        F.count_if(F.col("there").isNull()).alias("missing"),
    )


@P.query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'well_log' WHEN p_type IN ('STANDARD', 'PROMO') THEN 'surface' WHEN starts_with(p_name, 'red') THEN 'polygon' ELSE 'other' END AS category,
  CASE WHEN p_size <= 10 THEN 'preview' WHEN contains(p_name, 'ring') THEN 'source' ELSE 'export' END AS role FROM part""")
def category_and_role(spark, d):
    """Category and role of each export by rule order."""
    t, n = F.col("p_type"), F.col("p_name")
    category = A.state([("well_log", t == "ECONOMY"), ("surface", t.isin("STANDARD", "PROMO")), ("polygon", n.startswith("red"))], "other")
    role = A.state([("preview", F.col("p_size") <= 10), ("source", n.contains("ring"))], "export")
    return V.table(spark, d, "part").select("p_partkey", category.alias("category"), role.alias("role"))


@P.query("""WITH f AS (SELECT user_id, event_id, value, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events)
SELECT event_type, coalesce(nxt, '(end)') AS next_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) / count(value) AS mean FROM f GROUP BY ALL""")
def stage_outcomes(spark, d):
    """Which stage follows which, and how often."""
    r = ranged(V.table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])
    e = r.following({"next": F.col("event_type")}).withColumn("next_type", F.coalesce("next", F.lit("(end)")))
    return e.groupBy("event_type", "next_type").agg(F.count("*").alias("n"), X.exact_mean(F.col("value")).alias("mean"))


@P.query("""WITH q AS (SELECT doc_id, sha256(coalesce(text, '')) AS held, CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE source END AS reason FROM documents WHERE doc_id % 3 = 0),
f AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'other' ELSE sha256(coalesce(text, '')) END AS found FROM documents WHERE doc_id % 11 <> 0)
SELECT q.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'accepted_and_quarantined' WHEN reason = ' ' THEN 'without_reason' WHEN f.doc_id IS NULL THEN 'missing' WHEN found <> held THEN 'changed' ELSE 'held' END AS finding
FROM q LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id % 2 = 0) l USING (doc_id) LEFT JOIN f USING (doc_id)""")
def quarantine(spark, d):
    """What is quarantined, against what is accepted and what is there."""
    t = V.table(spark, d, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    k = F.col("doc_id")
    held = t.where(k % 3 == 0).select("doc_id", "h", F.when(k % 7 == 0, " ").otherwise(F.col("source")).alias("reason"))
    there = t.where(k % 11 != 0).select("doc_id", F.when(k % 5 == 0, "other").otherwise(F.col("h")).alias("h"))
    return A.quarantine_checked(V.table(spark, d, "labels").where("quality = 1 and toxic = 0 and doc_id % 2 = 0"), held, there, "doc_id", "h", "reason")


@P.query("""WITH r AS (SELECT event_id AS k, CASE WHEN event_id % 997 = 5 THEN 3 ELSE event_id // 100 END AS shard FROM events), f AS (SELECT shard, count(*) AS found, min(k) AS lo, max(k) AS hi FROM r GROUP BY shard),
d AS (SELECT shard, count(*) + CAST(shard % 13 = 1 AS INT) AS declared FROM r WHERE shard % 17 <> 2 GROUP BY shard UNION ALL SELECT 1000000, 5),
b AS (SELECT shard, declared, found, lo, max(hi) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d FULL JOIN f USING (shard))
SELECT shard, CAST(declared AS BIGINT) AS declared, found, CASE WHEN declared IS NULL THEN 'undeclared' WHEN found IS NULL THEN 'missing' WHEN found <> declared THEN 'row_count' WHEN lo <= before THEN 'overlap' ELSE 'ok' END AS status FROM b""")
def shard_integrity(spark, d):
    """Shards of a table: rows as declared, keys in order."""
    k = F.col("event_id")
    rows = V.table(spark, d, "events").select(k.alias("k"), F.when(k % 997 == 5, F.lit(3).cast("long")).otherwise(F.floor(k / 100)).alias("shard"))
    declared = rows.where("shard % 17 <> 2").groupBy("shard").agg((F.count("*") + (F.col("shard") % 13 == 1).cast("int")).alias("rows"))
    return A.shards_checked(rows, "shard", "k", declared.union(spark.range(1).select(F.lit(1_000_000).cast("long"), F.lit(5).cast("long"))))
