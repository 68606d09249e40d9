"""Evidence, rules, dependencies, coverage and event analytics."""

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import campaign as C
from ..operators import catalogue as K
from ..operators import text as T
from ..sources import readers as R
from ..sources import views as V
from .base import Plans

P = Plans()
# every tenth size is one of these: the first nine say nothing, nor do the next five; the last ones do
_STATED = (*X.UNKNOWN_TOKENS, *(f"{p} reason" for p in X.UNKNOWN_PREFIXES), " Unknown ", "unknown zone", "none", "n/a", "-", "not stated")
_SPELT = ", ".join(f"'{x}'" for x in _STATED)
_VAGUE = f"""(lower(trim(value)) IN ({", ".join(f"'{x}'" for x in X.UNKNOWN_TOKENS)}) OR {" OR ".join(f"starts_with(lower(trim(value)), '{x}')" for x in X.UNKNOWN_PREFIXES)})"""
_EVIDENCE = f"""e AS (SELECT p_name AS entity, 'brand' AS field, p_brand AS value FROM part UNION ALL SELECT p_name, 'type', p_type FROM part
  UNION ALL SELECT p_name || ' ' || (p_size % 3), 'size', CASE WHEN p_size % 10 = 0 THEN ([{_SPELT}])[1 + p_partkey % {len(_STATED)}] ELSE CAST(p_size AS VARCHAR) END FROM part
  UNION ALL SELECT p_name || ' ' || p_partkey, 'note', CASE WHEN p_partkey % 7 <> 0 THEN ([{_SPELT}])[1 + p_partkey % {len(_STATED)}] END FROM part)"""


@P.query("""SELECT p_partkey, field, value FROM (SELECT p_partkey, 'p_name' AS field, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part
  UNION ALL SELECT p_partkey, 'p_type', p_type FROM part) WHERE value IS NOT NULL""")
def evidence_unpivot(spark, d):
    """One row for each recorded field."""
    return K.long_evidence(V.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "p_partkey", ["p_name", "p_brand", "p_type"])


@P.query(f"""WITH {_EVIDENCE}, k AS (SELECT entity, field, CASE WHEN NOT {_VAGUE} THEN value END AS said FROM e),
g AS (SELECT entity, field, count(*) AS observations, count(DISTINCT said) AS alternatives, min(said) AS one FROM k GROUP BY entity, field)
SELECT entity, field, observations, CASE alternatives WHEN 0 THEN 'unresolved' WHEN 1 THEN 'recorded' ELSE 'conflict' END AS status, CASE WHEN alternatives = 1 THEN one END AS value, CAST(alternatives AS INT) AS alternatives FROM g""")
def evidence_resolution(spark, d):
    """What all observations of a field agree on, if they do."""
    p = V.table(spark, d, "part")
    stated = F.element_at(F.array(*map(F.lit, _STATED)), (1 + F.col("p_partkey") % len(_STATED)).cast("int"))
    name = F.col("p_name")
    parts = [
        p.select(name.alias("entity"), F.lit("brand").alias("field"), F.col("p_brand").alias("value")),
        p.select(name, F.lit("type"), "p_type"),
        p.select(F.concat_ws(" ", name, (F.col("p_size") % 3).cast("string")), F.lit("size"), F.when(F.col("p_size") % 10 == 0, stated).otherwise(F.col("p_size").cast("string"))),
        p.select(F.concat_ws(" ", name, F.col("p_partkey").cast("string")), F.lit("note"), F.when(F.col("p_partkey") % 7 != 0, stated)),
    ]
    e = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return K.resolved(e, ["entity", "field"], "value")


@P.query("""WITH r AS (SELECT doc_id, 'QUALITY_FAILED' AS code FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'TOXIC' FROM labels WHERE toxic = 1
  UNION ALL SELECT doc_id, 'TOO_SHORT' FROM documents WHERE n_chars < 200 UNION ALL SELECT doc_id, 'UNLABELLED' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT doc_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, count(DISTINCT code) AS n_codes FROM r GROUP BY doc_id""")
def blocking_rules(spark, d):
    """The codes that block each entity."""
    labels, docs = V.table(spark, d, "labels"), V.table(spark, d, "documents").select("doc_id", "n_chars")
    return K.blockers(
        [
            ("QUALITY_FAILED", labels.where("quality = 0")),
            ("TOXIC", labels.where("toxic = 1")),
            ("TOO_SHORT", docs.where("n_chars < 200")),
            ("UNLABELLED", docs.join(labels, "doc_id", "left_anti")),
        ],
        "doc_id",
    )


@P.query("""SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.n_chars <> d.n_chars + l.toxic THEN 'size_mismatch' ELSE 'available' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def artifact_availability(spark, d):
    """Declared artifacts against what is listed."""
    docs = V.table(spark, d, "documents").select("doc_id", "n_chars")
    listing = docs.join(V.table(spark, d, "labels"), "doc_id").select("doc_id", (F.col("n_chars") + F.col("toxic")).alias("n_chars"))
    return K.availability(docs, listing, "doc_id", "n_chars")


_CHAINS = """c AS (SELECT 'C' || c_custkey AS child, CASE WHEN c_custkey % 97 = 5 THEN 'gone' WHEN c_custkey % 61 = 7 THEN 'C' || (c_custkey + 2) WHEN c_custkey % 12 <> 0 THEN 'C' || (c_custkey - 1) END AS parent FROM customer)"""
_NEEDS = _CHAINS + """, s AS (SELECT 'S' || s_suppkey AS child, 'C' || (s_suppkey + o) AS parent FROM supplier, (VALUES (0), (5)) AS v(o)),
l AS (SELECT child, 0 AS level FROM c WHERE parent IS NULL UNION ALL SELECT c.child, level + 1 FROM c JOIN l ON c.parent = l.child),
n AS (SELECT c.child, level FROM c LEFT JOIN l ON l.child = c.child UNION ALL SELECT s.child, CASE WHEN count(*) = count(level) THEN max(level) + 1 END FROM s LEFT JOIN l ON s.parent = l.child GROUP BY s.child)"""


@P.query(f"WITH RECURSIVE {_NEEDS} SELECT child, CAST(level AS INT) AS level FROM n")
def topological_levels(spark, d):
    """Dependency levels of all entities; none behind cycles and needs that are not there."""
    return K.levels(V.needs(spark, d), "child", "parent")


@P.query(f"""WITH RECURSIVE {_CHAINS}, w AS (SELECT child AS node, child AS place, [child] AS path, 0 AS depth FROM c
  UNION ALL SELECT node, parent, list_prepend(parent, path), depth + 1 FROM w JOIN c ON w.place = c.child WHERE parent IS NOT NULL AND NOT list_contains(path, parent)),
f AS (SELECT node, arg_max(place, depth) AS place, arg_max(path, depth) AS path, max(depth) AS depth FROM w GROUP BY node)
SELECT node, array_to_string(path, '/') AS path, CAST(depth AS INT) AS depth, CASE WHEN c.child IS NULL THEN 'dangling' WHEN c.parent IS NULL THEN 'rooted' ELSE 'cycle' END AS status FROM f LEFT JOIN c ON c.child = f.place""")
def ancestry_paths(spark, d):
    """The path from the root to each entity, or to where it breaks off or closes."""
    return K.ancestry(V.needs(spark, d).where("child like 'C%'"), "child", "parent")


_COVER = """SELECT o_orderstatus, o_orderpriority, {grouping} count(*) AS objects, CAST(sum(CAST(o_totalprice AS DECIMAL(18,6))) AS DOUBLE) AS bytes FROM orders GROUP BY {how}"""


def _coverage(spark, d, how):
    rows = V.table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice")
    measures = [F.count("*").alias("objects"), X.exact_sum(F.col("o_totalprice")).alias("bytes")]
    return K.coverage(rows, ["o_orderstatus", "o_orderpriority"], measures, how)


@P.query(_COVER.format(grouping="", how="o_orderstatus, o_orderpriority"))
def coverage_matrix(spark, d):
    """Objects and bytes by status and type."""
    return _coverage(spark, d, "groupBy")


@P.query(_COVER.format(grouping="CAST(grouping(o_orderstatus, o_orderpriority) AS INT) AS grouping,", how="ROLLUP (o_orderstatus, o_orderpriority)"))
def coverage_rollup(spark, d):
    """Coverage with margins from the right."""
    return _coverage(spark, d, "rollup")


@P.query(_COVER.format(grouping="CAST(grouping(o_orderstatus, o_orderpriority) AS INT) AS grouping,", how="CUBE (o_orderstatus, o_orderpriority)"))
def coverage_cube(spark, d):
    """Coverage with all margins."""
    return _coverage(spark, d, "cube")


@P.query("""SELECT source, count(*) AS files, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source""")
def recovery_totals(spark, d):
    """Totals by type with a column for each category and the denominator."""
    each = [F.count_if(F.col("lang") == x).alias(x) for x in ("en", "de", "fr", "es")]
    return V.table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("files"), *each)


@P.query("""WITH i AS (SELECT event_type || ':' || (user_id % 20) AS sig, user_id AS c, value > 50 AS ok FROM events), p AS (SELECT sig, c, count(*) AS n, count(*) FILTER (ok) AS r FROM i GROUP BY sig, c),
k AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY c) AS rank FROM p)
SELECT sig, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS cases, CAST(sum(r) AS BIGINT) AS recovered, CAST(sum(n) - sum(r) AS BIGINT) AS open, string_agg(c, ',' ORDER BY c) FILTER (rank <= 3) AS examples FROM k GROUP BY sig""")
def issue_groups(spark, d):
    """Issues of one signature: occurrences, cases, recoveries and the first three cases."""
    e = V.table(spark, d, "events")
    rows = e.select(F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("sig"), F.col("user_id").alias("c"), "value")
    return C.issue_groups(rows, "sig", "c", F.col("value") > 50)


@P.query("""SELECT event_id, user_id, date_diff('second', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id)) AS "interval" FROM
  (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)""")
def stage_intervals(spark, d):
    """Seconds to the next event of the scope."""
    clock = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    e = V.table(spark, d, "events").select("event_id", "user_id", clock.alias("clock"))
    return C.intervals(e, ["user_id"], ["event_id"], "clock").select("event_id", "user_id", "interval")


@P.query("""WITH m AS (SELECT user_id, event_id, event_type = 'error' AS failed FROM events), r AS (SELECT *, coalesce(sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, count(*) FILTER (failed) AS failures, CASE WHEN bool_and(failed) THEN 'open' ELSE 'recovered' END AS status FROM r GROUP BY user_id, run HAVING count(*) FILTER (failed) > 0""")
def retry_pairs(spark, d):
    """Runs of failures and whether a success followed."""
    e = V.table(spark, d, "events").select("user_id", "event_id", "event_type")
    return C.retry_pairs(e, ["user_id"], ["event_id"], F.col("event_type") == "error").withColumn("run", F.col("run").cast("long"))


@P.query("""WITH m AS (SELECT user_id % 10 AS scope, user_id, event_type, event_id % 50 AS sample, event_id AS counter, value FROM events),
g AS (SELECT scope, sum(m) AS total FROM (SELECT scope, user_id, event_type, max(counter) AS m FROM m GROUP BY ALL) GROUP BY scope), p AS (SELECT scope, max(s) AS peak FROM (SELECT scope, sample, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS s FROM m GROUP BY ALL) GROUP BY scope)
SELECT scope, CAST(total AS BIGINT) AS total, peak FROM g JOIN p USING (scope)""")
def counter_peaks(spark, d):
    """Process counters summed over processes and peaks of summed gauges."""
    e = V.table(spark, d, "events")
    rows = e.select((F.col("user_id") % 10).alias("scope"), "user_id", "event_type", (F.col("event_id") % 50).alias("sample"), F.col("event_id").alias("counter"), "value")
    out = C.counter_peaks(rows, "scope", ["user_id", "event_type"], "sample", "counter", "value")
    return out.withColumn("total", F.col("total").cast("long"))


@P.query("""WITH c AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS rank FROM c),
o AS (SELECT p_type, sum(n) AS omitted FROM r WHERE rank > 5 GROUP BY p_type) SELECT p_type, p_brand, n, rank, CAST(coalesce(omitted, 0) AS BIGINT) AS omitted FROM r LEFT JOIN o USING (p_type) WHERE rank <= 5""")
def category_code_bars(spark, d):
    """The five most frequent codes of each category and how many rows the rest has."""
    out = C.top_with_rest(V.table(spark, d, "part").select("p_type", "p_brand"), ["p_type"], "p_brand", 5)
    return out.withColumn("rank", F.col("rank").cast("long"))


@P.query("""WITH u AS (SELECT user_id, event_id, value, coalesce(CAST(sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0) AS used FROM events)
SELECT user_id, event_id, used, greatest(0, round(500.0 - used, 4)) AS remaining, greatest(0, round(500.0 - used, 4)) > 0 AS runs FROM u""")
def lane_budget(spark, d):
    """What each lane has left before each attempt."""
    e = V.table(spark, d, "events").select("user_id", "event_id", "value")
    return C.running_budget(e, ["user_id"], ["event_id"], "value", 500.0).drop("value")


@P.query("""SELECT event_id, user_id, ts, event_type FROM events ORDER BY ts, event_id""")
def merge_ordered_events(spark, d):
    """Event files of all types as one sequence; the writer keeps the order by range."""
    e = V.table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    known = ("click", "view", "purchase", "signup", "error")
    parts = [e.where(F.col("event_type") == t) for t in known]
    parts.append(e.where(F.col("event_type").isNull() | ~F.col("event_type").isin(*known)))
    return C.merged_order(parts, "ts", "event_id")


@P.query("""SELECT source, lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(max(length(source || '/' || lang || '/' || doc_id)) AS INT) AS longest FROM documents GROUP BY source, lang""")
def extension_stats(spark, d):
    """Files, bytes and the longest path of each kind."""
    m = V.manifest(spark, d)
    path = F.concat_ws("/", "kind", "format", F.col("path").cast("string"))
    return m.groupBy(F.col("kind").alias("source"), F.col("format").alias("lang")).agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max(F.char_length(path)).alias("longest")
    )


@P.query("""SELECT doc_id, CASE WHEN n_chars < 1000 THEN 'small' WHEN n_chars < 100000 THEN 'medium' ELSE 'large' END AS size,
  array_to_string(list_sort(list_filter(['lang:' || lang, CASE WHEN contains(text, chr(10)) THEN 'multiline' END, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END], lambda x: x IS NOT NULL)), ',') AS features FROM documents""")
def size_features(spark, d):
    """Size bins and features of each file."""
    t = F.col("text")
    found = F.array(F.concat(F.lit("lang:"), "lang"), F.when(t.contains("\n"), "multiline"), F.when(t.rlike("[0-9]"), "digits"))
    docs = V.table(spark, d, "documents")
    return docs.select("doc_id", X.size_bin(F.col("n_chars")).alias("size"), F.array_join(F.array_sort(F.array_compact(found)), ",").alias("features"))


_SAID = r"""url || ' at C:\Data\Field One, then "D:/x y/z.las"; \\srv\share\w.zgy 0x1F 00000000-1111-2222-3333-44444444abcd  token = k' || page_id || ' ' || html"""


def _said(spark, d):
    """Urls and pages with an error report between them."""
    report = r' at C:\Data\Field One, then "D:/x y/z.las"; \\srv\share\w.zgy 0x1F 00000000-1111-2222-3333-44444444abcd  token = k'
    said = F.concat("url", F.lit(report), F.col("page_id").cast("string"), F.lit(" "), "html")
    return V.table(spark, d, "pages").select("page_id", "url", said.alias("said"))


def _replaced(text, *patterns):
    for pattern, by in patterns:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return text


_REASON = _replaced(
    _SAID, (X.OBJECT, "<object>"), (X.QUOTED_PATH, "<path>"), (X.BARE_PATH, "<path>"), (X.HEX_NUMBER, "<hex>"), (X.DECIMAL_NUMBER, "<n>"), (r"\s+", " ")
)


@P.query(f"SELECT page_id, trim({_REASON}, ' ')[1:2000] AS reason FROM pages")
def normalize_reasons(spark, d):
    """Texts with identifiers, paths and numbers replaced by their kind."""
    return _said(spark, d).select("page_id", X.normalised_reason(F.col("said")).alias("reason"))


def _with_tokens(text, *kinds):
    for kind, pattern in kinds:
        pattern = "'" + pattern.replace("'", "''") + "'"
        zipped = f"list_zip(string_split_regex(t, {pattern}), regexp_extract_all(t, {pattern}))"
        token = f"coalesce('<{kind}:' || substr(sha256('salt' || x[2]), 1, 8) || '>', '')"
        text = f"(SELECT array_to_string(list_transform({zipped}, lambda x: x[1] || {token}), '') FROM (SELECT {text} AS t))"
    return text


_TOKENS = _with_tokens(_SAID, ("object", X.WHOLE_OBJECT), ("path", X.PRIVATE_PATH), ("email", X.EMAIL), ("url", X.URL))


@P.query(rf"""SELECT page_id, substr(sha256('salt' || url), 1, 12) AS pseudonym, sha256({_replaced(_TOKENS, (X.SECRET, r"\1\2[redacted]"))}) AS scrubbed FROM pages""")
def scrub_identifiers(spark, d):
    """Pages with pseudonyms for identifiers, paths, addresses and urls, and without secrets."""
    return _said(spark, d).select("page_id", X.pseudonym(F.col("url"), "salt").alias("pseudonym"), F.sha2(X.scrubbed(F.col("said"), "salt"), 256).alias("scrubbed"))


@P.query(r"""WITH m AS (SELECT page_id, html, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS found FROM pages)
SELECT page_id, found, count(*) AS occurrences, CAST(min(instr(html, found)) AS INT) AS first FROM m GROUP BY page_id, found""")
def registry_regex_scan(spark, d):
    """References found by pattern: occurrences and first offset."""
    return T.pattern_scan(V.table(spark, d, "pages").select("page_id", "html"), "page_id", "html", 'href="(/[^"]*)"', 1)


@P.query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), f AS (SELECT doc_id, x, list_filter(x, lambda y: length(trim(y, ' ')) > 0)[1:50] AS f FROM l),
v AS (SELECT doc_id, CAST(len(x) AS INT) AS lines, CAST(len(list_filter(x, lambda y: length(trim(y, ' ')) = 0)) AS INT) AS blank, len(list_filter(f, lambda y: contains(y, ','))) AS a, len(list_filter(f, lambda y: contains(y, ';'))) AS b,
  len(list_filter(f, lambda y: contains(y, chr(9)))) AS c, len(list_filter(f, lambda y: contains(y, ' '))) AS e FROM f)
SELECT doc_id, lines, blank, CASE WHEN greatest(a, b, c, e) = 0 THEN 'none' WHEN a = greatest(a, b, c, e) THEN 'comma' WHEN b = greatest(a, b, c, e) THEN 'semicolon' WHEN c = greatest(a, b, c, e) THEN 'tab' ELSE 'space' END AS delimiter FROM v""")
def text_profile(spark, d):
    """Lines, blank lines and the likely delimiter of each text."""
    return T.profile(V.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@P.query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(len(json_keys(props)) - 1 AS INT) AS skipped FROM events""")
def json_projection(spark, d):
    """The fields of receipts that are asked for, and how many others there are."""
    props = F.from_json("props", "k long")
    keys = F.json_object_keys("props")
    skipped = F.size(F.array_except(keys, F.array(F.lit("k"))))
    return V.table(spark, d, "events").select("event_id", props["k"].alias("k"), skipped.alias("skipped"))


@P.query(r"""WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS x FROM conversations), p AS (SELECT conv_id, turn, x, unnest(range(0, len(x) // 2)) AS k FROM l)
SELECT conv_id * 1000 + turn AS file, trim(x[2 * k + 1], ' ') AS key, trim(x[2 * k + 2], ' ') AS value FROM p""")
def property_files(spark, d):
    """Alternating key and value lines as rows."""
    c = V.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("file"), "text")
    return T.property_pairs(c, "file", "text")


@P.query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def tumbling_counts(spark, d):
    """Events by hour and type (an addition: event-time windows)."""
    e = V.table(spark, d, "events").select("ts", "event_type", "value")
    return e.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count("*").alias("n"), X.exact_sum(F.col("value")).alias("total"))


@P.query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM s GROUP BY user_id, k""")
def session_windows(spark, d):
    """Events of a user with less than two hours between them (an addition)."""
    e = V.table(spark, d, "events").select("user_id", "ts", "value")
    w = F.session_window("ts", "2 hours")
    return e.groupBy("user_id", w.alias("w")).agg(F.min("ts").alias("start"), F.count("*").alias("n"), X.exact_sum(F.col("value")).alias("total")).drop("w")


_ENTRY = r'(id|href|class|src)="([A-Za-z0-9/_.-]+)"'


@P.query(rf"""WITH m AS (SELECT page_id, regexp_extract_all(html, '{_ENTRY}') AS ms, string_split_regex(html, '{_ENTRY}') AS bs FROM pages),
u AS (SELECT page_id, unnest(range(1, len(ms) + 1)) AS k, ms, bs FROM m),
r AS (SELECT page_id, k, ms[k] AS match, right(bs[k], 20) AS before, left(bs[k + 1], 20) AS after, sum(length(bs[k]) + length(ms[k])) OVER (PARTITION BY page_id ORDER BY k) - length(ms[k]) AS first FROM u),
g AS (SELECT page_id, regexp_extract(match, '{_ENTRY}', 1) AS kind, regexp_extract(match, '{_ENTRY}', 2) AS name, count(*) AS occurrences, CAST(min(first) AS BIGINT) AS first, arg_min(before || match || after, first) AS context FROM r GROUP BY ALL)
SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY first, kind, name) <= 25""")
def registry_entries(spark, d):
    """Entries of each page by kind and name: how often, where first, and in what surroundings; 25 of a page at most."""
    found = T.located_matches(V.table(spark, d, "pages").select("page_id", "html"), "page_id", "html", _ENTRY, 20)
    return T.registry_entries(found, "page_id", _ENTRY, {"kind": 1, "name": 2}, 25)


@P.query(r"""WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'plain text' WHEN 1 THEN '  ' WHEN 2 THEN 'x ' || html ELSE html || ' name="' || url || '" Name = "b" 0A1B2C3D-1111-2222-3333-44444444abcd' END AS t FROM pages),
s AS (SELECT page_id, t, list_sort(list_distinct(regexp_extract_all(t, '(?i)\bname\s*=\s*"([^"]*)"', 1))) AS names, list_sort(list_distinct(regexp_extract_all(lower(t), '([0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12})', 1))) AS ids,
  nullif(regexp_extract(t, '<([A-Za-z_][\w.:-]*)', 1), '') AS root FROM p)
SELECT page_id, CASE WHEN trim(t) = '' THEN 'empty' WHEN regexp_matches(t, '^\s*<') THEN 'markup' WHEN root IS NOT NULL THEN 'embedded' ELSE 'text' END AS status, root,
  array_to_string(names[1:20], '|') AS names, CAST(len(names) AS INT) AS n_names, array_to_string(ids[1:20], '|') AS ids,
  array_to_string(list_filter([CASE WHEN contains(t, 'href=') THEN 'links' END, CASE WHEN regexp_matches(t, '<script') THEN 'scripts' END], lambda x: x IS NOT NULL), ',') AS flags FROM s""")
def xml_metadata(spark, d):
    """What pages that may be markup say without being parsed."""
    m, html = F.col("page_id") % 5, F.col("html")
    more = F.concat(html, F.lit(' name="'), "url", F.lit('" Name = "b" 0A1B2C3D-1111-2222-3333-44444444abcd'))
    t = F.when(m == 0, "plain text").when(m == 1, "  ").when(m == 2, F.concat(F.lit("x "), html)).otherwise(more)
    return R.xml_scan(V.table(spark, d, "pages").select("page_id", t.alias("t")), "page_id", "t", {"links": "href=", "scripts": "<script"})
