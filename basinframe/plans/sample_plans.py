"""Well logs, trajectories, lattices and arrays."""

from pyspark.sql import functions as F

from ..operators import lattice as L
from ..operators import samples as S
from ..sources import views as V
from .base import Plans

P = Plans()
_LOG = """log AS (SELECT user_id AS well, event_type AS curve, event_id AS seq, CAST(date_diff('second', TIMESTAMP '1970-01-01', ts) AS DOUBLE) AS md,
  value AS raw, event_id % 97 = 0 AS is_null FROM events)"""
_GRID = """grid AS (SELECT p_partkey AS node, CAST(p_partkey % 50 AS INT) AS i, CAST(p_partkey // 50 AS INT) AS j, p_retailprice AS raw,
  p_size % 7 <> 0 AS defined FROM part)"""
_GRID_B = """grid_b AS (SELECT p_partkey AS node, CAST(p_partkey % 50 AS INT) AS i, CAST(p_partkey // 50 AS INT) AS j, p_size * 10.0::DOUBLE AS raw,
  p_size % 5 <> 0 AS defined FROM part)"""
_VERTICES = """v AS (SELECT l_suppkey AS line, l_linenumber AS part, l_orderkey AS k1, l_partkey AS k2, l_quantity AS x, l_extendedprice AS y,
  l_discount >= 0.09 AS missing FROM lineitem)"""
_V_ORDER = ["k1", "k2", "x", "y"]


@P.query(f"""WITH {_LOG}, m AS (SELECT *, CASE WHEN NOT is_null THEN raw END AS v FROM log)
SELECT well, curve, count(*) AS samples, count(v) AS valid, min(v) AS least, max(v) AS most, CAST(sum(CAST(v AS DECIMAL(18,6))) AS DOUBLE) / count(v) AS mean, round(stddev_pop(v), 6) AS deviation
FROM m GROUP BY well, curve""")
def log_curve_stats(spark, d):
    """Statistics of each curve over samples that are not null."""
    return S.statistics(V.log_samples(spark, d), ["well", "curve"], S.masked("raw", "is_null"))


@P.query(f"""WITH {_LOG}, s AS (SELECT *, md - lag(md) OVER (PARTITION BY well, curve ORDER BY seq) AS step FROM log)
SELECT well, curve, count(*) AS n, count(*) FILTER (isnan(md) OR isinf(md)) AS nonfinite, count(*) FILTER (md < 0) AS negative,
  count(*) FILTER (step = 0) AS repeated, coalesce(bool_and(step >= 0) OR bool_and(step <= 0), true) AS monotonic, count(*) < 3 AS too_sparse
FROM s GROUP BY well, curve""")
def log_depth_qc(spark, d):
    """Depth quality of each curve."""
    return S.sequence_quality(V.log_samples(spark, d), ["well", "curve"], ["seq"], "md")


@P.query(f"""WITH {_LOG}, s AS (SELECT *, md - lag(md) OVER (PARTITION BY well, curve ORDER BY seq) AS step FROM log)
SELECT well, curve, count(step) AS steps, CASE WHEN count(step) = 0 THEN 'insufficient' WHEN count(DISTINCT step) = 1 THEN 'regular' ELSE 'irregular' END AS sampling
FROM s GROUP BY well, curve""")
def log_sampling_regularity(spark, d):
    """Whether each curve is sampled evenly."""
    return S.regularity(V.log_samples(spark, d), ["well", "curve"], ["seq"], "md")


@P.query(f"""WITH {_LOG}, k AS (SELECT curve, raw AS v FROM log WHERE NOT is_null), r AS (SELECT curve, min(v) AS low, max(v) AS high FROM k GROUP BY curve),
c AS (SELECT curve, CAST(least(39, greatest(0, floor((v - low) / ((high - low) / 40)))) AS INT) AS bin, count(*) AS n FROM k JOIN r USING (curve) GROUP BY ALL),
e AS (SELECT curve, CAST(unnest(range(40)) AS INT) AS bin FROM r)
SELECT curve, bin, coalesce(n, 0) AS n FROM e LEFT JOIN c USING (curve, bin)""")
def log_value_histogram(spark, d):
    """Forty bins of each curve's values, the last one closed."""
    return S.histogram(V.log_samples(spark, d), ["curve"], S.masked("raw", "is_null"))


@P.query(f"""WITH {_LOG}, l AS (SELECT *, coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py) + (md - pm) * (md - pm)), 0) AS leg FROM (
  SELECT well, seq, md, raw AS x, raw * (seq % 7) AS y, lag(raw) OVER w AS px, lag(raw * (seq % 7)) OVER w AS py, lag(md) OVER w AS pm FROM log
  WINDOW w AS (PARTITION BY well ORDER BY seq)))
SELECT well, seq, round(sum(leg) OVER (PARTITION BY well ORDER BY seq ROWS UNBOUNDED PRECEDING), 2) AS length FROM l""")
def station_path_length(spark, d):
    """Length along each track up to each station."""
    return S.path_length(V.stations(spark, d), ["well"], ["seq"], ["x", "y", "md"], places=2).select("well", "seq", "length")


@P.query(f"""WITH {_LOG}, s AS (SELECT *, md - lag(md) OVER (PARTITION BY well ORDER BY seq) AS step FROM log)
SELECT well, count(*) AS stations, count(*) FILTER (md < 0) AS negative_md, count(*) FILTER (step = 0) AS equal_pairs, count(*) FILTER (step < 0) AS decreasing_pairs,
  min(step) AS least_step, max(step) AS most_step, CASE WHEN count(*) >= 3 THEN min(step) = max(step) END AS uniform FROM s GROUP BY well""")
def station_stats(spark, d):
    """Step evidence of each track."""
    return S.station_statistics(V.stations(spark, d), ["well"], ["seq"], "md")


@P.query(f"""WITH {_LOG} SELECT well, min(seq) AS seq, arg_min(md, seq) AS md, arg_min(raw, seq) AS x FROM log GROUP BY well""")
def first_station(spark, d):
    """The first station of each track."""
    best = F.min_by(F.struct("seq", "md", "x"), "seq").alias("s")
    return V.stations(spark, d).groupBy("well").agg(best).select("well", "s.seq", "s.md", "s.x")


@P.query(f"""WITH {_GRID} SELECT node, i, j, round(1000.0 + i * 25.0 * cos(radians(30)) - j * 50.0 * sin(radians(30)), 4) AS x,
  round(2000.0 + i * 25.0 * sin(radians(30)) + j * 50.0 * cos(radians(30)), 4) AS y FROM grid""")
def grid_coordinates(spark, d):
    """World coordinates of a rotated lattice."""
    return L.coordinates(V.grid_nodes(spark, d), (1000.0, 2000.0), (25.0, 50.0), 30.0, places=4).select("node", "i", "j", "x", "y")


@P.query(f"""WITH {_GRID}, {_GRID_B} SELECT i, j, CASE WHEN a.defined AND b.defined THEN a.raw - b.raw END AS difference
FROM grid a JOIN grid_b b USING (i, j)""")
def grid_difference(spark, d):
    """One grid minus another on the same lattice."""
    return L.difference(V.grid_nodes(spark, d), V.grid_nodes_b(spark, d))


@P.query(f"""WITH {_GRID}, c AS (SELECT *, CASE WHEN defined = lag(defined) OVER (PARTITION BY j ORDER BY i) THEN 0 ELSE 1 END AS change FROM grid),
r AS (SELECT *, sum(change) OVER (PARTITION BY j ORDER BY i) AS island FROM c)
SELECT j, min(i) AS start, count(*) AS length, defined FROM r GROUP BY j, island, defined""")
def grid_mask_rle(spark, d):
    """Definition runs along each row of the lattice."""
    return S.runs(V.grid_nodes(spark, d).select("i", "j", "defined"), ["j"], ["i"], "defined", "i").select("j", "start", "length", "defined")


@P.query(f"""WITH {_GRID} SELECT j, count(*) FILTER (defined) AS present, min(i) FILTER (defined) AS least_i, max(i) FILTER (defined) AS most_i,
  min(raw) FILTER (defined) AS least_raw, max(raw) FILTER (defined) AS most_raw FROM grid GROUP BY j""")
def grid_bounds(spark, d):
    """Bounds of the defined nodes of each row."""
    return S.bounds(V.grid_nodes(spark, d), ["j"], ["i", "raw"], ~F.col("defined"))


@P.query(f"""WITH {_GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY i) - 1 AS place, count(*) OVER (PARTITION BY j) AS total FROM grid)
SELECT j, i, raw, defined, place FROM r WHERE list_contains(list_transform(range(0, least(total, 8)), lambda s: s * (total - 1) // greatest(1, least(total, 8) - 1)), place)""")
def grid_preview_nodes(spark, d):
    """Eight nodes of each row, spread evenly, masks kept."""
    out = S.evenly(V.grid_nodes(spark, d).select("i", "j", "raw", "defined"), ["j"], ["i"], 8)
    return out.select("j", "i", "raw", "defined", F.col("at").cast("long").alias("place"))


@P.query(f"""WITH {_GRID} SELECT a.i, a.j, a.defined AND b.defined AND c.defined AND e.defined AS valid,
  CASE WHEN a.defined AND b.defined AND c.defined AND e.defined THEN round((a.raw + b.raw + c.raw + e.raw) / 4, 4) END AS mean
FROM grid a JOIN grid b ON b.i = a.i + 1 AND b.j = a.j JOIN grid c ON c.i = a.i AND c.j = a.j + 1 JOIN grid e ON e.i = a.i + 1 AND e.j = a.j + 1""")
def cell_validity(spark, d):
    """Cells whose four corners are defined, and their mean."""
    out = L.cells(V.grid_nodes(spark, d))
    return out.withColumn("mean", F.round("mean", 4))


@P.query(f"""WITH {_GRID}, {_GRID_B}, p AS (SELECT j, count(*) AS n, min(i) AS lo FROM grid WHERE defined GROUP BY j),
q AS (SELECT j, count(*) AS n, min(i) AS lo FROM grid_b WHERE defined AND j % 5 <> 4 GROUP BY j)
SELECT p.j, p.n, p.lo, CASE WHEN q.j IS NULL THEN 'parent_missing' WHEN p.n = q.n AND p.lo = q.lo THEN 'same_lattice' ELSE 'different_lattice' END AS status
FROM p LEFT JOIN q USING (j)""")
def lattice_parent_check(spark, d):
    """Whether a property's rows lie on their parent's lattice; never resampled."""
    def shape(g):
        return g.where("defined").groupBy("j").agg(F.count("*").alias("n"), F.min("i").alias("lo"))

    return L.same_descriptor(shape(V.grid_nodes(spark, d)), shape(V.grid_nodes_b(spark, d).where("j % 5 <> 4")), "j", ["n", "lo"])


@P.query(f"""WITH {_VERTICES}, s AS (SELECT *, sum(CAST(missing AS INT)) OVER (PARTITION BY line, part ORDER BY k1, k2, x, y ROWS UNBOUNDED PRECEDING) AS segment FROM v)
SELECT line, part, CAST(segment AS BIGINT) AS segment, count(*) AS vertices FROM s WHERE NOT missing GROUP BY line, part, segment HAVING count(*) >= 2""")
def polyline_segments(spark, d):
    """Polylines cut at missing vertices."""
    return S.segments(V.vertices(spark, d), ["line", "part"], _V_ORDER, "missing")


@P.query(f"""WITH {_VERTICES}, n AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY k1, k2, part, x, y) - 1 AS place, count(*) OVER (PARTITION BY line) AS total FROM v)
SELECT line, place, x, y FROM n WHERE place % greatest(1, CAST(ceil(total / 50) AS BIGINT)) = 0 OR place = total - 1""")
def polyline_decimation(spark, d):
    """At most about fifty vertices of each line, the last one kept."""
    out = S.decimated(V.vertices(spark, d), ["line"], ["k1", "k2", "part", "x", "y"], 50)
    return out.select("line", F.col("at").cast("long").alias("place"), "x", "y")


@P.query(f"""WITH {_VERTICES} SELECT line, count(*) FILTER (NOT missing) AS present, min(x) FILTER (NOT missing) AS least_x, max(x) FILTER (NOT missing) AS most_x,
  min(y) FILTER (NOT missing) AS least_y, max(y) FILTER (NOT missing) AS most_y FROM v GROUP BY line""")
def polygon_bounds(spark, d):
    """Bounding boxes over present vertices."""
    return S.bounds(V.vertices(spark, d), ["line"], ["x", "y"], F.col("missing"))


@P.query(f"""WITH {_LOG}, w AS (SELECT well, seq, raw, raw * (seq % 7) AS y, min(raw) OVER p AS lx, max(raw) OVER p AS hx, min(raw * (seq % 7)) OVER p AS ly,
  max(raw * (seq % 7)) OVER p AS hy FROM log WINDOW p AS (PARTITION BY well ORDER BY seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, CAST(coalesce(raw < lx - (hx - lx) OR raw > hx + (hx - lx), false) AS INT) + CAST(coalesce(y < ly - (hy - ly) OR y > hy + (hy - ly), false) AS INT) AS outside FROM w)
SELECT well, seq, outside, outside < 2 AS plausible FROM o""")
def envelope_plausibility(spark, d):
    """Each station against the box of the hundred before it."""
    return S.trailing_envelope(V.stations(spark, d), ["well"], ["seq"], ["x", "y"]).select("well", "seq", "outside", "plausible")


@P.query("""WITH u AS (SELECT vec_id, label, unnest(embedding) AS v FROM embeddings)
SELECT label AS inline, count(*) AS total, count(*) FILTER (v > -0.1::FLOAT AND v < 0.1::FLOAT) AS kept FROM u GROUP BY label""")
def amplitude_mask(spark, d):
    """Samples strictly inside an interval, by inline."""
    low, high = F.lit(-0.1).cast("float"), F.lit(0.1).cast("float")
    t = V.traces(spark, d).select("inline", L.amplitude_mask(F.col("samples"), low, high).alias("kept"))
    return t.groupBy("inline").agg(
        F.sum(F.size("kept").cast("long")).alias("total"), F.sum(F.size(F.array_compact("kept")).cast("long")).alias("kept")
    )


@P.query("""SELECT vec_id AS trace, vec_id // 20 AS line, vec_id % 20 AS crossline, 5000.0::DOUBLE + (vec_id // 20) * 12.5::DOUBLE + (vec_id % 20) * 0.0::DOUBLE AS x,
  7000.0::DOUBLE + (vec_id // 20) * 0.0::DOUBLE + (vec_id % 20) * 25.0::DOUBLE AS y FROM embeddings""")
def trace_headers(spark, d):
    """Line numbers and coordinates of each trace."""
    return L.trace_headers(V.traces(spark, d), 20, (5000.0, 7000.0), (12.5, 0.0), (0.0, 25.0))


@P.query("""SELECT vec_id AS trace, len(embedding) AS samples, CAST(list_min(embedding) AS DOUBLE) AS least, CAST(list_max(embedding) AS DOUBLE) AS most,
  len(list_filter(embedding, lambda v: v < 0)) AS negative FROM embeddings""")
def trace_statistics(spark, d):
    """Range and signs of each trace."""
    s = F.col("samples")
    return V.traces(spark, d).select(
        "trace", F.size(s).cast("long").alias("samples"), F.array_min(s).cast("double").alias("least"),
        F.array_max(s).cast("double").alias("most"), F.size(F.filter(s, lambda v: v < 0)).cast("long").alias("negative"),
    )


@P.query("""SELECT label AS inline, round(quantile_cont(abs(v), 0.98), 5) AS clip FROM (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label""")
def amplitude_clip(spark, d):
    """The amplitude that 98 percent of an inline's samples stay under."""
    t = V.traces(spark, d).select("inline", F.explode("samples").alias("v"))
    return t.groupBy("inline").agg(F.round(F.percentile(F.abs(F.col("v").cast("double")), 0.98), 5).alias("clip"))


@P.query(f"""WITH {_GRID}, {_GRID_B}, a AS (SELECT j, count(*) AS n, min(i) AS lo, max(i) AS hi FROM grid GROUP BY j), b AS (SELECT j, count(*) AS n, min(i) AS lo, max(i) AS hi FROM grid_b WHERE i < 45 OR j % 2 = 0 GROUP BY j)
SELECT j, a.n = b.n AS same_count, abs(a.lo - b.lo) <= 1e-8 AND abs(a.hi - b.hi) <= 1e-8 AS same_axis FROM a JOIN b USING (j)""")
def axis_compare(spark, d):
    """Axis agreement of two grids, row by row."""
    def shape(g, s):
        return g.groupBy("j").agg(F.count("*").alias(f"n{s}"), F.min("i").alias(f"lo{s}"), F.max("i").alias(f"hi{s}"))

    both = shape(V.grid_nodes(spark, d), "a").join(shape(V.grid_nodes_b(spark, d).where("i < 45 or j % 2 = 0"), "b"), "j")
    same = (F.abs(F.col("loa") - F.col("lob")) <= 1e-8) & (F.abs(F.col("hia") - F.col("hib")) <= 1e-8)
    return both.select("j", (F.col("na") == F.col("nb")).alias("same_count"), same.alias("same_axis"))


@P.query("""WITH c AS (SELECT s_suppkey AS cube, s_acctbal AS x0, s_acctbal + 100 AS x1, s_acctbal AS x2, s_acctbal + 100 + CASE WHEN s_suppkey % 9 = 0 THEN 1 ELSE 0 END AS x3,
  0.0::DOUBLE AS y0, 0.0::DOUBLE AS y1, CASE WHEN s_suppkey % 11 = 0 THEN 0.0 ELSE 50.0 END AS y2, CASE WHEN s_suppkey % 11 = 0 THEN 0.0 ELSE 50.0 END AS y3 FROM supplier)
SELECT cube, abs(x1 + x2 - x0 - x3) <= 1e-3 AND abs(y1 + y2 - y0 - y3) <= 1e-3 AS closed, (x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0) = 0 AS degenerate FROM c""")
def cube_plan(spark, d):
    """Affine closure of cube corners."""
    x, k = F.col("s_acctbal"), F.col("s_suppkey")
    high = F.when(k % 11 == 0, 0.0).otherwise(50.0)
    corners = V.table(spark, d, "supplier").select(
        k.alias("cube"), x.alias("x0"), (x + 100).alias("x1"), x.alias("x2"), (x + 100 + F.when(k % 9 == 0, 1).otherwise(0)).alias("x3"),
        F.lit(0.0).alias("y0"), F.lit(0.0).alias("y1"), high.alias("y2"), high.alias("y3"),
    )
    return L.affine_closure(corners).select("cube", "closed", "degenerate")
