"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's words, laid end to end in a seeded order of its documents and repeated ``most`` times, are cut into blocks of ``block`` words (the
last may be shorter). A mix has as many blocks as its words need. Seats go to the highest quotients target / (2k + 1), k being the seats a source has, and never
more to a source than it has blocks. The seats in the order of their quotients are dealt to shards of ``shard_blocks`` blocks: the method is house
monotone, so a shard's quotas are the seats of all shards up to it less those of the shards before, integers that follow the targets in every shard.

A source with quota q takes all blocks of its whole repetitions and, of the repetition that is left, the ones that a seeded permutation of the blocks
puts first. So no document is taken more than ``most`` times, and a document's words in the mix are summed over its own blocks without a row for each block.

``quotas`` finds the seats without listing them: a divisor gives each source a quota that is nearly right, and only the few quotients about it are ranked, some
three for each source. Weights go by the source's rank, ``WEIGHTS`` repeating, and targets are lowered to ``most`` times the source's size, the excess going to the others by
weight until none is above.

*Scale.* Texts are read once, to their word counts, and cross no shuffle. A source is spread over ``BUCKETS`` buckets by the top bits of the hash that orders it, and
offsets run within a bucket after those of the buckets before, so no task holds a source. Equal rows (doc_id and text alike) are counted
before any shuffle of a bucket and dealt out afterwards. Only DataFrame functions are used. The table of sources has a row each; ranks over it take one sort by range (``scan``).

Null texts have no words. The null source is a source, the last. Repeated rows count each. Null doc_ids are ordered like others. An empty
table gives no rows; sources without words get target 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import ranged
from .common import settle, table

WEIGHTS = (5, 2, 1)
#: Times that a document is taken at most.
MOST = 3
#: Words of a block; a source misses its target by about half of it.
BLOCK = 16
#: Blocks of a shard of the mix.
SHARD_BLOCKS = 1 << 16
#: Buckets of a source, a power of two.
BUCKET_BITS = 10
SEED = 20
#: Multipliers of the permutation of blocks, primes: one that does not divide the number of blocks is used.
STEPS = (1_000_003, 999_983)


def words(text: Column) -> Column:
    """How many runs of characters other than white space there are, without a list of them."""
    gap = r"[\x20\x09-\x0D]*+"
    marks = F.regexp_replace(text, rf"{gap}[^\x20\x09-\x0D]++{gap}", ".")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, place) of all rows, place being a hash of 60 bits that orders a source."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(doc_id), F.col(text)))
    place = F.conv(F.substring(mark, 1, 15), 16, 10).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words(F.col(text)).alias("size"), place.alias("place"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to the same with weight and target; the targets add up to the sum of sizes."""
    rank = ranged(sources, [], ["source"]).numbered("rank")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    now = settle(rank.select("source", "source_size", weight.cast("long").alias("weight")), "weights")
    room = F.lit(most) * F.col("source_size")
    total, over, known = now.agg(F.sum("source_size"), F.sum("weight"), F.count("*")).first()
    left, n = total or 0, 0
    while over:  # each round fills a source at least, mostly many; the level only rises
        full = room * F.lit(over) < F.col("weight") * F.lit(left)
        filled, free, capped = now.agg(F.sum(F.when(full, room)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        level = F.col("weight") * F.lit(float(left)) / F.lit(float(over))
        if capped == n:
            return now.withColumn("target", F.when(full, room.cast("double")).otherwise(level))
        left, over, n = (total or 0) - (filled or 0), free, capped
    return now.withColumn("target", room.cast("double"))


def quotas(sources: DataFrame, seats: int, shard_blocks: int | None = None) -> DataFrame:
    """(source, target, blocks) to (source, shard, seats_before, quota): the seats of each source in each shard of ``shard_blocks`` seats (one shard without it), shards
    from 0, by Sainte-Laguë's highest quotients. A source has ``blocks`` seats at most, none without a target. Of equal quotients the source that is smaller by code point has
    the first, null last."""
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    shard_blocks = shard_blocks or max(seats, 1)
    last = max(-(-seats // shard_blocks), 1)
    room = F.when(F.col("target") > 0, F.col("blocks")).otherwise(F.lit(0)).alias("blocks")
    houses = sources.select("source", "target", room, F.explode(F.sequence(F.lit(1), F.lit(last))).alias("house"))
    house = F.least(F.col("house") * F.lit(shard_blocks).cast("long"), F.lit(seats).cast("long"))
    near = F.floor(F.col("target") * house / F.lit(total or 1.0) + 0.5).cast("long")
    now = settle(houses.withColumn("near", F.least(near, F.col("blocks"))), "near")
    open_target = F.sum(F.when(F.col("near") < F.col("blocks"), F.col("target")))
    sums = now.groupBy("house").agg(F.count("*").alias("n"), F.sum("near").alias("given"), open_target.alias("free"), F.sum("target").alias("all"), F.sum("blocks").alias("places"))
    sums = sums.select("house", "n", "free", "all", (F.least(house, F.col("places")) - F.col("given")).alias("over"))
    asked = now.join(sums.where("over <> 0"), "house")
    # seats that a source can gain or lose until all are right: its share of those in question, and one more
    share = F.col("target") * (F.abs("over") + F.col("n")) / F.when(F.col("over") > 0, F.col("free")).otherwise(F.col("all"))
    reach = (F.ceil(share) + 1).cast("long")
    first = F.when(F.col("over") > 0, F.col("near")).otherwise(F.greatest(F.col("near") - reach, F.lit(0)))
    end = F.when(F.col("over") > 0, F.least(F.col("near") + reach, F.col("blocks"))).otherwise(F.col("near"))
    seat = F.explode(F.when(first < end, F.sequence(first, end - 1)))
    bids = asked.select("house", "source", "over", "target", seat.alias("seat"))
    bids = bids.withColumn("quotient", F.col("target") / (2 * F.col("seat") + 1))
    best = Window.partitionBy("house").orderBy(F.desc("quotient"), F.asc_nulls_last("source"), "seat")
    worst = Window.partitionBy("house").orderBy("quotient", F.desc_nulls_first("source"), F.desc("seat"))
    won = bids.where("over > 0").withColumn("turn", F.row_number().over(best)).where("turn <= over")
    lost = bids.where("over < 0").withColumn("turn", F.row_number().over(worst)).where("turn <= -over")
    moved = won.unionByName(lost).groupBy(F.col("house").alias("at"), F.col("source").alias("of")).agg(F.sum(F.signum("over")).cast("long").alias("moved"))
    made = now.join(moved, (now["house"] == moved["at"]) & now["source"].eqNullSafe(moved["of"]), "left")
    upto = made.select("source", "house", (F.col("near") + F.coalesce("moved", F.lit(0))).alias("upto"))
    before = F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy("house")), F.lit(0))
    return upto.select("source", (F.col("house") - 1).alias("shard"), before.alias("seats_before"), (F.col("upto") - before).alias("quota"))


def _turn(block: Column, n: Column, seed: int) -> Column:
    """Where a seeded permutation of n blocks puts one."""
    one, two = (F.lit(s).cast("long") for s in STEPS)
    step = F.when(n % one != 0, one).when(n % two != 0, two).otherwise(F.lit(1).cast("long"))
    return F.pmod(block * step + F.lit(seed * 7919), n)


def _chosen(block: Column, seed: int) -> Column:
    """Whether a block of the repetition that is not whole is taken."""
    return _turn(block - F.col("whole"), F.greatest(F.col("part_end") - F.col("whole"), F.lit(1)), seed) < F.col("quota") - F.col("whole")


def plan(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(source, size) to a row for each source: source_size, target, blocks, quota, ``whole`` (blocks of the repetitions that are taken whole) and
    ``part_end`` (the end of the blocks of the next one)."""
    sources = settle(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    made = targets(sources, weights, most).withColumn("blocks", F.ceil(F.lit(most) * F.col("source_size") / block).cast("long"))
    made = settle(made, "targets")
    total = made.agg(F.sum("source_size")).first()[0] or 0
    seats = max(1, (2 * total + block) // (2 * block)) if total else 0
    given = quotas(made, seats).select(F.col("source").alias("of"), "quota")
    out = made.join(given, made["source"].eqNullSafe(given["of"])).drop("of")
    starts = [F.ceil(F.lit(k) * F.col("source_size") / block).cast("long") for k in range(most + 1)]
    whole, part = starts[0], starts[1]
    for k in range(1, most):
        whole = F.when(F.col("quota") >= starts[k], starts[k]).otherwise(whole)
        part = F.when(F.col("quota") >= starts[k], starts[k + 1]).otherwise(part)
    return out.withColumns({"whole": whole, "part_end": part})


def placed(rows: DataFrame) -> DataFrame:
    """(doc_id, source, size, place) to (doc_id, source, size, begin): where each document's words begin in its source."""
    bucket = F.shiftright("place", 60 - BUCKET_BITS)
    alike = rows.groupBy("source", "place", "doc_id", "size").agg(F.count("*").alias("copies"))
    alike = settle(alike.withColumn("bucket", bucket), "rows")
    own = F.col("size") * F.col("copies")
    ends = alike.groupBy("source", "bucket").agg(F.sum(own).alias("n"))
    past = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select(F.col("source").alias("of"), F.col("bucket").alias("at"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("bucket_begin"))
    order = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = alike.withColumn("run", F.coalesce(F.sum(own).over(order), F.lit(0)))
    met = run.join(begins, run["source"].eqNullSafe(begins["of"]) & (run["bucket"] == begins["at"]))
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    out = met.select("doc_id", "source", "size", (F.col("bucket_begin") + F.col("run")).alias("start"), copy)
    return out.select("doc_id", "source", "size", (F.col("start") + F.col("copy") * F.col("size")).alias("begin"))


def _planned(laid: DataFrame, sources: DataFrame) -> DataFrame:
    return laid.join(sources.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")


def _shared(block: Column, lo: Column, hi: Column, width: int) -> Column:
    """Words of a block between two places of the stream."""
    return F.least(hi, (block + 1) * width) - F.greatest(lo, block * width)


def _words_of(first: Column, end: Column, lo: Column, hi: Column, width: int, seed: int) -> Column:
    """Words between two places of the stream that lie in chosen blocks from ``first`` to before ``end``."""

    def add(n: Column, b: Column) -> Column:
        return n + F.when(_chosen(b, seed), _shared(b, lo, hi, width)).otherwise(F.lit(0))

    return F.aggregate(F.sequence(first, end - 1), F.lit(0).cast("long"), add)


def mixed(rows: DataFrame, sources: DataFrame, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The rows of ``sized`` with the columns of ``plan`` and ``taken``, the words that the mix takes of each."""
    now, taken = _planned(placed(rows), sources), F.lit(0).cast("long")
    for k in range(most):
        lo = F.col("begin") + k * F.col("source_size")
        hi = lo + F.col("size")
        taken = taken + F.greatest(F.least(hi, F.col("whole") * block) - lo, F.lit(0))
        first = F.greatest(F.col("whole"), F.floor(lo / block))
        end = F.least(F.col("part_end"), F.ceil(hi / block))
        some = (F.col("size") > 0) & (F.col("quota") > F.col("whole")) & (first < end)
        taken = taken + F.when(some, _words_of(first, end, lo, hi, block, seed)).otherwise(F.lit(0))
    return now.withColumn("taken", taken)


def slices(rows: DataFrame, sources: DataFrame, shard_blocks: int = SHARD_BLOCKS, most: int = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix itself: (shard, source, block, turn, doc_id, begin, words), a row for each part of a document in a block that is taken; begin counts the document's words from
    0, turn is the block's place in its source's order. Shards hold the quotas of ``quotas``."""
    now, parts = _planned(placed(rows), sources).where("size > 0"), None
    for k in range(most):
        lo = F.col("begin") + k * F.col("source_size")
        hi = lo + F.col("size")
        one = now.withColumns({"lo": lo, "hi": hi}).withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.ceil(F.col("hi") / block) - 1)))
        parts = one if parts is None else parts.unionByName(one)
    whole = F.col("block") < F.col("whole")
    some = (F.col("block") < F.col("part_end")) & _chosen(F.col("block"), seed)
    turn = F.when(whole, F.col("block")).otherwise(F.col("whole") + _turn(F.col("block") - F.col("whole"), F.greatest(F.col("part_end") - F.col("whole"), F.lit(1)), seed))
    kept = parts.where(whole | some).select(
        "source", "block", turn.alias("turn"), "doc_id", (F.greatest("lo", F.col("block") * block) - F.col("lo")).alias("begin"), _shared(F.col("block"), F.col("lo"), F.col("hi"), block).alias("words")
    )
    total = sources.agg(F.sum("quota")).first()[0] or 0
    given = quotas(sources, total, shard_blocks).where("quota > 0")
    seats = given.select(F.col("source").alias("of"), "shard", F.explode(F.sequence("seats_before", F.col("seats_before") + F.col("quota") - 1)).alias("seat"))
    met = kept.join(seats, kept["source"].eqNullSafe(seats["of"]) & (kept["turn"] == seats["seat"]))
    return met.select("shard", "source", "block", "turn", "doc_id", "begin", "words")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes of each."""
    rows = settle(sized(table(spark, sf_dir, "documents")), "sizes")
    out = mixed(rows, settle(plan(rows), "plan"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "quota")


#: The level of the targets is found over all numbers of filled sources, seats by ranking every quotient, words by listing every block.
ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(concat_ws('|', '{SEED}', doc_id, text)), 1, 15) AS BIGINT) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight FROM s),
z AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, encode(source) NULLS LAST) AS turn FROM w),
v AS (SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum({MOST} * source_size) OVER (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weighs FROM z),
u AS (SELECT arg_min(struct_pack(rest := total - below, weighs := weighs), turn) AS l FROM v
  WHERE {MOST} * source_size * weighs >= weight * (total - below)),
t AS (SELECT source, source_size, CASE WHEN {MOST} * source_size * l.weighs < weight * l.rest THEN CAST({MOST} * source_size AS DOUBLE)
    ELSE weight * CAST(l.rest AS DOUBLE) / CAST(l.weighs AS DOUBLE) END AS target,
    CAST(ceil({MOST} * source_size / {BLOCK}) AS BIGINT) AS blocks, CAST(total AS BIGINT) AS total FROM v, u),
b AS (SELECT *, target / (2 * seat + 1) AS quotient FROM (SELECT *, unnest(range(blocks)) AS seat FROM t)),
r AS (SELECT *, row_number() OVER (ORDER BY quotient DESC, encode(source) NULLS LAST, seat) AS turn FROM b),
q AS (SELECT source, count(*) AS quota FROM r WHERE turn <= greatest(1, (2 * total + {BLOCK}) // {2 * BLOCK}) GROUP BY source),
g AS (SELECT t.*, coalesce(quota, 0) AS quota FROM t LEFT JOIN q ON t.source IS NOT DISTINCT FROM q.source),
h AS (SELECT *, list_max(list_filter(range({MOST}), lambda k: ceil(k * source_size / {BLOCK}) <= quota)) AS turns FROM g),
i AS (SELECT *, CAST(ceil(turns * source_size / {BLOCK}) AS BIGINT) AS whole, CAST(ceil((turns + 1) * source_size / {BLOCK}) AS BIGINT) AS part_end FROM h),
j AS (SELECT *, part_end - whole AS n FROM i),
a AS (SELECT *, unnest(range(quota)) AS block FROM j WHERE quota <= whole
  UNION ALL SELECT * FROM (SELECT *, unnest(range(part_end)) AS block FROM j WHERE quota > whole) WHERE block < whole OR
    ((block - whole) * CASE WHEN n % {STEPS[0]} <> 0 THEN {STEPS[0]} WHEN n % {STEPS[1]} <> 0 THEN {STEPS[1]} ELSE 1 END + {SEED * 7919}) % n < quota - whole),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM d),
e AS (SELECT o.*, row_number() OVER () AS row, unnest(range({MOST})) AS k FROM o),
f AS (SELECT e.*, begin + k * source_size AS lo, begin + k * source_size + size AS hi FROM e JOIN j ON e.source IS NOT DISTINCT FROM j.source),
x AS (SELECT row, k, source, lo, hi, unnest(range(CAST(lo // {BLOCK} AS BIGINT), CAST(ceil(hi / {BLOCK}) AS BIGINT))) AS block FROM f WHERE size > 0),
y AS (SELECT row, sum(least(hi, (x.block + 1) * {BLOCK}) - greatest(lo, x.block * {BLOCK})) AS taken
  FROM x JOIN a ON x.source IS NOT DISTINCT FROM a.source AND x.block = a.block GROUP BY row)
SELECT e.doc_id, e.size, j.source_size, j.target, CAST(coalesce(y.taken, 0) AS BIGINT) AS taken, e.source, CAST(j.quota AS BIGINT) AS quota
FROM e JOIN j ON e.source IS NOT DISTINCT FROM j.source LEFT JOIN y ON e.row = y.row WHERE k = 0
"""
