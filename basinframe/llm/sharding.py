"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards with weights. A key descends it: at each level every child draws a number from a
hash of the key and the child's own name, -ln(u) divided by the child's weight, and the smallest draw wins. A child wins with
a chance in proportion to its weight, and a child's draw depends on no other child. So when weights change, keys move only into
children whose weight grew or out of those whose weight fell, level by level: a subtree whose weights do not
change, below ancestors that do not, keeps its keys.

One more shard is a new region of its own (``Tree.grown``): no other child's draw changes at any level, so keys move
into the new shard only. This is the law ``key``: doc_id and the tree decide.

Draws and descent are DataFrame expressions over the keys; no shuffle is needed to place a row. ``slots`` numbers the rows
of a shard without gaps, by (doc_id, size, text_crc32), null doc_ids last: rows are sorted by range, counted per range and shard,
and each range starts where the ranges before it end. Only the three numbers of each row are shuffled; equal rows, which
any order fits, are spread by a salt.

Null texts have size 1 and the crc32 of no bytes, 0. A null doc_id is a key like any other. Repeated rows go to one shard and
get a slot each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

#: Hexadecimal digits of a draw's hash: 52 bits, which a double holds exactly.
DIGITS = 13


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


@dataclass(frozen=True)
class Tree:
    shards: tuple[Shard, ...]

    @staticmethod
    def regular(regions: int, racks: int, shards: int) -> Tree:
        """So many of each, all of weight 1, numbered from 0."""
        places = [(r, k) for r in range(regions) for k in range(racks) for _ in range(shards)]
        return Tree(tuple(Shard(f"region{r}", f"rack{k}", n) for n, (r, k) in enumerate(places)))

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, in a region of its own."""
        n = 1 + max(s.number for s in self.shards)
        return Tree((*self.shards, Shard(f"added{n}", "rack0", n, weight)))

    def weighted(self, weights: dict[int, float]) -> Tree:
        """With other weights for some shards."""
        return Tree(tuple(Shard(s.region, s.rack, s.number, weights.get(s.number, s.weight)) for s in self.shards))

    def children(self, *above: str) -> dict[str, float]:
        """Names and weights below a region and rack; a weight is the sum of the shards' below."""
        out: dict[str, float] = {}
        for s in self.shards:
            path = (s.region, s.rack, str(s.number))
            if path[: len(above)] == above:
                out[path[len(above)]] = out.get(path[len(above)], 0.0) + s.weight
        return {name: w for name, w in out.items() if w > 0}


def draw(key: Column, name: str, weight: float) -> Column:
    """A child's draw for a key; the smallest wins."""
    number = F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(name))), 1, DIGITS), 16, 10).cast("double")
    return -F.log((number + 0.5) / float(16**DIGITS)) / weight


def _winner(tree: Tree, key: Column, *above: str) -> Column:
    """The name of the winning child, a column."""
    children = tree.children(*above)
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = [F.struct(draw(key, "/".join((*above, c)), w).alias("draw"), F.lit(c).alias("child")) for c, w in children.items()]
    return F.array_min(F.array(*draws))["child"]


def place(rows: DataFrame, key: Column, tree: Tree, into: str) -> DataFrame:
    """``rows`` and the shard of each key. Each level's winner is a column of its own, so draws are taken once."""
    region, rack = f"{into}_region", f"{into}_rack"
    now = rows.withColumn(region, _winner(tree, key))
    second = F.lit(None).cast("string")
    for r in tree.children():
        second = F.when(F.col(region) == r, _winner(tree, key, r)).otherwise(second)
    now = now.withColumn(rack, second)
    last = F.lit(None).cast("string")
    for r in tree.children():
        for k in tree.children(r):
            last = F.when((F.col(region) == r) & (F.col(rack) == k), _winner(tree, key, r, k)).otherwise(last)
    return now.withColumn(into, last.cast("int")).drop(region, rack)


def slots(placed: DataFrame, shard: str = "shard", order: tuple[str, ...] = ("doc_id", "size", "text_crc32")) -> DataFrame:
    """``placed`` and a gapless number in each shard, by ``order``. Rows should be narrow: they are sorted by range."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.asc_nulls_last(c) for c in order]
    ranged = placed.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(n, *by, "salt")
    rows = settle(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    ends = rows.groupBy(shard, "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = ends.select(shard, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("range", shard).orderBy(*by, "salt")
    numbered = rows.withColumn("at", F.row_number().over(within)).join(begins, [shard, "range"])
    return numbered.withColumn("slot", (F.col("at") + F.col("begin") - 1).cast("long")).drop("at", "begin", "range", "salt")


def sharded(docs: DataFrame, tree: Tree, doc_id: str = "doc_id", text: str = "text", grown: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and, where a grown tree is given, grown_shard."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32")
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    now = place(rows, key, tree, "shard")
    now = place(now, key, grown, "grown_shard") if grown else now.withColumn("grown_shard", F.lit(None).cast("int"))
    return slots(now)


#: 8 shards: two regions of two racks of two.
TREE = Tree.regular(2, 2, 2)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, and its shard when there is one more."""
    out = sharded(table(spark, sf_dir, "documents"), TREE, grown=TREE.grown())
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_winner(tree: Tree, *above: str) -> str:
    """``_winner`` for DuckDB, over a text ``k``."""
    children = tree.children(*above)
    if len(children) == 1:
        return f"'{next(iter(children))}'"
    draws = [
        f"{{'draw': -ln((CAST('0x' || substr(md5(k || '|{'/'.join((*above, c))}'), 1, {DIGITS}) AS BIGINT) + 0.5) / {float(16**DIGITS)!r}) / {w!r}, 'child': '{c}'}}"
        for c, w in children.items()
    ]
    return f"list_sort([{', '.join(draws)}])[1].child"


def _sql_place(tree: Tree) -> str:
    racks = [(r, k) for r in tree.children() for k in tree.children(r)]
    inner = " ".join(f"WHEN '{r}/{k}' THEN {_sql_winner(tree, r, k)}" for r, k in racks)
    outer = " ".join(f"WHEN '{r}' THEN '{r}/' || {_sql_winner(tree, r)}" for r in tree.children())
    return f"(SELECT CAST(CASE place {inner} END AS INT) FROM (SELECT CASE {_sql_winner(tree)} {outer} END AS place))"


#: CRC-32 goes byte by byte over a table that the query builds from the polynomial.
ORACLE = f"""
WITH c AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda v, n: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295,
    list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) AS text_crc32,
  {_sql_place(TREE)} AS shard, {_sql_place(TREE.grown())} AS grown_shard FROM d, c)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, grown_shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS LAST, size, text_crc32) - 1 AS slot FROM p
"""
