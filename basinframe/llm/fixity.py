"""WARC fixity audit by Merkle trees over offset ranges.

Records lie in files at offsets. A leaf is the hash of the records that start in one range of ``RANGE`` bytes of a file, in
the order of their offsets; each level above hashes ``FANOUT`` neighbouring ranges, up to one root per file. Two
replicas are compared from the root down: only children of ranges whose hashes differ are looked at on the
next level, and only in the leaves that still differ are records compared.

Groups are bounded: a range has at most ``RANGE`` records of a byte or more each, a node ``FANOUT`` children. Record hashes and levels
are written as tables, so a descent reads small columns only and a lost executor costs no second hash of the payloads.

A record is ``corrupt`` if both replicas have one at its offset and they differ, ``missing`` if the second replica lacks it,
``extra`` if only the second has it, else ``intact``. Null payloads are hashed as empty, null record ids are written as
empty. Repeated rows (same file, offset, length and hash) are one record with a count, which is hashed too. A file that one replica
lacks is missing as a whole. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

RANGE = 1 << 16
FANOUT = 16
#: Pages in a WARC file of the query.
RECORDS_PER_FILE = 512


def record_text(record_id: Column, uri: Column, payload: Column) -> Column:
    """A response record: its WARC header, the payload and the closing line feeds."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def _joined(items: Column) -> Column:
    return F.sha2(F.array_join(items, "\n"), 256)


def leaves(records: DataFrame, span: int = RANGE) -> DataFrame:
    """(replica, file, at, length, digest, copies) to (replica, file, node, hash): one leaf for each range."""
    one = F.struct("at", "length", "digest", "copies")
    spelt = F.transform(F.array_sort(F.collect_list(one)), lambda r: F.concat_ws(" ", r["at"], r["length"], r["digest"], r["copies"]))
    return records.groupBy("replica", "file", F.floor(F.col("at") / span).alias("node")).agg(_joined(spelt).alias("hash"))


def parents(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The level above."""
    one = F.struct("node", "hash")
    spelt = F.transform(F.array_sort(F.collect_list(one)), lambda r: F.concat_ws(" ", r["node"], r["hash"]))
    return level.groupBy("replica", "file", F.floor(F.col("node") / fanout).alias("node")).agg(_joined(spelt).alias("hash"))


def distinct_records(records: DataFrame) -> DataFrame:
    return records.groupBy("replica", "file", "at", "length", "digest").agg(F.count("*").alias("copies"))


def trees(records: DataFrame, span: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of all files of both replicas, leaves first, as written tables. The longest file sets the height."""
    last = records.agg(F.max("at")).first()[0]
    height = 0 if last is None else math.ceil(math.log(max(1, last // span + 1), fanout) - 1e-12)
    out = [settle(leaves(records, span), "leaves")]
    for k in range(height):
        out.append(settle(parents(out[-1], fanout), f"level{k + 1}"))
    return out


def _differing(level: DataFrame) -> DataFrame:
    """(file, node) whose hashes differ, or that one replica lacks."""
    return (
        level.groupBy("file", "node")
        .agg(F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        .where("n < 2 or low <> high")
        .select("file", "node")
    )


def differing_leaves(levels: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """(file, node) of leaves whose hashes differ, found from the roots down."""
    found = settle(_differing(levels[-1]), "roots")
    for level in levels[-2::-1]:
        above = found.select("file", F.col("node").alias("parent"))
        below = level.withColumn("parent", F.floor(F.col("node") / fanout)).join(above, ["file", "parent"], "left_semi")
        found = settle(_differing(below), "differing")
    return found


def audit(records: DataFrame, span: int = RANGE, fanout: int = FANOUT) -> DataFrame:
    """(replica 'a' or 'b', file, at, length, digest) to (file, at, length, digest, status): one row per record of replica a,
    and one per extra record of b; digest and length are a's, or b's for an extra one."""
    own = settle(distinct_records(records), "records")
    levels = trees(own, span, fanout)
    bad = differing_leaves(levels, fanout)
    node = F.floor(F.col("at") / span)
    there = own.withColumn("node", node)
    suspect = there.join(bad, ["file", "node"], "left_semi")
    key = ["file", "at"]
    left = suspect.where("replica = 'a'").select(*key, "length", "digest", "copies")
    right = suspect.where("replica = 'b'").select(*key, "length", "digest", "copies")
    same = left.join(right, [*key, "length", "digest", "copies"], "left_semi")
    wrong = left.join(same, [*key, "length", "digest", "copies"], "left_anti")
    status = F.when(F.col("known"), "corrupt").otherwise("missing")
    offsets = right.select(*key).distinct().withColumn("known", F.lit(True))
    damaged = wrong.join(offsets, key, "left").select(*key, "length", "digest", status.alias("status"))
    extra = right.join(left.select(*key), key, "left_anti").select(*key, "length", "digest", F.lit("extra").alias("status"))
    intact = there.where("replica = 'a'").join(bad, ["file", "node"], "left_anti").select(*key, "length", "digest")
    fine = intact.unionByName(same.select(*key, "length", "digest")).withColumn("status", F.lit("intact"))
    return fine.unionByName(damaged).unionByName(extra)


def lay_out(pages: DataFrame, records_per_file: int = RECORDS_PER_FILE) -> DataFrame:
    """(record_id, text, file) to the same with length, digest and ``at``: records follow each other in a file by record_id."""
    sized = pages.withColumn("length", F.octet_length("text").cast("long")).withColumn("digest", F.sha2("text", 256)).drop("text")
    before = Window.partitionBy("file").orderBy("record_id", "digest", "length").rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("at", F.coalesce(F.sum("length").over(before), F.lit(0)))


def damaged(payload: Column) -> Column:
    """A payload with its first character changed; an empty one stays."""
    first = F.when(F.substring(payload, 1, 1) == "X", "Y").otherwise("X")
    return F.when(F.length(payload) > 0, F.concat(first, F.substring(payload, 2, 1 << 30))).otherwise(payload)


def op1_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC files, and a second replica in which a hash of page_id damages some records and loses others: each
    record's place and what the audit finds."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    fate = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit(""))), 1, 2)
    file = F.floor(F.col("page_id") / RECORDS_PER_FILE)
    made = pages.select(
        F.col("page_id").alias("record_id"),
        F.coalesce(file, F.lit(-1)).alias("file"),
        fate.alias("fate"),
        F.sha2(record_text(F.col("page_id"), F.col("url"), damaged(F.col("html"))), 256).alias("other"),
        record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("text"),
    )
    first = settle(lay_out(made), "catalogue")
    second = first.where("fate <> '01'").withColumn("digest", F.when(F.col("fate") == "00", F.col("other")).otherwise(F.col("digest")))
    columns = ["file", "at", "length", "digest"]
    both = first.select(F.lit("a").alias("replica"), *columns).unionByName(second.select(F.lit("b").alias("replica"), *columns))
    return audit(both)


ORACLE = r"""
WITH p AS (
  SELECT page_id, floor(page_id / 512)::BIGINT AS file, coalesce(url, '') AS url, coalesce(html, '') AS html,
    substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS fate FROM pages),
r AS (
  SELECT *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
    || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html'
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html
    || chr(13) || chr(10) || chr(13) || chr(10) AS text FROM p),
d AS (SELECT *, CAST(strlen(text) AS BIGINT) AS length, sha256(text) AS digest FROM r)
SELECT file, CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS BIGINT) AS at, length, digest,
  CASE WHEN fate = '01' THEN 'missing' WHEN fate = '00' AND html <> '' THEN 'corrupt' ELSE 'intact' END AS status
FROM d
"""
