"""Document fingerprints by MinHash.

A text's words (white space splits, A-Z lower-cased) form shingles of five words; a text of fewer words is one shingle.
``PERMUTATIONS`` universal hash functions x -> a*x + b map the 64-bit shingle hashes, in numpy over batches of texts, and the
smallest value of each is kept, 16 of its bits in the fingerprint. The share of equal places estimates the Jaccard
likeness of two shingle sets.

``near_duplicates`` joins signatures by bands: equal texts are made one, each band of ``ROWS`` places is a key, and only keys that two texts
share go on. Texts that share a band are compared by whole signatures, and two texts are linked only after their exact Jaccard likeness has been
computed and is at least the threshold (``linking`` has the rounds, and what they can lose). Of pairs at 0.8, 99.995 % share a band.

``edited_neighbours`` needs the next document in descending doc_id. Rows are dealt into ranges of (doc_id, text hash) by bounds
from a sample, one shuffle of the texts, which cross it compressed; the first row of each range is dealt to the range before it as well, so every row
meets the next one in a sorted stream, and no range is held whole.

Null texts count as empty; the empty text has no shingle, and a fingerprint of its own (likeness 1 to itself, 0 to
others but for chance). Null doc_ids come last. Rows of one doc_id follow each other by the hash of their text; equal rows are
interchangeable. A single row is its own next. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linking
from .common import packed, settle, table, unpacked
from .wordhash import CHUNK, Q, by_size, different, shingles_of

PERMUTATIONS = 128
ROWS = 5
THRESHOLD = 0.8
#: Pairs whose estimate is this much below the threshold still go to the exact check: four standard deviations of an estimate.
SLACK = 0.15
#: Sampled rows for each range bound.
SAMPLED = 30

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_EMPTY = (1 << 64) - 1


def signatures(texts: list[bytes]) -> np.ndarray:
    """A row of ``PERMUTATIONS`` 16-bit values for each text."""
    with np.errstate(over="ignore"):
        return _signatures(*shingles_of(texts))


def _signatures(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full((len(counts), PERMUTATIONS), _EMPTY, np.uint64)
        full = np.flatnonzero(counts)
        if len(full):
            begin = (np.cumsum(counts) - counts)[full]
            for k in range(PERMUTATIONS):
                out[full, k] = np.minimum.reduceat(hashes * _A[k] + _B[k], begin)
        out = (out ^ out >> np.uint64(29)) * np.uint64(Q)  # the smallest of many values has zeros at the top
    return (out >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


_SIGNED = T.StructType([T.StructField("signature", T.BinaryType()), T.StructField("sketch", T.BinaryType())])


@F.arrow_udf(_SIGNED)
def signed(texts: pa.Array) -> pa.Array:
    """A column of signatures and sketches, as bytes. A repeated shingle does not change a signature."""
    raws = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    rows, behind = [], []
    for part in by_size(raws):
        hashes, owner, sizes = different(part)
        rows += [r.tobytes() for r in _signatures(hashes, sizes)]
        behind += [r.tobytes() for r in linking.sketches(hashes, owner, sizes)]
    return pa.StructArray.from_arrays([pa.array(rows, pa.binary()), pa.array(behind, pa.binary())], names=["signature", "sketch"])


@F.arrow_udf(T.ArrayType(T.LongType()))
def bands(sigs: pa.Array) -> pa.Array:
    """A key for each band of a signature."""
    n = PERMUTATIONS // ROWS
    out = []
    for s in sigs.to_pylist():
        size = 2 * ROWS
        out.append(
            [
                int.from_bytes(hashlib.blake2b(bytes([k]) + s[k * size : (k + 1) * size], digest_size=8).digest(), "big", signed=True)
                for k in range(n)
            ]
        )
    return pa.array(out, pa.list_(pa.int64()))


@F.arrow_udf(T.BinaryType())
def short(sigs: pa.Array) -> pa.Array:
    """The low byte of each place of signatures: half as much to shuffle, and estimates from it are too high by 1/256 of what differs, never too low."""
    return pa.array([s[::2] for s in sigs.to_pylist()], pa.binary())


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimates of ``short`` signatures."""
    same = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]), np.uint8)
    for k in range(PERMUTATIONS):
        same += a[..., k] == b[..., k]
    return same.astype(np.float32) / np.float32(PERMUTATIONS)


def _classes(docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """(key, root) of the texts of ``docs`` that have a near duplicate."""
    texts = linking.keyed_texts(docs, text)
    one = texts.select("key", signed("text").alias("s")).groupBy("key").agg(F.any_value("s").alias("s"))
    one = settle(one.select("key", "s.signature", "s.sketch"), "signatures")
    members = one.select(F.explode(F.array_distinct(bands("signature"))).alias("bucket"), "key")
    prints = settle(one.select("key", F.concat(short("signature"), "sketch").alias("print")), "prints")
    return linking.rooted(texts, members, prints, alike, threshold - SLACK, threshold)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, the key of its text, and class_id, the smallest doc_id of its class (null if all are null)."""
    return linking.classes(docs, _classes(docs, text, threshold), doc_id, text)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, as ``linking.keep_first`` chooses it. All columns are carried."""
    return linking.keep_first(docs, _classes(docs, text, threshold), doc_id, text)


def _order(doc_id, h) -> tuple:
    """Ascending in the order of the stream: doc_id and hash descending, null doc_ids last."""
    return (doc_id is None, -(doc_id or 0), -h)


def _ranges(keys: DataFrame, n: int) -> list[tuple]:
    """Bounds of about n ranges of even size, from a sample that a hash of the key draws."""
    rows = keys.count()
    share = min(1.0, n * SAMPLED / max(rows, 1))
    drawn = keys.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).collect()
    sample = sorted(_order(*r) for r in drawn)
    return sorted({sample[k * len(sample) // n] for k in range(1, n)}) if len(sample) > n else []


def _range_of(bounds: list[tuple], heads: dict[int, tuple] | None = None):
    """The range of a key and, for a range's first key, the range before it too."""
    before: dict[tuple, list[int]] = {}
    if heads:
        ranges = sorted(heads)
        for k, r in enumerate(ranges):
            before.setdefault(heads[r], []).append(ranges[k - 1])

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ranged(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        out = []
        for key in map(_order, ids.to_pylist(), hashes.to_pylist()):
            out.append([bisect.bisect_right(bounds, key), *before.get(key, ())])
        return pa.array(out, pa.list_(pa.int32()))

    return ranged


_EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, "
    "class_id long"
)


def _neighbours(batches):
    """Rows (range, copied, doc_id, key, packed text, class_id) sorted by range, then own rows before the next range's first, in order: each
    own row with the row after it. A row without a text tells the class of the rows of its doc_id and key behind it."""

    def result(rows: list[tuple]) -> pa.RecordBatch:
        """For all but the last of rows (range, copied, doc_id, class_id, text)."""
        own = rows[:-1]
        edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for (*_, t), (*_, after) in zip(own, rows[1:], strict=True)]
        raws = [r[4].encode() for r in rows]
        sigs = np.concatenate([signatures(p) for p in by_size(raws)])
        changed = [e.encode() for e in edited]
        other = np.concatenate([signatures(p) for p in by_size(changed)])
        real = [k for k, (x, y) in enumerate(zip(own, rows[1:], strict=True)) if not x[1] and x[0] == y[0]]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([own[k][2] for k in real], pa.int64()),
                "n_chars": pa.array([len(own[k][4]) for k in real], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(changed[k]).hexdigest() for k in real], pa.string()),
                "fingerprint": pa.array(_hex(sigs[real]), pa.string()),
                "edited_fingerprint": pa.array(_hex(other[real]), pa.string()),
                "near_edited": pa.array(likeness(sigs[real], other[real]), pa.float64()),
                "near_next": pa.array(likeness(sigs[real], sigs[[k + 1 for k in real]]), pa.float64()),
                "class_id": pa.array([own[k][3] for k in real], pa.int64()),
            }
        )

    held: list[tuple] = []
    size, told, of = 0, None, None
    for batch in batches:
        for part, copied, doc_id, key, raw, class_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if raw is None:
                told, of = (doc_id, key), class_id
                continue
            if held and held[-1][1] and copied and held[-1][0] == part:
                continue  # equal first rows of the next range
            held.append((part, copied, doc_id, of if told == (doc_id, key) else None, unpacked(raw).decode()))
            size += len(held[-1][4])
            if size > 2 * CHUNK and len(held) > 1:
                yield result(held)
                held, size = held[-1:], len(held[-1][4])
    if len(held) > 1:
        yield result(held)


def edited_neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", classes: DataFrame | None = None) -> DataFrame:
    """For each row its fingerprint, that of the text whose last half is replaced by the start of the next document, and
    how like the fingerprint is to that one and to the next document's. ``classes`` as by ``near_duplicates`` gives class_id, else null."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own = own.withColumn("h", linking.key_of("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = settle(own.select("doc_id", "h"), "keys")
    bounds = _ranges(keys, n)
    in_range = F.element_at(_range_of(bounds)("doc_id", "h"), 1)
    first = F.struct(F.col("doc_id").isNull(), -F.coalesce("doc_id", F.lit(0)), -F.col("h"))
    heads = {
        r["range"]: tuple(r["first"])
        for r in keys.withColumn("range", in_range).groupBy("range").agg(F.min(first).alias("first")).collect()
    }
    dealt = own.select("doc_id", packed("text").alias("raw"), "h", F.posexplode(_range_of(bounds, heads)("doc_id", "h")).alias("copied", "range"))
    rows = dealt.select("range", F.col("copied") > 0, "doc_id", "h", "raw", F.lit(None).cast("long").alias("class_id"))
    if classes is not None:
        told = classes.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("key").alias("h"), "class_id").distinct()
        told = told.select(in_range, F.lit(False), "doc_id", "h", F.lit(None).cast("binary"), "class_id")
        rows = rows.union(told)
    rows = rows.toDF("range", "copied", "doc_id", "h", "raw", "class_id").repartition(n, "range")
    ordered = rows.sortWithinPartitions("range", "copied", F.desc_nulls_last("doc_id"), F.desc("h"), F.col("raw").isNotNull())
    return ordered.mapInArrow(_neighbours, _EDITED)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and the class of near duplicates that it is in."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_neighbours(docs, classes=near_duplicates(docs))
