"""Classes of texts linked by an exact Jaccard likeness of their five-word shingles.

An operator brings buckets (bands or anchors) and a print of each text from which a likeness can be estimated. Only texts that share
a bucket are compared, and only pairs whose estimate is at least ``least`` are proposed; a proposed pair becomes a link after its
exact likeness has been computed from the two texts. Classes are what links connect.

*Rounds.* Work goes by classes, not by pairs, so that a large group of copies costs about as many checks as it has texts:

1. ``MERGES`` rounds compare the representatives of a bucket's classes in blocks of about ``TOGETHER``. Each proposes itself with the most
   likely one below it (by key); of what all buckets propose for a text the likeliest is checked. What passes is contracted. After the
   first round only texts stay in a bucket that have a likely partner there, or whose bucket has several blocks.
2. Then blocks of a bucket meet in pairs, and each class proposes its ``FIRST`` likeliest pairs with classes of a smaller root; where a class has more, all go on to a round of ``MORE`` times as
   many. The last round is the one in which no class has more than it proposes: every pair of two classes whose estimate is at least ``least`` has been checked exactly then, or its classes have been
   joined. So no link is lost but by an estimate or a bucket that misses it.

A class that fills blocks has blocks of its own, which are not compared with each other. A bucket is spread over tasks by its blocks, so no
task holds a bucket.

*Sketches.* Behind each print stands a sketch of the text's different shingles: for each of ``PARITIES`` places whether an odd number of them falls there, and how many there
are. A shingle that only one of two texts has changes one place at most, so places that differ are never more than such shingles: that bounds the likeness from above, for certain. Pairs that
cannot reach the threshold are neither estimated nor checked, and no link is lost by that.

Texts without a shingle are alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import discard, written
from .common import packed, settle, unpacked, unused
from .components import components
from .wordhash import Q, jaccard

#: Texts that are compared at a time, about.
TOGETHER = 512
#: Rounds that join representatives of classes before blocks meet.
MERGES = 2
#: Keys of texts to be checked that are broadcast at most, 16 MB in memory.
KEYS_SENT = 1 << 20
#: Rows that a task holds while it looks for the likeliest pairs.
ROWS_HELD = 1 << 19
#: Pairs that a class proposes in the first round of meeting blocks, and how many times as many in each later one.
FIRST, MORE = 8, 16

#: Places of a sketch, and its bytes with the number of shingles.
PARITIES = 1024
SKETCH = PARITIES // 8 + 8
#: Pairs that are estimated at a time.
ESTIMATED = 1 << 16

#: Prints as bytes along the last axis, of shapes that go together, to estimates.
Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]
_PROPOSED = "root long, pairs array<struct<estimate: float, a: bigint, b: bigint>>"


def key_of(text) -> F.Column:
    """A number for each text."""
    return F.xxhash64(text, F.sha2(text, 256))


@F.arrow_udf(T.DoubleType())
def exact_jaccard(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of packed texts."""
    pairs = zip(a.to_pylist(), b.to_pylist(), strict=True)
    return pa.array([jaccard(unpacked(x), unpacked(y)) for x, y in pairs], pa.float64())


def keyed_texts(docs: DataFrame, text: str) -> DataFrame:
    """(key, text) of each row; null counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(key_of(whole).alias("key"), whole.alias("text"))


def _rows(prints: pa.Array) -> np.ndarray:
    """Prints of one length as rows of bytes."""
    return np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(prints), -1)


def sketches(hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of the ``different`` shingles of texts, a row of ``SKETCH`` bytes for each text."""
    out = np.zeros((len(sizes), SKETCH // 8), "<u8")
    with np.errstate(over="ignore"):
        place = hashes * np.uint64(Q) >> np.uint64(64 - PARITIES.bit_length() + 1)
    np.bitwise_xor.at(out, (owner, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
    out[:, -1] = sizes
    return out.view(np.uint8)


def may_reach(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """For all pairs of rows of sketches, whether their texts may be as like as ``threshold``: never false where they are."""
    x, y = (np.ascontiguousarray(s).view("<u8") for s in (a, b))
    n, m = x[:, None, -1].astype(np.float64), y[None, :, -1].astype(np.float64)
    apart = np.zeros((len(x), len(y)), np.uint16)
    for k in range(PARITIES // 64):
        apart += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return np.maximum(apart, np.abs(n - m)) <= (n + m) * ((1 - threshold) / (1 + threshold) + 1e-9)


def reaching(alike: Alike, threshold: float) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """n and m prints with sketches behind them to an n x m table of estimates, -1 where the sketches rule the threshold out."""

    def table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = np.full((len(a), len(b)), -1, np.float32)
        i, j = np.nonzero(may_reach(a[:, -SKETCH:], b[:, -SKETCH:], threshold))
        for k in range(0, len(i), ESTIMATED):
            p, q = i[k : k + ESTIMATED], j[k : k + ESTIMATED]
            found[p, q] = alike(a[p, :-SKETCH], b[q, :-SKETCH])
        return found

    return table


def _blocks(batches):
    """Batches sorted by their first column to tables of one value of it each."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if rest and rest[-1].column(0)[-1].as_py() != int(block[start]):
                yield pa.Table.from_batches(rest).combine_chunks()
                rest = []
            rest.append(batch.slice(start, stop - start))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _below(alike: Alike, least: float):
    """Blocks (block, bucket, several, key, print) of representatives to rows of two kinds: (a, b, estimate), each with the likeliest one of a
    smaller key; and, with no estimate, (bucket, key) of those that have a likely partner or more blocks to meet."""

    def proposed(batches):
        for block in _blocks(batches):
            buckets, several, keys = (block.column(k).to_numpy() for k in (1, 2, 3))
            prints = _rows(block.column(4).combine_chunks())
            for at in range(0, len(keys), TOGETHER):
                mine = slice(at, at + TOGETHER)
                found = alike(prints[mine], prints)
                found[keys[mine, None] == keys[None, :]] = -1
                kept = (found >= least).any(axis=1) | several[mine]
                found[keys[mine, None] < keys[None, :]] = -1
                best = found.argmax(axis=1)
                estimate = found[np.arange(len(best)), best]
                good = estimate >= least
                a, b = np.concatenate([keys[mine][good], buckets[mine][kept]]), np.concatenate([keys[best[good]], keys[mine][kept]])
                given = pa.array(np.concatenate([estimate[good], np.zeros(kept.sum(), np.float32)]), pa.float32(), mask=np.arange(len(a)) >= good.sum())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), given], names=["a", "b", "estimate"])

    return proposed


def _best(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of columns (root, a, b, estimate) the k likeliest different pairs of each root, by root."""
    root, a, b, estimate = rows
    order = np.lexsort((b, a, -estimate, root))
    root, a, b, estimate = root[order], a[order], b[order], estimate[order]
    once = np.concatenate([[True], (root[1:] != root[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(root)]
    root, a, b, estimate = root[once], a[once], b[once], estimate[once]
    starts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])[: len(root)])
    rank = np.arange(len(root)) - np.repeat(starts, np.diff(np.append(starts, len(root))))
    return [x[rank < k] for x in (root, a, b, estimate)]


def _meeting(alike: Alike, least: float, k: int):
    """Pairs of blocks to the k likeliest pairs of keys of different classes, a row for the larger root of the two: once for all pairs of a task,
    but for what exceeds ``ROWS_HELD``."""

    def proposed(batches):
        held: list[list[np.ndarray]] = []

        def listed():
            root, a, b, estimate = _best([np.concatenate(c) for c in zip(*held, strict=True)], k)
            starts = np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1]])[: len(root)])
            pairs = pa.StructArray.from_arrays([pa.array(estimate, pa.float32()), pa.array(a), pa.array(b)], names=["estimate", "a", "b"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(root)), pa.int32()), pairs)
            return pa.RecordBatch.from_arrays([pa.array(root[starts]), lists], names=["root", "pairs"])

        n = 0
        for batch in batches:
            for row in range(batch.num_rows):
                sides = [[batch.column(c)[row].values for c in range(s, s + 3)] for s in (0, 3)]
                (keys, roots, prints), (others, classes, far) = [(x.to_numpy(), y.to_numpy(), _rows(z)) for x, y, z in sides]
                found = alike(prints, far)
                i, j = np.nonzero((found >= least) & (roots[:, None] != classes[None, :]))
                if not len(i):
                    continue
                a, b, estimate = keys[i], others[j], found[i, j].astype(np.float32)
                held.append(_best([np.maximum(roots[i], classes[j]), np.maximum(a, b), np.minimum(a, b), estimate], k))
                n += len(held[-1][0])
                if n > ROWS_HELD:
                    held[:] = [_best([np.concatenate(c) for c in zip(*held, strict=True)], k)]
                    n = len(held[0][0])
                    if n > ROWS_HELD // 2:
                        yield listed()
                        held.clear()
                        n = 0
        if held:
            yield listed()

    return proposed


def _from_representatives(ones: DataFrame, prints: DataFrame, alike: Alike, least: float) -> tuple[DataFrame, DataFrame]:
    """From (bucket, key), the smallest keys of classes: for each the likeliest smaller one; and (bucket, key) of those that may have a partner."""
    met = ones.join(ones.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")
    parts = F.ceil(F.col("n") / TOGETHER)
    block = F.xxhash64("bucket", F.pmod(F.xxhash64("key", "bucket"), parts))
    met = met.select(block.alias("block"), "bucket", (parts > 1).alias("several"), "key").join(prints, "key")
    ordered = met.select("block", "bucket", "several", "key", "print").repartition("block").sortWithinPartitions("block")
    found = settle(ordered.mapInArrow(_below(alike, least), "a long, b long, estimate float"), "found")
    best = found.where("estimate is not null").groupBy("a").agg(F.max_by("b", F.struct("estimate", "b")).alias("b"))
    return best.select("a", "b"), found.where("estimate is null").select(F.col("a").alias("bucket"), F.col("b").alias("key"))


def _from_blocks(labelled: DataFrame, prints: DataFrame, alike: Alike, least: float, k: int) -> tuple[DataFrame, bool]:
    """From (bucket, key, root): the k likeliest pairs of each class with those of a smaller root, and whether a class may have more."""
    sizes = labelled.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    large = F.col("n") >= TOGETHER
    whole = sizes.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum(F.when(~large, F.col("n"))).alias("others"))
    sizes = sizes.join(whole.where("classes > 1"), "bucket")
    parts = F.ceil(F.when(large, F.col("n")).otherwise(F.col("others")) / TOGETHER)
    sizes = sizes.select("bucket", "root", F.when(large, F.col("root")).alias("own"), parts.alias("parts"))
    part = F.pmod(F.xxhash64("key"), F.col("parts"))
    placed = labelled.join(sizes, ["bucket", "root"]).select("bucket", "own", part.alias("part"), "root", "key").join(prints, "key")
    blocks = placed.groupBy("bucket", "own", "part").agg(F.collect_list(F.struct("key", "root", "print")).alias("rows"))
    columns = (F.col(f"rows.{c}").alias(c) for c in ("key", "root", "print"))
    blocks = blocks.select("bucket", "own", F.xxhash64("own", "part").alias("block"), *columns)
    path = written(blocks, "blocks")
    blocks = labelled.sparkSession.read.schema(blocks.schema).parquet(path)
    x, y = blocks.alias("x"), blocks.alias("y")
    apart = F.coalesce(F.col("x.own") != F.col("y.own"), F.lit(True))
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.block") <= F.col("y.block")) & apart)
    sides = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "xy" for c in ("key", "root", "print")]
    found = pairs.select(*sides).mapInArrow(_meeting(alike, least, k), _PROPOSED)
    # a root has a row for each task at most, of k pairs at most
    best = found.groupBy("root").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("pairs"))), asc=False).alias("pairs"))
    best = settle(best.select(F.slice("pairs", 1, k).alias("pairs")), "best")
    discard(labelled.sparkSession, path)
    more = not best.where(F.size("pairs") >= k).isEmpty()
    return best.select(F.explode("pairs").alias("pair")).select("pair.a", "pair.b").distinct(), more


def _checked(near: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, int]:
    """(a, b, passed), whether the texts are exactly as like as ``threshold``, and how many pairs there are."""
    near = settle(near.repartition("a"), "near")  # narrow: a few files
    n = near.count()
    keys = near.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    few = texts.join(F.broadcast(keys) if 2 * n <= KEYS_SENT else keys, "key", "left_semi")  # else all texts are shuffled
    texts = few.select("key", packed("text").alias("raw")).groupBy("key").agg(F.any_value("raw").alias("raw"))
    sides = [texts.select(F.col("key").alias(x), F.col("raw").alias(f"raw_{x}")) for x in "ab"]
    both = near.join(sides[0], "a").join(sides[1], "b")
    made = both.select("a", "b", (exact_jaccard("raw_a", "raw_b") >= threshold).alias("passed"))
    return settle(made.repartition("a"), "checked"), n


def rooted(texts: DataFrame, members: DataFrame, prints: DataFrame, alike: Alike, least: float, threshold: float) -> DataFrame:
    """(key, root) of the texts that are linked to others, root being the smallest key of the class.

    ``texts`` as by ``keyed_texts``; ``members``: (bucket, key), each once; ``prints``: (key, print), each key once, with sketches behind them."""
    alike = reaching(alike, threshold)
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    labelled = settle(members.join(shared, "bucket").select("bucket", "key"), "shared")
    roots = tested = None
    step, more = 0, True
    while True:
        if step == 0:  # each text is a class
            near, shared = _from_representatives(labelled, prints, alike, least)
            if shared.isEmpty():  # no text has a likely partner
                return labelled.select("key", F.col("key").alias("root")).limit(0)
            prints = settle(prints.join(shared.select("key").distinct(), "key", "left_semi"), "few")
        elif step < MERGES:
            ones = settle(labelled.groupBy("bucket", "root").agg(F.min("key").alias("key")), "ones")
            near, _ = _from_representatives(ones, prints, alike, least)
        else:
            near, more = _from_blocks(labelled, prints, alike, least, FIRST * MORE ** (step - MERGES))
        if tested is not None:
            near = near.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        made, n = _checked(near, texts, threshold)
        passed = made.where("passed").count()
        tested = made if tested is None else tested.union(made)
        if passed:
            edges = made.where("passed").select("a", "b")
            if roots is not None:  # between the classes there were
                for side in "ab":
                    edges = edges.join(roots.select(F.col("key").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
                edges = edges.select(*(F.coalesce(f"root_{side}", side).alias(side) for side in "ab"))
            new = components(edges).select(F.col("node").alias("was"), F.col("root").alias("now"))
            if roots is None:
                roots = new.select(F.col("was").alias("key"), F.col("now").alias("root"))
            else:
                moved = roots.join(new, roots.root == new.was, "left").select("key", F.coalesce("now", "root").alias("root"))
                fresh = new.join(roots.select("key"), F.col("was") == F.col("key"), "left_anti")
                roots = moved.union(fresh.select(F.col("was").alias("key"), F.col("now").alias("root")))
            roots = settle(roots, "roots")
        if not more:
            return roots if roots is not None else labelled.select("key", "root").limit(0)
        if passed or step == 0:
            given = with_roots(shared, roots) if roots is not None else shared.withColumn("root", F.col("key"))
            labelled = settle(given.select("bucket", "key", "root"), "labelled")
        step = MERGES if step < MERGES and not passed else step + 1  # nothing to contract: no further such round


def with_roots(own: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with a ``key`` and their ``root``, the key itself where nothing is linked."""
    return own.join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))


def classes(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, and class_id, the smallest doc_id of its class (null if all are null)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), key_of(F.coalesce(F.col(text), F.lit(""))).alias("key"))
    rows = with_roots(own, found)
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("doc_id", "key", "class_id")


def keep_first(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest doc_id (null last), then of the smallest key of a text; of rows alike in
    both the one that is first as JSON. All columns are carried."""
    key, kept, n, root = unused(docs, "kept_key", "kept_id", "kept_rows", "kept_root")
    keyed = docs.withColumn(key, key_of(F.coalesce(F.col(text), F.lit(""))))
    rows = keyed.groupBy(F.col(key).alias("key"), F.col(doc_id).alias("id")).agg(F.count("*").alias("n"))
    first = F.struct(F.col("id").isNull(), "id", "key")
    best = with_roots(rows, found).groupBy("root").agg(F.min_by(F.struct("id", "key", "n"), first).alias("best"))
    best = best.select(F.col("best.key").alias(key), F.col("best.id").alias(kept), F.col("best.n").alias(n), F.col("root").alias(root))
    best = settle(best, "kept")
    hit = keyed.join(best, [key]).where(F.col(doc_id).eqNullSafe(F.col(kept)))
    once, more = hit.where(F.col(n) == 1).select(*docs.columns), hit.where(F.col(n) > 1)
    row = F.struct(*docs.columns)
    again = more.groupBy(root).agg(F.min_by(row, F.to_json(row)).alias(kept)).select(f"{kept}.*")
    return once.unionByName(again)
