"""Merkle manifest of a dataset: trees over indexed leaves, built by mountain-range stacks.

Leaves of a tree have a gapless index. While a level has several nodes, every ``fanout`` consecutive ones become one (the last run has fewer, even one, and
no padding): a node is the SHA-256 of its children's hexadecimal digests. With the number of leaves known, so is the width of every level, and a stack can
tell a short last run from one that goes on elsewhere.

*Peaks.* Leaves are dealt into ranges of (tree, order), wherever their edges fall. A task streams its leaves through a stack of one run for each level: a
complete run carries a node to the level above, up to ``LEVELS`` levels, so memory is bounded whatever a range holds. Runs that a range's edges cut are
emitted as they are; these peaks, some for each range and one for each ``fanout ** LEVELS`` leaves, are what goes on.

*Merging.* Peaks are grouped by aligned spans of ``fanout ** (LEVELS * round)`` leaves and pushed through the same stack, which mends the unaligned edges; a span
gives one node and, for each peak, the siblings on its way up. Rounds end when one span holds the longest tree: three for 10**11 leaves. The roots of trees
are the leaves of one more tree, by the same code.

*Proofs.* Siblings above a peak are the same for all leaves below it: they come down by joins of peaks with spans, not by leaf. The ranges are then read once more, each peak
ahead of its leaves, and a task adds the siblings below the peak.

``tampered`` leaves are folded with the original siblings: the root they give differs.

A null tree key is a tree of its own, ordered before all others. Leaves are ordered by (order, digest), nulls last; rows alike in both are interchangeable. A tree of
one leaf is that leaf. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import ranged
from .common import settle, table

FANOUT = 2
#: Levels that a stack carries before a node is handed on: 4,096 leaves of a binary tree.
LEVELS = 12
#: Rows of an Arrow batch that a task gives back.
ROWS = 2048

_NODE = "tree string, range_no int, level int, idx long, digest string"


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def widths(n: int, fanout: int) -> list[int]:
    """Nodes of each level of a tree of n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fanout))
    return out


class Stack:
    """A mountain range: nodes are pushed in the order of their first leaves, complete runs become their parents. ``out`` gets (level, idx, digest, members) of what can't
    be completed below ``top``; ``made`` gets (level, idx, digest, children) of every node that is built here, if it is given."""

    def __init__(self, n: int, fanout: int, top: int, out, made=None):
        self.widths, self.fanout, self.top = widths(n, fanout), fanout, top
        self.out, self.made = out, made
        self.runs: dict[int, list[tuple]] = {}

    def push(self, level: int, idx: int, value: str) -> None:
        while level < self.top and level < len(self.widths) - 1:
            run = self.runs.setdefault(level, [])
            if run and run[-1][1] + 1 != idx:
                self._leave(level)
                run = self.runs.setdefault(level, [])
            run.append((level, idx, value))
            if idx % self.fanout != self.fanout - 1 and idx != self.widths[level] - 1:
                return
            if run[0][1] % self.fanout:  # its first members are elsewhere
                self._leave(level)
                return
            value = digest("".join(x[2] for x in run))
            del self.runs[level]
            level, idx = level + 1, idx // self.fanout
            if self.made:
                self.made(level, idx, value, run)
        self.out(level, idx, value)

    def _leave(self, level: int) -> None:
        for node in self.runs.pop(level, ()):
            self.out(*node)

    def close(self) -> None:
        for level in sorted(self.runs):
            self._leave(level)


def _streams(batches):
    """Rows (tree, range_no, n, ...) sorted by tree and range, as (key, rows) of one tree in one range each; rows come in the order of the stream."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if rows:
                    yield key, rows
                key, rows = row[:3], []
            rows.append(row[3:])
            if len(rows) == ROWS:
                yield key, rows
                rows = []
    if rows:
        yield key, rows


def _peaks(fanout: int, levels: int, records: bool):
    """(tree, range_no, n, idx, digest) to the nodes that a range can't carry further; with ``records`` to every node it builds and its leaves, instead."""

    def made(batches):
        found: list[tuple] = []
        stack, at = None, None
        for key, rows in _streams(batches):
            if key != at:
                if stack:
                    stack.close()

                def keep(level, idx, value, *_, of=key[:2]):
                    found.append((*of, level, idx, value))

                stack, at = Stack(key[2], fanout, levels, (lambda *_: None) if records else keep, keep if records else None), key
            for idx, value in rows:
                if records:
                    keep(0, idx, value)
                stack.push(0, idx, value)
            if len(found) >= ROWS:
                yield _batch(found, _NODE)
                found.clear()
        if stack:
            stack.close()
        if found:
            yield _batch(found, _NODE)

    return made


_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in named]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, named, strict=True)], names=[n for n, _ in named])


_MERGED = "tree string, range_no int, level int, idx long, digest string, span long, path string"


def _merge(fanout: int, top: int):
    """Nodes (tree, range_no, span, n, first, level, idx, digest) of one span, to its one node (path null) and to the nodes with the siblings on their way up to it."""

    def merged(group: pa.Table) -> pa.Table:
        group = group.sort_by("first")
        tree, span, n = (group.column(c)[0].as_py() for c in ("tree", "span", "n"))
        above: dict[tuple[int, int], tuple[int, int, str]] = {}
        tops: list[tuple] = []

        def made(level, idx, _, run):
            for k, (low, i, _) in enumerate(run):
                sides = ["".join(x[2] for x in part) for part in (run[:k], run[k + 1 :])]
                above[low, i] = (level, idx, "*".join(sides) + "/")

        stack = Stack(n, fanout, top, lambda *node: tops.append(node), made)
        nodes = list(zip(*(group.column(c).to_pylist() for c in ("range_no", "level", "idx", "digest")), strict=True))
        for _, *node in nodes:
            stack.push(*node)
        stack.close()
        rows = [(tree, None, *node, span, None) for node in tops]
        paths: dict[tuple[int, int], str] = {}

        def path(level: int, idx: int) -> str:
            if (level, idx) not in above:
                return ""
            if (level, idx) not in paths:
                up, i, own = above[level, idx]
                paths[level, idx] = own + path(up, i)
            return paths[level, idx]

        rows += [(tree, part, level, idx, value, span, path(level, idx)) for part, level, idx, value in nodes]
        return pa.Table.from_batches([_batch(rows, _MERGED)])

    return merged


def _leaves_below(level: str, fanout: int) -> Column:
    return F.expr(f"bigint(round(pow({fanout}, {level})))")


def forest(leaves: DataFrame, sizes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Leaves (tree, range_no, idx, digest) and sizes (tree, n) to the trees (tree, n, root) and the peaks (tree, range_no, n, level, idx, path), path being the siblings from
    a peak to the root: for each level those to the left, an asterisk, those to the right and a slash."""
    known = leaves.join(sizes, "tree").select("tree", "range_no", "n", "idx", "digest")
    dealt = known.repartition("tree", "range_no").sortWithinPartitions("tree", "range_no", "idx")
    now = settle(dealt.mapInArrow(_peaks(fanout, levels, False), _NODE), "peaks")
    longest = sizes.agg(F.max("n")).first()[0] or 0
    rounds, top = [], levels
    while True:
        top += levels
        first = F.col("idx") * _leaves_below("level", fanout)
        begun = now.join(sizes, "tree").withColumn("first", first).withColumn("span", F.floor(F.col("first") / fanout**top).cast("long"))
        out = settle(begun.groupBy("tree", "span").applyInArrow(_merge(fanout, top), _MERGED), "merged")
        rounds.append((top, out.where("path is not null")))
        now = out.where("path is null").drop("span", "path")
        if fanout**top >= longest:
            break
    paths = None
    for top, nodes in reversed(rounds):
        if paths is not None:  # the siblings above a span, for the nodes in it
            span = F.floor(F.col("idx") * _leaves_below("level", fanout) / fanout**top).cast("long")
            nodes = nodes.join(paths.select("tree", span.alias("span"), F.col("path").alias("up")), ["tree", "span"]).withColumn("path", F.concat("path", "up"))
        paths = nodes
    return now.join(sizes, "tree").select("tree", "n", F.col("digest").alias("root")), paths.join(sizes, "tree").select("tree", "range_no", "n", "level", "idx", "path")


def node_records(leaves: DataFrame, sizes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """All leaves and nodes up to ``levels`` that lie whole in a range, (tree, range_no, level, idx, digest): what a manifest keeps to recompute little after a change."""
    known = leaves.join(sizes, "tree").select("tree", "range_no", "n", "idx", "digest")
    dealt = known.repartition("tree", "range_no").sortWithinPartitions("tree", "range_no", "idx")
    return dealt.mapInArrow(_peaks(fanout, levels, True), _NODE)


def fold(value: str, path: str) -> str:
    """The root that a digest gives with siblings."""
    for part in path.split("/")[:-1]:
        left, right = part.split("*")
        value = digest(left + value + right)
    return value


def _paths_below(leaves: list[str], level: int, fanout: int) -> list[str]:
    """Siblings of each leaf on its way to the peak that they have at a level."""
    rows = [leaves]
    for _ in range(level):
        last = rows[-1]
        rows.append([digest("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    paths = [""]
    for line in rows[-2::-1]:
        runs = [i - i % fanout for i in range(len(line))]
        paths = ["".join(line[r:i]) + "*" + "".join(line[i + 1 : r + fanout]) + "/" + paths[i // fanout] for i, r in enumerate(runs)]
    return paths


_STREAM = ("tree", "range_no", "n", "idx", "kind", "level", "path", "subroot", "root", "digest", "tampered", "name", "id")
_LISTED = "name string, digest string, path string"
_PROVED = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _listed(head: tuple, leaf: tuple, path: str) -> tuple:
    return leaf[2], leaf[0], path


def _proved(head: tuple, leaf: tuple, path: str) -> tuple:
    (subroot, root), (value, tampered, _, own) = head, leaf
    folded = fold(tampered or value, path)
    return own, value, subroot, root, digest(path.replace("*", "").replace("/", "")), folded, folded == root


def _climb(fanout: int, spell, schema: str):
    """A stream of ``_STREAM`` rows, each peak (kind 0) ahead of its leaves (kind 1), to what ``spell`` makes of the peak, the leaf and the siblings up to the root."""

    def climbed(batches):
        peak, leaves, found = None, [], []

        def finish():
            if not leaves:
                return
            level, idx, n, path, *head = peak
            if len(leaves) != min(fanout**level, n - idx):
                raise ValueError("a peak without all of its leaves")
            for leaf, near in zip(leaves, _paths_below([x[0] for x in leaves], level, fanout), strict=True):
                found.append(spell(tuple(head), leaf, near + path))
            leaves.clear()

        for (_, _, n), rows in _streams(batches):
            for idx, kind, level, path, subroot, root, *leaf in rows:
                if kind == 0:
                    finish()
                    peak = (level, idx, n, path, subroot, root)
                else:
                    leaves.append(tuple(leaf))
            while len(found) >= ROWS:
                yield _batch(found[:ROWS], schema)
                del found[:ROWS]
        finish()
        for at in range(0, len(found), ROWS):
            yield _batch(found[at : at + ROWS], schema)

    return climbed


def _climbed(leaves: DataFrame, heads: DataFrame, fanout: int, spell, schema: str) -> DataFrame:
    """Leaves (tree, range_no, n, idx, digest, ...) and peaks (tree, range_no, n, level, idx, path, ...) through ``_climb``."""
    kinds = {c: ("string" if c not in ("level", "kind", "id") else "long" if c == "id" else "int") for c in _STREAM}

    def spelt(rows: DataFrame, kind: int) -> DataFrame:
        have = {**{c: F.col(c) for c in rows.columns}, "kind": F.lit(kind)}
        return rows.select(*(have[c].alias(c) if c in have else F.lit(None).cast(kinds[c]).alias(c) for c in _STREAM))

    peaks = heads.withColumn("idx", F.col("idx") * _leaves_below("level", fanout))
    stream = spelt(peaks, 0).unionByName(spelt(leaves, 1)).repartition("tree", "range_no")
    return stream.sortWithinPartitions("tree", "range_no", "idx", "kind").mapInArrow(_climb(fanout, spell, schema), schema)


def indexed(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tree, ...) dealt into ranges, with a gapless ``idx`` in each tree by ``order``, and (tree, n)."""
    dealt = ranged(leaves, ["tree"], order)
    sizes = settle(dealt.rows.groupBy("tree").agg(F.count("*").alias("n")), "sizes")
    rows = dealt.numbered("idx").withColumn("idx", F.col("idx").cast("long")).drop("range_salt")
    return settle(rows.join(sizes, "tree"), "indexed"), sizes


def manifest(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(tree, id, leaf, tampered) to (id, leaf, subroot, root, proof_sha256, folded_root, verified): the root of the leaf's tree and of all trees, the digest of the
    siblings up to the latter, and the root that the tampered leaf (null: the leaf) gives with them."""
    key = F.coalesce(F.concat(F.lit("="), "tree"), F.lit(""))  # null first
    rows, sizes = indexed(leaves.select(key.alias("tree"), "id", F.col("leaf").alias("digest"), "tampered"), ["id", "digest"])
    trees, peaks = forest(rows.drop("n"), sizes, fanout, levels)
    trees = settle(trees, "trees")
    tops, count = indexed(trees.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest")), ["name"])
    whole, above = forest(tops.drop("n"), count, fanout, levels)
    high = _climbed(tops, above, fanout, _listed, _LISTED)
    root = whole.select(F.col("root"))  # one row
    high = settle(high.select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), F.col("path").alias("high")).join(F.broadcast(root)), "high")
    heads = peaks.join(high, "tree").withColumn("path", F.concat("path", "high")).drop("high")
    return _climbed(rows, heads, fanout, _proved, _PROVED)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def record_digest(*values: Column) -> Column:
    """SHA-256 of the values: each with its length in bytes, null as a dash."""
    return F.sha2(F.concat(*(_field(v) for v in values)), 256)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and the root that a tampered one gives."""
    docs = table(spark, sf_dir, "documents")
    one = F.lit(1).cast("decimal(20,0)")
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = [F.col("n_chars").cast("decimal(20,0)") + one if k == 3 else f for k, f in enumerate(fields)]
    leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), record_digest(*fields).alias("leaf"), F.when(hit, record_digest(*changed)).alias("tampered"))
    return manifest(leaves).withColumnRenamed("id", "doc_id")


#: CRC-32 goes byte by byte over a table that the query builds from the polynomial; levels, siblings and folds are recursions over whole levels.
ORACLE = """
WITH RECURSIVE c AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda v, n: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) r(i))),
d AS (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(hex(encode(CAST(doc_id AS VARCHAR)))) // 2),
      lambda i: CAST('0x' || substr(hex(encode(CAST(doc_id AS VARCHAR))), 2 * i + 1, 2) AS BIGINT))),
      lambda a, b: xor(a >> 8, tab[1 + (xor(a, b) & 255)])), 4294967295) % 7 = 0 AND n_chars IS NOT NULL AS hit FROM documents, c),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN hit THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS tampered FROM d),
i AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS idx FROM l),
n AS (SELECT lang, 0 AS level, idx, leaf AS h FROM i UNION ALL
  SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS w FROM n)
  WHERE w > 1 GROUP BY lang, level, idx // 2),
s AS (SELECT lang, arg_max(h, level) AS subroot, max(level) AS height FROM n GROUP BY lang),
o AS (SELECT *, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM s),
m AS (SELECT 0 AS level, pos AS idx, subroot AS h FROM o UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM (SELECT *, count(*) OVER () AS w FROM m) WHERE w > 1 GROUP BY level, idx // 2),
r AS (SELECT arg_max(h, level) AS root, max(level) AS top FROM m),
p AS (SELECT i.*, subroot, height, pos, root, top, row_number() OVER () AS id FROM i JOIN o ON i.lang IS NOT DISTINCT FROM o.lang, r),
a AS (SELECT p.id, n.level, xor(p.idx >> n.level, 1) AS sibling, n.h FROM p JOIN n ON n.lang IS NOT DISTINCT FROM p.lang AND n.idx = xor(p.idx >> n.level, 1) AND n.level < p.height
  UNION ALL SELECT p.id, p.height + m.level, xor(p.pos >> m.level, 1), m.h FROM p JOIN m ON m.idx = xor(p.pos >> m.level, 1) AND m.level < p.top),
q AS (SELECT id, sha256(string_agg(h, '' ORDER BY level)) AS proof FROM a GROUP BY id),
f AS (SELECT id, 0 AS level, coalesce(tampered, leaf) AS h, height + top AS ends FROM p UNION ALL
  SELECT f.id, f.level + 1, sha256(CASE WHEN a.h IS NULL THEN f.h WHEN a.sibling & 1 = 1 THEN f.h || a.h ELSE a.h || f.h END), f.ends
  FROM f LEFT JOIN a ON a.id = f.id AND a.level = f.level WHERE f.level < f.ends)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM p JOIN f ON f.id = p.id AND f.level = f.ends LEFT JOIN q ON q.id = p.id
"""
