"""SimHash near duplicates by anchor-point covering.

A fingerprint has a bit set where over half of the 64-bit hashes of a text's word shingles have it. Two
fingerprints link if at most two bits differ.

*Anchors.* Bits 0-30 and 31-61 are two blocks. Of two linked fingerprints, at least one block differs in at
most one bit (three would be needed otherwise). In each block the 2**26 codewords of the Hamming [31, 26]
code are the anchors: its covering radius is 1, so a block value has an anchor within 1, and with a threshold
of 1 left for the block, every other block value within that threshold lies within 2 of that anchor. So each
distinct fingerprint is copied to the 16 anchors within distance 2 of each block (one, if the block is itself a
codeword: no other lies within 2), and every linked pair meets at an anchor. There whole fingerprints are
compared.

*Within an anchor* small buckets are compared pair by pair and large ones by shared midpoints: two values at
distance 2 or less share a value that is at most one flip from both, so sorting the 65 midpoints of each
member links exactly the right ones, in linear space. A bucket returns a star per linked group, never its pairs.
Stars meet in distributed connected components.

Copies share one fingerprint and are grouped before anything is replicated.

Null and empty texts, and texts of white space, have no shingle: their fingerprint is zero and links like any
other. A text of fewer words than a shingle is one shingle. Rows with a null doc_id link too; component_id is the
smallest non-null doc_id of a group, and null if it has none. Repeated rows are returned as often as they occur.
An empty table gives no rows. Other columns are ignored by ``near_duplicates``.

*Likeness of 0.8.* ``near_copies`` and ``keep_first`` link texts whose five-word shingles (a text of fewer words is one) have an exact Jaccard
likeness of ``LIKENESS``. At 0.8 some 15 % of the bits of two fingerprints differ, which no pair of blocks confines to a bit or two. So the
fingerprint has ``WIDE`` bits there, and ``BLOCKS`` blocks of ``GOLAYS`` * 23 of its bits. The anchors of a block are the products of codewords of
the binary Golay code, whose covering radius is 3. A bit weighs as much as it leads (by how many shingles the vote was won), since near
copies differ in bits that lead little: the distance of a block to an anchor is the sum of the leads of the bits in which they differ. A text
is copied to the two nearest anchors of each block, the codewords being sought within the covering radius of all values that differ
from the block's in some of the ``FLIPPED`` bits of the least lead. Texts that share an anchor are compared by whole fingerprints and linked
by ``linking``. That is a matter of chance: README has the measured share. 2**24 anchors a block suit some 10**9 texts; more take a third
code to a block, and more blocks. Texts without a shingle are alike; null counts as empty.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import linking
from .common import hex_of, settle, table
from .components import components
from .wordhash import by_size, different, shingles_of  # noqa: F401  (the tests take it from here)

SEED = 42
SHINGLE = 3
#: Differing bits up to which fingerprints link. The anchors are laid out for this value.
THRESHOLD = 2
#: Buckets up to this size are compared pair by pair, larger ones by midpoints; both give the same links.
PAIRWISE = 256
#: Bits of shingle hashes are summed for so many shingles at a time.
HASHES_AT_ONCE = 1 << 16

#: Jaccard likeness of five-word shingles at which ``near_copies`` links.
LIKENESS = 0.8
#: Pairs whose estimate is this much below go to the exact check: four standard deviations of an estimate.
SLACK = 0.12
WIDE = 1024
BLOCKS = 22
GOLAYS = 2
FLIPPED = 4
#: Shingles whose bits are spread out at a time, and bytes of texts that get wide fingerprints at a time.
SHINGLES_AT_ONCE = 1 << 10
TEXT_AT_ONCE = 1 << 16

_FLIPS = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])


def fingerprint_of(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned number."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    counts, n = np.zeros(64, np.int64), len(stops)
    for k in range(0, n, HASHES_AT_ONCE):
        part = zip(starts[k : k + HASHES_AT_ONCE], stops[k : k + HASHES_AT_ONCE], strict=True)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in part], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def _fingerprint(texts: pa.Array) -> pa.Array:
    made = [fingerprint_of(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
    return pa.array(np.array(made, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text: str = "text") -> F.Column:
    """A column of signed 64-bit fingerprints for ``docs``."""
    return _fingerprint(docs[text])


def anchors_of(block: np.ndarray) -> np.ndarray:
    """The codewords within 2 of each 31-bit block value, 16 to a row (repeated where there is one only)."""
    columns = np.arange(1, 32, dtype=np.uint64)
    syndrome = np.zeros(len(block), np.uint64)
    for i in range(31):
        syndrome ^= np.where((block >> np.uint64(i)) & np.uint64(1), columns[i], np.uint64(0))
    # errors[s]: the 16 patterns of weight 1 or 2 whose columns sum to s
    errors = np.zeros((32, 16), np.uint64)
    bit = lambda c: np.uint64(1) << np.uint64(c - 1)
    for s in range(1, 32):
        pairs = [bit(c) | bit(c ^ s) for c in range(1, 32) if c < c ^ s]
        errors[s] = [bit(s), *pairs]
    return block[:, None] ^ errors[syndrome.astype(np.int64)]


@F.arrow_udf(T.ArrayType(T.LongType()))
def _anchors(fps: pa.Array) -> pa.Array:
    x, low = fps.to_numpy(zero_copy_only=False).view(np.uint64), np.uint64((1 << 31) - 1)
    both = [anchors_of(x & low), anchors_of((x >> np.uint64(31)) & low) | np.uint64(1 << 31)]
    keys = np.sort(np.concatenate(both, axis=1).view(np.int64), axis=1)
    new = np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new.sum(axis=1))]), pa.int32()), pa.array(keys[new]))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index linked to each of n, for links a-b: labels are lowered and followed until they rest."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
        if np.array_equal(label, before):
            break
    return label


def links_by_pairs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= THRESHOLD, 1))
    return a, b


def links_by_midpoints(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains that join exactly the members that are linked: neighbours in each run of equal midpoints."""
    mids = (fps[:, None] ^ _FLIPS[None, :]).ravel()
    owner = np.repeat(np.arange(len(fps)), len(_FLIPS))
    order = np.argsort(mids, kind="stable")
    mids, owner = mids[order], owner[order]
    same = mids[1:] == mids[:-1]
    return owner[:-1][same], owner[1:][same]


def _stars(anchor: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by anchor, each anchor whole: (member, first member of its linked group)."""
    n = len(anchor)
    cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.append(cut, n))
    left, right = [], []
    small = np.repeat(sizes <= PAIRWISE, sizes)
    for k in range(1, int(min(sizes.max(initial=0), PAIRWISE))):  # all pairs k apart, over all small buckets at once
        i = np.flatnonzero((anchor[:-k] == anchor[k:]) & small[k:])
        if not len(i):
            break
        i = i[np.bitwise_count(fps[i] ^ fps[i + k]) <= THRESHOLD]
        left.append(i)
        right.append(i + k)
    for at, size in zip(cut[sizes > PAIRWISE], sizes[sizes > PAIRWISE], strict=True):
        a, b = links_by_midpoints(fps[at : at + size])
        left.append(a + at)
        right.append(b + at)
    if not left:
        return fps[:0], fps[:0]
    a, b = np.concatenate(left), np.concatenate(right)
    used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = _roots(len(used), where[: len(a)], where[len(a) :])
    member = root != np.arange(len(used))
    return fps[used[member]], fps[used[root[member]]]


def _compare(batches):
    """Batches sorted by anchor to star edges; the anchor that a batch ends in waits for the next batch."""
    rest: list[pa.RecordBatch] = []

    def stars(anchor, fp):
        a, b = _stars(anchor, fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column(0).to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1], "left"))
        if cut:
            whole = pa.Table.from_batches([*rest, batch.slice(0, cut)])
            yield stars(whole.column(0).to_numpy(), whole.column(1).to_numpy())
            rest = [batch.slice(cut)]
        elif rest and rest[-1].column(0)[-1].as_py() != int(anchor[0]):
            whole = pa.Table.from_batches(rest)
            yield stars(whole.column(0).to_numpy(), whole.column(1).to_numpy())
            rest = [batch]
        else:
            rest.append(batch)
    if rest:
        whole = pa.Table.from_batches(rest)
        yield stars(whole.column(0).to_numpy(), whole.column(1).to_numpy())


def links(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect exactly what is linked."""
    met = distinct.select(F.explode(_anchors(fp)).alias("anchor"), F.col(fp).alias("fp"))
    return met.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long) and component_id, the smallest doc_id reachable."""
    printed = settle(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(docs, text).alias("fp")), "fingerprints")
    groups = settle(printed.groupBy("fp").agg(F.min("doc_id").alias("first")), "groups")
    linked = components(links(groups)).select(F.col("node").alias("fp"), "root")
    rooted = groups.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return printed.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp")


def _golay_errors() -> np.ndarray:
    """The pattern of at most three of 23 bits that has each syndrome of the Golay code."""
    errors = np.zeros(1 << 11, np.uint32)
    for weight in range(1, 4):
        for places in combinations(range(23), weight):
            errors[np.bitwise_xor.reduce(_COLUMNS[list(places)])] = sum(1 << i for i in places)
    return errors


def _remainder(power: int) -> int:
    """Of x**power by the Golay code's generator x**11 + x**9 + x**7 + x**6 + x**5 + x + 1."""
    value = 1 << power
    for i in range(power, 10, -1):
        if value >> i & 1:
            value ^= 0b101011100011 << i - 11
    return value


def _tabled(columns: np.ndarray) -> np.ndarray:
    """The sum of the columns whose bits are set, for every value of as many bits."""
    out = np.zeros(1, np.uint16)
    for c in columns:
        out = np.concatenate([out, out ^ c])
    return out


_COLUMNS = np.array([_remainder(i) for i in range(23)], np.uint16)
_LOW, _HIGH = _tabled(_COLUMNS[:12]), _tabled(_COLUMNS[12:])
_ERRORS = _golay_errors()


def codewords(words: np.ndarray) -> np.ndarray:
    """The one codeword within three bits of each 23-bit value."""
    return words ^ _ERRORS[_LOW[words & 0xFFF] ^ _HIGH[words >> 12]]


_ORDERS = np.random.default_rng(8).permutation(WIDE)[: BLOCKS * GOLAYS * 23]
_MIXERS = np.random.default_rng(9).integers(0, 1 << 63, WIDE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """``WIDE`` bits of each hash, a byte to a bit."""
    x = hashes[:, None] * _MIXERS
    for shift in (32, 29):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return np.unpackbits((x ^ x >> np.uint64(32)).view(np.uint8), axis=1, bitorder="little")


def wide_leads(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``WIDE`` leads, above zero where the fingerprint has a bit, and how many different shingles each text has. A tie goes to the
    bit of the text's smallest shingle hash, with a lead of one half, rounded up; no lead is zero."""
    hashes, owner, sizes = different(texts)
    return _leads(hashes, owner, sizes), sizes


def _leads(hashes: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    totals = np.zeros((len(sizes), WIDE), np.int32)
    for k in range(0, len(hashes), SHINGLES_AT_ONCE):
        bits, own = _bits(hashes[k : k + SHINGLES_AT_ONCE]), owner[k : k + SHINGLES_AT_ONCE]
        at = np.arange(len(own))
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        since = at - np.repeat(starts, np.diff(np.append(starts, len(own))))
        cuts = np.flatnonzero(since % 255 == 0)  # sums of up to 255 bits fit a byte, and eight bytes are added at a time
        sums = np.add.reduceat(bits.view(np.uint64), cuts, axis=0).view(np.uint8)
        np.add.at(totals, own[cuts], sums)
    totals *= 2
    full = np.flatnonzero(sizes)
    if len(full):
        first = (np.cumsum(sizes) - sizes)[full]
        for k in range(0, len(full), SHINGLES_AT_ONCE):
            totals[full[k : k + SHINGLES_AT_ONCE]] += _bits(hashes[first[k : k + SHINGLES_AT_ONCE]])
    return 2 * (totals - sizes[:, None]) - 1


def anchors_of_blocks(leads: np.ndarray) -> np.ndarray:
    """The two nearest anchors of each block of each fingerprint; the same twice, where no second codeword is in reach."""
    leads = leads[:, _ORDERS].reshape(-1, 23)
    words = ((leads > 0).astype(np.uint32) << np.arange(23, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    weights = np.abs(leads).astype(np.float32)
    least = np.uint32(1) << np.argsort(weights, axis=1, kind="stable")[:, :FLIPPED].astype(np.uint32)
    tried = words[:, None]
    for k in range(FLIPPED):
        tried = np.concatenate([tried, tried ^ least[:, k, None]], axis=1)
    tried = codewords(tried)
    off, distance = tried ^ words[:, None], np.zeros(tried.shape, np.float32)
    for k in range(23):
        distance += (off >> np.uint32(k) & np.uint32(1)) * weights[:, k, None]
    distance += tried * np.float32(2.0**-26)  # ties go to the smaller codeword
    rows = np.arange(len(words))
    best = tried[rows, distance.argmin(axis=1)]
    others = np.where(tried == best[:, None], np.float32(np.inf), distance)
    at = others.argmin(axis=1)
    gap = others[rows, at] - distance.min(axis=1)
    second = np.where(np.isinf(gap), best, tried[rows, at]).reshape(-1, BLOCKS, GOLAYS)
    best, change = best.reshape(second.shape), gap.reshape(second.shape).argmin(axis=2)
    other = np.where(np.arange(GOLAYS) == change[..., None], second, best)
    key = np.arange(BLOCKS, dtype=np.uint64)[None, :, None] * np.uint64(0x9E3779B97F4A7C15)
    both = np.stack([best, other], axis=2).astype(np.uint64)
    for w in range(GOLAYS):
        key = (key ^ both[..., w]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(31)
    return key.view(np.int64).reshape(len(key), 2 * BLOCKS)


_WIDE = T.StructType([T.StructField("print", T.BinaryType()), T.StructField("anchors", T.ArrayType(T.LongType()))])


@F.arrow_udf(_WIDE)
def _widely(texts: pa.Array) -> pa.Array:
    """The fingerprint of a text with the number of shingles and the sketch behind it, and its anchors."""
    prints, anchors = [], [np.zeros(0, np.int64)]
    for part in by_size(texts.cast(pa.binary()).to_pylist(), TEXT_AT_ONCE):
        hashes, owner, sizes = different(part)
        leads = _leads(hashes, owner, sizes)
        bits = np.packbits(leads > 0, axis=1, bitorder="little")
        behind = linking.sketches(hashes, owner, sizes)
        prints += [r.tobytes() for r in np.concatenate([bits, sizes.astype("<u8").view(np.uint8).reshape(-1, 8), behind], axis=1)]
        anchors.append(anchors_of_blocks(leads).ravel())
    ends = pa.array(np.arange(len(prints) + 1) * 2 * BLOCKS, pa.int32())
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(anchors)))
    return pa.StructArray.from_arrays([pa.array(prints, pa.binary()), lists], names=["print", "anchors"])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likenesses of prints: the share of differing bits tells the angle between shingle sets, and their sizes the rest."""
    x, y = (np.ascontiguousarray(p).view("<u8") for p in (a, b))
    apart = np.zeros(np.broadcast_shapes(x.shape[:-1], y.shape[:-1]), np.uint16)
    for k in range(WIDE // 64):
        apart += np.bitwise_count(x[..., k] ^ y[..., k])
    n, m = x[..., -1].astype(np.float32), y[..., -1].astype(np.float32)
    both = np.cos(apart.astype(np.float32) * np.float32(np.pi / WIDE)) * np.sqrt(n * m)
    union = np.maximum(n + m - both, np.float32(1e-6))
    return np.where((n == 0) & (m == 0), np.float32(1), both / union)


def _classes(docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """(key, root) of the texts of ``docs`` that have a near copy."""
    texts = linking.keyed_texts(docs, text)
    wide = texts.select("key", _widely("text").alias("wide")).groupBy("key").agg(F.any_value("wide").alias("wide"))
    made = settle(wide, "prints")
    members = made.select(F.explode(F.array_distinct("wide.anchors")).alias("bucket"), "key")
    return linking.rooted(texts, members, made.select("key", "wide.print"), likeness, threshold - SLACK, threshold)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = LIKENESS) -> DataFrame:
    """One row per row of ``docs``: doc_id, the key of its text, and class_id, the smallest doc_id of its class (null if all are null)."""
    return linking.classes(docs, _classes(docs, text, threshold), doc_id, text)


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = LIKENESS) -> DataFrame:
    """``docs`` with one row of each class, as ``linking.keep_first`` chooses it. All columns are carried."""
    return linking.keep_first(docs, _classes(docs, text, threshold), doc_id, text)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")
