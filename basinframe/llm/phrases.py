"""Phrase collocation mining by suffix-sigma.

Texts are split into pieces and words. Every word occurrence gives one suffix of its piece, cut after ``MOST_WORDS`` words. Suffixes are shuffled by language and first
word, sorted in reverse lexicographic order, and one stack per task counts all their prefixes, which are all phrases up to that length: a suffix
pops and emits what it doesn't extend, so a task holds a batch and one suffix. Parts are joined afterwards: every cut of a phrase gives the counts of its first part and of the
rest, and the score floor(1000000 * a * a / (l * r)); the lowest counts, of equal ones that with the shorter first part. A phrase goes if a longer candidate that contains it has
at least ``COVERED`` % of its count.

*Counts are whole.* Nothing is pruned before counting; only what is counted fewer than ``LEAST`` times is left out afterwards, and no part of a candidate can be
rarer than the candidate. Scores are computed in decimals of 38 digits: 10**6 * a * a fits for counts up to 10**14.

*Scale.* A task counts equal suffixes of ``HELD`` bytes of texts at a time, in numpy, before the one shuffle. The stack takes sorted keys batch by batch, in numpy too. A first word is spread over ``SALTS`` places
by its second word, which splits the count of a lone word only; those are summed afterwards. What meets in one place is two words with their different third ones. Sums over languages are partial per task. The best of each language are chosen in ``CHOSEN_IN`` parts first, so that no task sorts a language.

Words are lower-cased A to Z only, whatever the language. A null language is ``und``; a language named so is the same. Null texts are empty. Repeated rows count each. Texts of any length are cut
in chunks. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

MOST_WORDS = 3
LEAST = 10
COVERED = 50
BEST = 2000
#: Bytes of texts whose suffixes a task counts at a time.
HELD = 4 << 20
#: Places that a first word is spread over at most, of so many; a place is two bytes from 1 to 255.
SALTS = 64
_SPREAD = 40_503
_SIDE = 255
_SLOTS = _SIDE * _SIDE
CHOSEN_IN = 64
UNKNOWN = "und"

#: A-Z in lower case, every splitting character a line feed, tab a blank. Control characters that may be in words move to bytes that UTF-8 never uses, so that a zero byte can separate words.
_FORM = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\x0b\x0c\x0d\t" + bytes(range(9)), bytes(range(97, 123)) + b"\n" * 9 + b" " + bytes(range(0xF5, 0xFE))
)
_SAFE = bytes.maketrans(bytes(range(9)), bytes(range(0xF5, 0xFE)))
_BACK = bytes.maketrans(bytes(range(0xF5, 0xFE)), bytes(range(9)))
_END = b"\x00"
#: Bytes of keys as text again: a zero byte between words is a blank.
_TEXT = np.frombuffer(_BACK, np.uint8).copy()
_TEXT[0] = 32
_BETWEEN, _WORD = re.compile(rb"[ \t\n\x0b\x0c\r.,;:!?]"), re.compile(rb"[^ \t\n\x0b\x0c\r.,;:!?]+")
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(_BASES[1])
    return h ^ h >> np.uint64(32)


class Words:
    """The words of some texts of a language, each closed by a zero byte in ``flat``, with two 64-bit hashes each, and how many words of its piece a suffix has."""

    def __init__(self, texts: list[bytes], most: int):
        data = np.frombuffer(b"\n".join(texts).translate(_FORM), np.uint8)
        word = (data != 32) & (data != 10)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], word.view(np.int8), [0]])))
        starts, stops = edge[::2], edge[1::2]
        keep = word.copy()
        keep[stops[stops < len(data)]] = True  # what follows a word makes place for its zero byte
        flat = data[keep]
        ends = np.cumsum(stops - starts + 1)
        if len(ends) and ends[-1] > len(flat):
            flat = np.append(flat, np.uint8(0))
        flat[ends - 1] = 0
        self.flat, self.ends, self.begins = flat, ends, ends - (stops - starts + 1)
        piece = np.cumsum(data == 10)[starts] if len(starts) else starts
        n = np.ones(len(starts), np.int64)
        for k in range(1, most):
            n[:-k] += piece[k:] == piece[:-k]
        self.n = n
        self.starts, self.hashes = starts, []
        place = np.arange(len(flat)) - np.repeat(self.begins, ends - self.begins)
        for base in _BASES:  # a polynomial in the bytes of a word
            powers = np.full(int(place.max(initial=0)) + 1, base, np.uint64)
            powers[0] = 1
            terms = np.multiply.accumulate(powers)[place] * flat
            self.hashes.append(_mixed(np.add.reduceat(terms, self.begins)) if len(starts) else np.zeros(0, np.uint64))


def _suffixes(texts: list[bytes], lang: bytes, most: int, own: int | None = None) -> pa.RecordBatch:
    """(key, n) of the different suffixes of some texts, or of those that begin in the first ``own`` bytes. A key has two bytes that say where it is dealt to, by language, first word and a salt from the second, then the language
    and the words, each closed by a zero byte. Suffixes are told apart by 128 bits of hash."""
    w = Words(texts, most)
    whole = []
    for h, base in zip(w.hashes, _BASES, strict=True):
        out, p = h.copy(), 1
        for k in range(1, most):
            p = p * base % (1 << 64)
            out[:-k] += np.where(w.n[:-k] > k, h[k:] * np.uint64(p), np.uint64(0))
        whole.append(_mixed(out + w.n.astype(np.uint64))[: None if own is None else np.searchsorted(w.starts, own)])
    order = np.argsort(whole[0], kind="stable")
    first, second = whole[0][order], whole[1][order]
    start = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])[: len(order)])
    counts, one = np.diff(np.append(start, len(order))), order[start]
    salt = np.zeros(len(one), np.uint64)
    more = w.n[one] > 1
    salt[more] = w.hashes[1][one[more] + 1] % np.uint64(SALTS) * np.uint64(_SPREAD)
    slot = (w.hashes[0][one] % np.uint64(_SLOTS) + np.uint64(zlib.crc32(lang)) + salt) % np.uint64(_SLOTS)
    head = np.frombuffer(b"\x01\x01" + lang + _END, np.uint8)
    begin = w.begins[one]
    size = w.ends[one + w.n[one] - 1] - begin
    stops = np.cumsum(size + len(head))
    at = stops - size - len(head)
    data = np.empty(int(stops[-1]) if len(stops) else 0, np.uint8)
    for k, byte in enumerate(head):
        data[at + k] = byte
    data[at] += (slot // np.uint64(_SIDE)).astype(np.uint8)
    data[at + 1] += (slot % np.uint64(_SIDE)).astype(np.uint8)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    data[inner + np.repeat(at + len(head), size)] = w.flat[inner + np.repeat(begin, size)]
    return pa.RecordBatch.from_arrays([_binary(data, stops), pa.array(counts, pa.int64())], names=["key", "n"])


def _binary(data: np.ndarray, stops: np.ndarray, kind=pa.binary()) -> pa.Array:
    offsets = np.concatenate([[0], stops]).astype(np.int32)
    return pa.Array.from_buffers(kind, len(stops), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _parts(text: bytes, size: int, most: int) -> Iterator[tuple[bytes, int]]:
    """A long text in parts that end with a word, each with the ``most`` - 1 words behind it and how many bytes are its own."""
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, min(at + size, len(text)))
        stop = cut.start() if cut else len(text)
        behind = stop
        for _ in range(most - 1):
            word = _WORD.search(text, behind)
            behind = word.end() if word else len(text)
        yield text[at:behind], stop - at
        at = stop


def _counted(most: int, most_bytes: int = HELD):
    """(lang, text) to (key, n) of ``_suffixes``: texts are gathered by language up to so many bytes, and longer ones cut."""

    def counted(batches):
        held: dict[bytes, list[bytes]] = {}
        size = 0
        for batch in batches:
            langs, texts = (batch.column(c).cast(pa.binary()).to_pylist() for c in (0, 1))
            for lang, text in zip(langs, texts, strict=True):
                key = UNKNOWN.encode() if lang is None else lang.translate(_SAFE)
                if text and len(text) > most_bytes:
                    for part, own in _parts(text, most_bytes, most):
                        yield from sliced(_suffixes([part], key, most, own))
                elif text:
                    held.setdefault(key, []).append(text)
                    size += len(text) + 1
                if size > most_bytes:
                    yield from made(held)
                    size = 0
        yield from made(held)

    def made(held):
        for lang, texts in held.items():
            yield from sliced(_suffixes(texts, lang, most))
        held.clear()

    def sliced(out):
        return (out.slice(k, 1 << 16) for k in range(0, out.num_rows, 1 << 16))

    return counted


class Stack:
    """Counts of all prefixes of keys that come in reverse order, batch by batch. What is on the stack between batches is the last key: its own count and that of its first two, three ... words. Prefixes of
    no word (the language) and of one are given for each batch: they are parts of sums."""

    def __init__(self, least: int):
        self.least = least
        self.last: bytes | None = None
        self.carried: dict[int, int] = {}

    def push(self, keys: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        counts = {0: n, 1: n}
        if self.last is not None:
            keys = pa.concat_arrays([pa.array([self.last], pa.binary()), keys])
            n = np.concatenate([[0], n])
            counts = {0: n, 1: n}
        offsets = np.frombuffer(keys.buffers()[1], np.int32)[keys.offset : keys.offset + len(keys) + 1].astype(np.int64)
        data = np.frombuffer(keys.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begins, sizes = offsets[:-1], np.diff(offsets)
        # bytes that differ from those of the key before, at the same place
        back = np.repeat(np.concatenate([[0], sizes[:-1]]), sizes)
        same_place = np.arange(len(data)) - back
        differs = np.ones(len(data), bool)
        known = same_place >= 0
        differs[known] = data[known] != data[same_place[known]]
        total = np.concatenate([[0], np.cumsum(differs)])
        zeros = np.flatnonzero(data == 0)
        of = np.searchsorted(begins, zeros, side="right") - 1
        firsts = np.searchsorted(of, np.arange(len(keys)))
        words = np.bincount(of, minlength=len(keys)) - 1
        for level in range(int(words.max(initial=0)) + 1):
            has = np.flatnonzero(words >= level)
            if not len(has):
                continue
            end = zeros[firsts[has] + level] + 1
            # equal prefixes are neighbours, and keys between two of them would share the prefix: they have it too
            new = (total[end] - total[begins[has]] > 0) | np.concatenate([[True], np.diff(has) > 1])
            start = np.flatnonzero(new)
            own = counts.get(level, n)[has]
            if level > 1 and self.last is not None and has[0] == 0:
                own = own.copy()
                own[0] += self.carried.get(level, 0)
            sums = np.add.reduceat(own, start)
            where, stop = begins[has[start]], end[start]
            if level > 1:
                open_ = has[-1] == len(keys) - 1  # may go on in the next batch
                self.carried[level] = int(sums[-1]) if open_ else 0
                given = sums >= self.least
                if open_:
                    given[-1] = False
            else:
                given = sums > 0
            if given.any():
                yield self._spelt(data, where[given], stop[given], level, sums[given])
        for level in list(self.carried):
            if level > words[-1]:
                self.carried[level] = 0
        self.last = keys[-1].as_py()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.last is not None:
            data = np.frombuffer(self.last, np.uint8)
            zeros = np.flatnonzero(data == 0)
            for level in range(2, len(zeros)):
                n = self.carried.get(level, 0)
                if n >= self.least:
                    yield self._spelt(data, np.array([0]), zeros[level : level + 1] + 1, level, np.array([n]))

    def _spelt(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, level: int, sums: np.ndarray) -> pa.RecordBatch:
        """Prefixes as (lang, words, phrase, f)."""
        out = []
        zero = np.flatnonzero(data == 0)
        lang_end = zero[np.searchsorted(zero, begin)]
        for a, b in ((begin + 2, lang_end), (lang_end + 1, np.maximum(stop - 1, lang_end + 1))):
            size = b - a
            stops = np.cumsum(size)
            inner = np.arange(int(size.sum())) - np.repeat(stops - size, size)
            out.append(_binary(_TEXT[data[inner + np.repeat(a, size)]], stops, pa.string()))
        words = pa.array(np.full(len(sums), level, np.int32))
        return pa.RecordBatch.from_arrays([out[0], words, out[1], pa.array(sums, pa.int64())], names=["lang", "words", "phrase", "f"])


def _prefixes(least: int):
    """(key, n) in reverse order of keys to (lang, words, phrase, f) of ``Stack``."""

    def counted(batches):
        stack = Stack(least)
        for batch in batches:
            if batch.num_rows:
                yield from stack.push(batch.column(0).cast(pa.binary()), batch.column(1).to_numpy())
        yield from stack.close()

    return counted


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", most: int = MOST_WORDS, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f): how often each phrase of 1 to ``most`` words occurs, ``least`` times or more, words being how many it has; and with 0 words the
    count of all words of a language. A written table."""
    suffix = docs.select(lang, text).mapInArrow(_counted(most), "key binary, n long")
    dealt = suffix.repartition(F.substring("key", 1, 2)).sortWithinPartitions(F.desc("key"))
    found = settle(dealt.mapInArrow(_prefixes(least), "lang string, words int, phrase string, f long"), "prefixes")
    sums = found.where("words < 2").groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))
    whole = sums.where(f"words = 0 or f >= {least}").unionByName(found.where("words > 1"))
    return settle(whole, "phrases")


def _part(words: Column, first: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def scored(counts: DataFrame) -> DataFrame:
    """Of ``phrase_counts``: (lang, phrase, words, a, l, r, score) of all phrases of two words or more."""
    candidates = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    spelt = F.split("phrase", " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": _part(spelt, 1, F.col("k")), "right": _part(spelt, F.col("k") + 1, F.col("words") - F.col("k"))})
    parts = counts.where("words > 0").select("lang", "phrase", "f")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    a, left, right = (F.col(c).cast("decimal(14,0)") for c in ("a", "l", "r"))
    cuts = cuts.withColumns({"above": a * a * F.lit(1_000_000).cast("decimal(7,0)"), "below": left * right}).withColumn("score", F.expr("above div below"))
    best = F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("best")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def uncovered(found: DataFrame, most: int = MOST_WORDS, covered: int = COVERED) -> DataFrame:
    """Without the phrases that lie in a longer one which has ``covered`` % of their count or more."""
    spelt, inner = F.split("phrase", " "), None

    def starting(n: int):
        return lambda k: _part(spelt, k + 1, F.lit(n))

    for n in range(2, most):
        within = F.transform(F.sequence(F.lit(0), F.col("words") - n), starting(n))
        some = found.where(f"words > {n}").select("lang", F.explode(within).alias("phrase"), "a")
        inner = some if inner is None else inner.unionByName(some)
    if inner is None:
        return found
    longest = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True))
    return found.join(longest, ["lang", "phrase"], "left").where(kept).drop("longer")


def best_of(found: DataFrame, most: int = BEST) -> DataFrame:
    """The first ``most`` phrases of each language, with ``rank``."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(CHOSEN_IN))
    some = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    return some.where(F.col("rank") <= most).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", most_words: int = MOST_WORDS, least: int = LEAST, covered: int = COVERED, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score)."""
    counts = phrase_counts(docs, lang, text, most_words, least)
    chosen = best_of(uncovered(scored(counts), most_words, covered), best)
    total = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    made = chosen.join(total, "lang")
    return made.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language in all documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, doc, piece, row_number() OVER () AS id FROM (SELECT lang, doc, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
w AS (SELECT lang, id, unnest(l) AS w1, unnest(range(len(l))) AS pos FROM (SELECT *, regexp_extract_all(piece, '[^\x20\x09]+') AS l FROM p)),
o AS (SELECT lang, w1, lead(w1) OVER s AS w2, lead(w1, 2) OVER s AS w3 FROM w WINDOW s AS (PARTITION BY id ORDER BY pos)),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM o GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM o WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM o WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
b AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r, c.w1, c.w2 FROM f2 c
  JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2 WHERE c.f >= 10),
t AS (SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3 AS phrase, c.f AS a, 1 AS k, x.f AS l, y.f AS r FROM f3 c
  JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.f, 2, x.f, y.f FROM f3 c
  JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
g AS (SELECT lang, phrase, a, k, l, r FROM b WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = b.lang AND f3.w1 = b.w1 AND f3.w2 = b.w2 AND 100 * f3.f >= 50 * b.a)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = b.lang AND f3.w2 = b.w1 AND f3.w3 = b.w2 AND 100 * f3.f >= 50 * b.a) UNION ALL SELECT * FROM t),
s AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM g),
q AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM q)
SELECT z.lang, rank, phrase, a, l, r, n.n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
