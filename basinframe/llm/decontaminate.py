"""Benchmark decontamination by a generalised suffix automaton.

Words of test items and training texts are compared after A-Z is lower-cased. The items' word sequences build
one generalised suffix automaton; a text's words stream through it, and the state after each word holds the
length of the longest run ending there that occurs in some item. Where that length reaches the window, the
last ``window`` words are an item's window, and the state names its items. An item of fewer words is one window
of its own, kept on the state that spells it and found over suffix links.

Only stretches that can hold a window enter the automaton: each batch of texts is cut into words and hashed in
numpy, and a stretch is a run of positions whose k-gram hash some item has, k being at most the shortest window.
A window consists of such positions only, so none is missed; a chance hit of a hash costs time alone, as the
automaton reads the words themselves.

Items are sent to the tasks in blocks of a bounded size (``BLOCK_BYTES`` of text each, hashed apart); texts pass one block
after the other and results are merged, so a benchmark of any size is covered without a shuffle of the texts. After
every ``BLOCKS_IN_PLAN`` blocks the rows are written, so the driver holds a bounded part of a large benchmark.

Null and empty texts have no words: nothing is hit and they are not contaminated. Null items and items without
words have no windows. An item with a null id marks words but is not counted or named; items of one id count as
one. Repeated documents are judged alike. Without items nothing is hit. Further columns are carried unchanged.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, table, unused
from .wordhash import CHUNK, P, Q, word_hashes

WINDOW = 13
#: A text is contaminated if hit words are at least this share of its words.
COVERAGE = 1 / 20
#: Bytes of item text that one automaton is built of.
BLOCK_BYTES = 1 << 20
#: Blocks that one plan, and so the driver, holds; results are written after so many.
BLOCKS_IN_PLAN = 8
#: Longest k-gram that selects stretches.
GRAM = 8

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased UTF-8: the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]
_BYTE = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _BYTE[_b] = _b
for _b in range(0x41, 0x5B):
    _BYTE[_b] = _b + 32
_BITS = 22

SPAN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first_word", "last_word", "start", "stop")]))
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", SPAN),
    ]
)
CUT_RESULT = T.StructType([*RESULT.fields, T.StructField("text", T.StringType())])


class SuffixAutomaton:
    """Generalised over several word sequences; states are numbers, 0 is the root."""

    def __init__(self, window: int = WINDOW):
        self.window, self.next, self.link, self.length = window, [{}], [-1], [0]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word) -> int:
        """A copy of q for the strings that end in p's longest one and ``word``."""
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:  # an earlier item has it
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
            last = new

    def walk(self, words: list):
        """(state, length of the longest match) after each word."""
        v, n = 0, 0
        for word in words:
            while v and word not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            q = self.next[v].get(word)
            if q is None:
                n = 0
            else:
                v, n = q, n + 1
            yield v, n

    def holding(self, v: int, n: int) -> int:
        """The state of the suffix of n words of what v spells."""
        while self.length[self.link[v]] >= n:
            v = self.link[v]
        return v

    def finish(self, items: list[tuple[int, list]]) -> None:
        """Names on states: the items of each window, and items that are shorter than one."""
        self.windows: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        for number, words in items:
            w = min(self.window, len(words))
            for v, n in self.walk(words):
                if n >= self.window:
                    self.windows.setdefault(self.holding(v, self.window), set()).add(number)
            if w and w < self.window:
                self.short.setdefault(self.holding(v, w), {}).setdefault(w, set()).add(number)
        self.trimmed: dict[int, int] = {}

    def matches(self, words: list):
        """(position, window length, item numbers) of each window that ends at a position, then the longest match."""
        longest = 0
        for i, (v, n) in enumerate(self.walk(words)):
            longest = max(longest, n)
            if n >= self.window:
                if (u := self.trimmed.get(v)) is None:
                    u = self.trimmed[v] = self.holding(v, self.window)
                yield i, self.window, self.windows[u]
            if self.short:
                while v > 0:
                    for w, numbers in self.short.get(v, {}).items():
                        if w <= n:
                            yield i, w, numbers
                    v = self.link[v]
        yield -1, longest, ()


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Matcher:
    """One block of items: its automaton, and the hashes of its k-grams."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window = window
        spelt = [(name, words_of(text)) for name, text in items]
        self.names = [name for name, w in spelt if w]
        numbered = list(enumerate(w for _, w in spelt if w))
        self.automaton = SuffixAutomaton(window)
        for _, w in numbered:
            self.automaton.add(w)
        self.automaton.finish(numbered)
        self.gram = min([GRAM, window, *(len(w) for _, w in numbered)])
        found = [self._grams(word_hashes([b" ".join(w)], _BYTE)[0]) for _, w in numbered]
        self.known = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
        self.sieve = np.zeros(1 << _BITS, bool)
        self.sieve[self.known >> np.uint64(64 - _BITS)] = True

    def _grams(self, h: np.ndarray) -> np.ndarray:
        n = len(h) - self.gram + 1
        if n <= 0:
            return h[:0]
        out, p = np.zeros(n, np.uint64), 1
        for k in range(self.gram):
            out += h[k : k + n] * np.uint64(p)
            p = p * P % (1 << 64)
        out ^= out >> np.uint64(31)
        return out * np.uint64(Q)

    def scan(self, texts: list[bytes]):
        """For each text: its number of words, the longest match, {item names}, hit words, and those words' places."""
        raw = b"\n".join(texts)
        h, starts, stops, first = word_hashes(texts, _BYTE)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        grams = self._grams(h)
        seeds = np.flatnonzero(self.sieve[grams >> np.uint64(64 - _BITS)])
        seeds = seeds[np.isin(grams[seeds], self.known)] if len(self.known) else seeds[:0]
        owner = np.searchsorted(first, seeds, "right") - 1
        inside = seeds + self.gram <= first[owner + 1]
        seeds, owner = seeds[inside], owner[inside]
        out = [[int(first[k + 1] - first[k]), 0, set(), set()] for k in range(len(texts))]
        if len(seeds):
            breaks = np.flatnonzero((np.diff(seeds) != 1) | (np.diff(owner) != 0)) + 1
            lowered = raw.lower()
            for run, k in zip(np.split(seeds, breaks), owner[np.concatenate([[0], breaks])].tolist(), strict=True):
                at, end = int(run[0]), int(run[-1]) + self.gram
                spelt = [lowered[a:b] for a, b in zip(starts[at:end].tolist(), stops[at:end].tolist(), strict=True)]
                one = out[k]
                for i, w, numbers in self.automaton.matches(spelt):
                    if i < 0:
                        one[1] = max(one[1], w)
                        continue
                    one[2].update(name for x in numbers if (name := self.names[x]) is not None)
                    one[3].update(range(at + i - w + 1, at + i + 1))
        for k, one in enumerate(out):
            spans = []
            for i in sorted(one[3]):
                place = (i - int(first[k]), int(starts[i] - begin[k]), int(stops[i] - begin[k]))
                spans.append((place[0], place[0], place[1], place[2]))
            yield one[0], one[1], one[2], spans


def joined(words: list[tuple]) -> list[tuple]:
    """Neighbouring and overlapping (first word, last word, start, stop) as one span each."""
    out: list[list] = []
    for a, b, start, stop in sorted(words):
        if out and a <= out[-1][1] + 1:
            if b > out[-1][1]:
                out[-1][1], out[-1][3] = b, stop
        else:
            out.append([a, b, start, stop])
    return [tuple(x) for x in out]


_BUILT: dict[tuple, Matcher] = {}


def _matcher(key: str, items: list, window: int) -> Matcher:
    """The matcher of a block, built once in a Python worker."""
    if (key, window) not in _BUILT:
        if len(_BUILT) > 3:
            _BUILT.clear()
        _BUILT[key, window] = Matcher(items, window)
    return _BUILT[key, window]


def without(raw: bytes, spans: list[tuple]) -> str:
    """A UTF-8 text without its spans."""
    kept, at = [], 0
    for *_, start, stop in spans:
        kept.append(raw[at:start])
        at = stop
    return b"".join([*kept, raw[at:]]).decode()


def _scanner(items: list, window: int, cut: bool):
    """The function of one block; with ``cut`` it also returns the text of a hit row without all spans found so far."""
    key = hashlib.sha256(repr(items).encode()).hexdigest()

    @F.arrow_udf(CUT_RESULT if cut else RESULT)
    def scanned(texts: pa.Array, before: pa.Array) -> pa.Array:
        matcher, rows = _matcher(key, items, window), []
        batch, held = [], 0

        def flush():
            for raw, (n, longest, names, spans) in zip(batch, matcher.scan(batch), strict=True):
                old = before[len(rows)].as_py()
                if old:
                    names, spans = names | set(old["items"]), [*spans, *(tuple(s.values()) for s in old["spans"])]
                    longest = max(longest, old["longest"])
                spans = joined(spans)
                made = {"text": without(raw, spans) if spans else None} if cut else {}
                rows.append(
                    {
                        **made,
                        "n_words": n,
                        "n_hit": sum(s[1] - s[0] + 1 for s in spans),
                        "longest": longest,
                        "items": sorted(names),
                        "spans": [dict(zip(("first_word", "last_word", "start", "stop"), s, strict=True)) for s in spans],
                    }
                )

        for text in texts.cast(pa.binary()):
            text = text.as_py() or b""
            if batch and held + len(text) > CHUNK:
                flush()
                batch, held = [], 0
            batch.append(text)
            held += len(text) + 1
        if batch:
            flush()
        return pa.array(rows, pa.struct([(f.name, _ARROW[f.name]) for f in (CUT_RESULT if cut else RESULT)]))

    # else a filter on the result is moved below the step that made it, and texts are scanned twice
    return scanned.asNondeterministic()


_ARROW = {
    "text": pa.string(),
    "n_words": pa.int64(),
    "n_hit": pa.int64(),
    "longest": pa.int64(),
    "items": pa.list_(pa.string()),
    "spans": pa.list_(pa.struct([(n, pa.int64()) for n in ("first_word", "last_word", "start", "stop")])),
}


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int = BLOCK_BYTES):
    """(items as a list of (name, UTF-8 text), whether they are the last): lists of about ``block_bytes`` of text, fetched one
    at a time. A benchmark without items is one empty list."""
    own = items.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text")).where("text is not null").distinct()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k)
        yield [(r.name, r.text.encode()) for r in part.orderBy("name", "text").collect()], k == n - 1


def scan(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    into: str = "match",
    cut: bool = False,
) -> DataFrame:
    """``docs`` and a struct: n_words, n_hit, longest (match in words), items (names), spans (hit words, with their
    places in the UTF-8 text) and, with ``cut``, the text of a hit row without its spans."""
    now = docs.withColumn(into, F.lit(None).cast(RESULT))
    for k, (block, last) in enumerate(item_blocks(items, item_id, item_text, block_bytes), 1):
        now = now.withColumn(into, _scanner(block, window, cut and last)(F.col(text), F.col(into)))
        if k % BLOCKS_IN_PLAN == 0 and not last:
            now = settle(now, "scanned")  # the plan lets go of its blocks
    return now


def contaminated(match: str = "match", coverage: float = COVERAGE) -> F.Column:
    """Whether hit words reach the coverage limit. The limit is one part in a whole number of parts."""
    parts = round(1 / coverage)
    return (F.col(f"{match}.n_hit") > 0) & (F.col(f"{match}.n_hit") * parts >= F.col(f"{match}.n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **options) -> DataFrame:
    """``docs`` without contaminated rows, and without the hit spans of the others; a row whose text changes gets
    its new length in ``n_chars`` if there is such a column."""
    (into,) = unused(docs, "match")
    kept = scan(docs, items, text, into=into, cut=True, **options).where(~contaminated(into))
    hit = F.col(f"{into}.n_hit") > 0
    kept = kept.withColumn(text, F.when(hit, F.col(f"{into}.text")).otherwise(F.col(text)))
    if n_chars in docs.columns:
        kept = kept.withColumn(n_chars, F.when(hit, F.char_length(text).cast("long")).otherwise(F.col(n_chars)))
    return kept.select(*docs.columns)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("match.n_words").alias("n_words"),
        F.col("match.n_hit").alias("n_hit"),
        F.size("match.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("match.items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n,
    array_to_string(w[p : p + least(13, len(w)) - 1], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dp AS (
  SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p
  FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
dg AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS gram FROM dp),
h AS (SELECT r, p, dg.n, item_id FROM dg JOIN iw USING (gram) WHERE dg.n = iw.n),
hw AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
hi AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
