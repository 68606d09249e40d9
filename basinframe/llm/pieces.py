"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The automaton reads a text once. At each position it gives, over its output links, every piece that ends there, longest
first, and each is tried as the last step of the best path to that position.

``relaxed`` is that Viterbi by scores, for any model: the sum of the scores of the best path, and how many pieces it has.

* ``unigram`` models: a path's value is the sum of its pieces' scores; an unknown character costs 10 more than the worst piece.
* ``bpe`` models: scores are merge ranks, and the sum of ranks is not what such a model means. A sequence of pieces
  is the result of the merges exactly if each piece, and each two neighbours, are the result for their own text; so a step
  is allowed if the piece and the one before it are such a pair, and exactly one step per position is. This gives the ids of the
  reference encoder. Pairs are judged once by merging their few characters. Pieces of spaces only, which tie in score,
  are taken from left to right, the longest first. The best sum of scores over the same pieces stands beside the ids.

The text is prefixed by one space and spaces become U+2581, as the model's normaliser says (identity otherwise). Characters that no
piece has become the bytes of their UTF-8 form, so decoding gives back every text exactly. That holds for a U+2581 in
a text too: it is spelt in bytes, where the reference encoder would take it for a space.

Since no piece has a space after another character, a text falls into words, each with the spaces before it, and at line
feeds if no piece has one; a last character that no piece joins to the one before it is added to the rest. Words are
encoded once and kept in a bounded table per Python worker, which forgets those not met for long. Texts of any length are encoded whole.

Null texts have null ids and decode to null; the empty text has no ids. Repeated rows are encoded alike; other
columns are carried.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, unused

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words and pairs that a worker remembers; beyond that it starts anew.
WORDS_KEPT = 300_000
PAIRS_KEPT = 600_000
LONGEST_KEPT = 48
SPACE = "▁"
#: Stands for a U+2581 of the text; a lone surrogate is in no UTF-8 text.
_LITERAL = "\ud800"
_LEAST = float("-inf")
_RUNS = re.compile(f"({SPACE}*)([^{SPACE}]*)")


class Kept:
    """A bounded table in two halves: once the new half is full, what was not met since the last time is forgotten."""

    def __init__(self):
        self.new: dict = {}
        self.old: dict = {}

    def find(self, key: str):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value) -> None:
        if len(self.new) >= max(1, WORDS_KEPT // 2):
            self.new, self.old = {}, self.new
        self.new[key] = value


class Pieces:
    """A model's pieces: built once per worker from plain values."""

    def __init__(self, kind: str, pieces: list[tuple[int, str, float]], bytes_from: int | None, unknown: int):
        self.kind, self.bytes_from, self.unknown = kind, bytes_from, unknown
        self.score = {text: score for _, text, score in pieces}
        self.number = {text: n for n, text, _ in pieces}
        self.text = {n: text for n, text, _ in pieces}
        self.sizes = {n: len(text) for n, text, _ in pieces}
        self.scores = {n: score for n, _, score in pieces}
        self.worst = min(self.score.values(), default=0.0) - 10
        #: of a piece, by the piece before (-1: none), whether it may follow
        self.after: dict[int, dict[int, bool]] = {n: {} for n in self.text}
        self.automaton = ahocorasick.Automaton()
        for n, text, _ in pieces:
            if not (kind == "bpe" and len(text) > 1 and not text.strip(SPACE)):
                self.automaton.add_word(text, (n, len(text), self.scores[n], self.after[n]))
        self.automaton.make_automaton()
        self.runs = sorted((len(text) for _, text, _ in pieces if not text.strip(SPACE)), reverse=True)
        #: whether words can be encoded apart
        self.apart = not any(SPACE in text.lstrip(SPACE) for _, text, _ in pieces)
        self.judged = 0
        #: of a word as _cut gives it, the ids, and the best sum of scores with, as the imaginary part, the pieces of that path
        self.words, self.sums = Kept(), Kept()
        #: both of these, for words that were read for both
        self.told = Kept()
        #: neighbours within a piece; no path and no merge leads over others
        self.joined = {text[k : k + 2] for _, text, _ in pieces for k in range(len(text) - 1)}
        self.ends = {text: (array("i", [n]).tobytes(), complex(score, 1)) for n, text, score in pieces if len(text) == 1}
        self.lines_apart = not any("\n" in text for _, text, _ in pieces)
        self.line_feed = array("i", self._unknown("\n")).tobytes()
        self.spelling = np.empty(1 + max([unknown, *self.text, *([bytes_from + 255] if bytes_from is not None else [])]), object)
        self.spelling[:] = b""
        for n, text in self.text.items():
            self.spelling[n] = text.replace(SPACE, " ").encode()
        if bytes_from is not None:
            for b in range(256):
                self.spelling[bytes_from + b] = bytes([b])

    def merged(self, text: str) -> list[str]:
        """The model's rule, for a few characters: merge the two neighbours whose piece scores best, the leftmost first."""
        parts, score = list(text), self.score.get
        scores = [score(a + b, _LEAST) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) > _LEAST:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            for k in range(max(at - 1, 0), min(at + 1, len(scores))):
                scores[k] = score(parts[k] + parts[k + 1], _LEAST)
        return parts

    def _judge(self, before: int, piece: int) -> bool:
        """Whether a piece stands alone or, after another, both stand beside each other."""
        if self.judged >= PAIRS_KEPT:
            for known in self.after.values():
                known.clear()
            self.judged = 0
        parts = [self.text[n] for n in (before, piece) if n >= 0]
        fits = self.after[piece][before] = self.merged("".join(parts)) == parts
        self.judged += 1
        return fits

    def _unknown(self, char: str) -> list[int]:
        if self.bytes_from is None:
            return [self.unknown]
        return [self.bytes_from + b for b in (SPACE if char == _LITERAL else char).encode()]

    def viterbi(self, word: str) -> list[int]:
        """Ids of the best path over a word."""
        return self._traced(word, self._merges(word) if self.kind == "bpe" else self._scores(word))

    def _traced(self, word: str, last: list[int]) -> list[int]:
        """Ids from the last piece of each place's path."""
        out, at, sizes = [], len(word) - 1, self.sizes
        while at >= 0:
            piece = last[at]
            if piece < 0:
                out.extend(reversed(self._unknown(word[at])))
                at -= 1
            else:
                out.append(piece)
                at -= sizes[piece]
        out.reverse()
        return out

    def _merges(self, word: str) -> list[int]:
        """The piece that the best path to each character ends in, -1 for an unknown character. Before the first stands
        index -1, the spare last place: a start, like an unknown character."""
        last = [-1] * (len(word) + 1)
        for end, (piece, size, _, after) in self.automaton.iter(word):
            if last[end] < 0:
                before = last[end - size]
                fits = after.get(before)
                if fits is None:
                    fits = self._judge(before, piece)
                if fits:
                    last[end] = piece
        return last

    def _scores(self, word: str) -> list[int]:
        """The piece that the best path to each character ends in, -1 for an unknown character."""
        return self._relaxed(word)[0]

    def _relaxed(self, word: str) -> tuple[list[int], list[float]]:
        """One pass over the automaton: every piece that ends at a place is tried as the last step of the best path to it."""
        n = len(word)
        last, value, at = [-1] * (n + 1), [0.0] + [_LEAST] * n, 0
        for end, (piece, size, score, _) in [*self.automaton.iter(word), (n, (-1, 0, 0.0, None))]:
            while at < min(end, n):  # places whose pieces have all been tried
                at += 1
                if last[at - 1] < 0:
                    value[at] = value[at - 1] + self.worst
            if piece >= 0 and value[end + 1 - size] + score > value[end + 1]:
                value[end + 1], last[end] = value[end + 1 - size] + score, piece
        return last, value

    def best(self, part: str) -> complex:
        """Of a part that no piece leaves: the best sum of scores, and how many pieces and unknown characters make it."""
        last, value = self._relaxed(part)
        steps, at = 0, len(part) - 1
        while at >= 0:
            steps += 1
            at -= self.sizes[last[at]] if last[at] >= 0 else 1
        return complex(value[len(part)], steps)

    def _split(self, word: str) -> tuple[str, tuple[bytes, complex] | None]:
        """A word without its last character, and that one's ids and sum, if no piece has both neighbours."""
        end = self.ends.get(word[-1:]) if 1 < len(word) <= LONGEST_KEPT and word[-2:] not in self.joined else None
        return word[:-1], end

    def _sum_of(self, word: str) -> complex:
        """The best sum of a word as ``_cut`` gives it."""
        found = self.sums.find(word)
        if found is not None:
            return found
        if word[:1] == "\n" and self.lines_apart:  # the line feed is an unknown character, so what follows is summed apart
            found = complex(self.worst, 1) + self.best(word[1:])
        else:
            found = self.best(SPACE + word)
        if len(word) <= LONGEST_KEPT:
            self.sums.keep(word, found)
        return found

    def _learnt(self, word: str) -> tuple[bytes, complex]:
        """Ids and best sum of a word as ``_cut`` gives it: both from one pass of the automaton."""
        found = self.told.find(word)
        if found is not None:
            return found
        if len(word) > LONGEST_KEPT:
            return self.word(word), self._sum_of(word)
        head, end = self._split(word)
        if end:
            ids, total = self._learnt(head)
            found = ids + end[0], total + end[1]
        else:
            found = self._passed(word)
        self.told.keep(word, found)
        return found

    def _passed(self, word: str) -> tuple[bytes, complex]:
        line = word[:1] == "\n" and self.lines_apart
        part = word[1:] if line else SPACE + word
        n = len(part)
        # as in _merges and _relaxed; before the first stands index -1, the spare last place
        last, value, steps = [-1] * (n + 1), [_LEAST] * n + [0.0], [0] * (n + 1)
        for end, (piece, size, score, after) in self.automaton.iter(part):
            start = end - size
            found = value[start] + score
            if found > value[end]:
                value[end] = found
                steps[end] = steps[start] + 1
            if last[end] < 0:
                before = last[start]
                fits = after.get(before)
                if fits is None:
                    fits = self._judge(before, piece)
                if fits:
                    last[end] = piece
        out = array("i", self._traced(part, last)).tobytes()
        total = self.best(part) if _LEAST in value else complex(value[n - 1], steps[n - 1])  # with unknown characters in turn
        return (self.line_feed + out, complex(self.worst, 1) + total) if line else (out, total)

    def _cut(self, text: str) -> list[str]:
        """A text at its spaces and, if no piece has a line feed, before each line feed. A word stands for itself behind a space, one that begins with a
        line feed for itself alone; an empty one is a space before a line feed, in a run of spaces or at an end of the text."""
        return (text.replace("\n", " \n") if self.lines_apart else text).split(" ")

    def _plain(self, text: str) -> list[str] | None:
        """``_cut`` of a text without runs of spaces or spaces at its ends."""
        words = self._cut(text)
        return None if "" in words and ("  " in text or text[0] == " " or text[-1] == " ") else words

    def both(self, text: str) -> tuple[bytes, complex]:
        """``encode`` and ``relaxed`` of a text."""
        words = self._plain(text) if text and self.kind == "bpe" and self.apart and SPACE not in text else None
        if words is None:
            return self.encode(text), self.relaxed(text)
        known, learnt = self.told.new.get, self._learnt
        found = [known(w) or learnt(w) for w in words]
        return b"".join([ids for ids, _ in found]), sum([total for _, total in found])

    def relaxed(self, text: str) -> complex:
        """The best sum of scores of a text, and the pieces of that path."""
        if not text:
            return 0j
        if SPACE in text:
            text = text.replace(SPACE, _LITERAL)
        if not self.apart or self.kind != "bpe":  # pieces may have spaces within
            return self.best(SPACE + text.replace(" ", SPACE))
        known, total = self.sums.new.get, 0j
        for w in self._cut(text):
            total += known(w) or self._sum_of(w)
        return total

    def spaces(self, n: int) -> list[int]:
        """A run of n spaces: from left to right, each time the longest piece that fits."""
        out = []
        while n > 0:
            size = next((r for r in self.runs if r <= n), 1)
            out.append(self.number[SPACE * size] if SPACE * size in self.number else self.unknown)
            n -= size
        return out

    def _run(self, spaces: int, word: str) -> list[int]:
        if self.kind != "bpe" or spaces < 2:
            return self.viterbi(SPACE * spaces + word)
        own = self.viterbi(SPACE + word) if word else []
        if not own or own[0] == self.number.get(SPACE):  # the last space stays apart from the word
            return self.spaces(spaces) + own[1:]
        return self.spaces(spaces - 1) + own

    def word(self, word: str) -> bytes:
        """Ids of a word as ``_cut`` gives it, as 32-bit numbers."""
        out = self.words.find(word)
        if out is not None:
            return out
        head, end = self._split(word)
        if end:
            out = self.word(head) + end[0]
        elif word[:1] == "\n" and self.lines_apart:
            out = self.line_feed + self._ids(word[1:])
        else:
            out = self._ids(SPACE + word)
        if len(word) <= LONGEST_KEPT:
            self.words.keep(word, out)
        return out

    def _ids(self, part: str) -> bytes:
        return array("i", self.viterbi(part)).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, _LITERAL)
        if not self.apart:
            return np.array(self.viterbi(SPACE + text.replace(" ", SPACE)), np.int32).tobytes()
        words, known, spelt = self._plain(text), self.words.new.get, self.word
        if words is not None:
            return b"".join([known(w) or spelt(w) for w in words])
        out = []
        for spaces, word in _RUNS.findall(SPACE + text.replace(" ", SPACE)):
            if len(spaces) == 1 and word:
                out.extend([known(w) or spelt(w) for w in self._cut(word)])
            elif spaces or word:
                out.append(np.array(self._run(len(spaces), word), np.int32).tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        raw = b"".join(self.spelling[ids].tolist())
        return raw[1:] if raw[:1] == b" " else raw


def load(model: str = MODEL) -> tuple:
    """What ``Pieces`` is built of, read from a model file on the driver."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as layout

    proto = layout.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceProcessor(model_file=model).serialized_model_proto())
    kinds = layout.ModelProto.SentencePiece
    kind = {1: "unigram", 2: "bpe"}.get(proto.trainer_spec.model_type)
    if kind is None:
        raise ValueError("only unigram and bpe models are known")
    if any(p.type == kinds.USER_DEFINED for p in proto.pieces):
        raise ValueError("user-defined pieces are not supported")
    pieces = [(n, p.piece, p.score) for n, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
    first = [n for n, p in enumerate(proto.pieces) if p.type == kinds.BYTE]
    unknown = next((n for n, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), 0)
    return kind, pieces, first[0] if len(first) == 256 else None, unknown


_BUILT: dict[int, Pieces] = {}


def _pieces(values: tuple) -> Pieces:
    key = hash((values[0], len(values[1]), tuple(values[1][-50:])))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Pieces(*values)
    return _BUILT[key]


def _lists(parts: list[bytes | None]) -> pa.Array:
    sizes = np.array([0, *(len(p or b"") // 4 for p in parts)], np.int64)
    ids = np.frombuffer(b"".join(p for p in parts if p), np.int32)
    mask = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(ids), mask=mask)


IDS = T.ArrayType(T.IntegerType())


def encoder(values: tuple):
    @F.arrow_udf(IDS)
    def encoded(texts: pa.Array) -> pa.Array:
        pieces = _pieces(values)
        return _lists([pieces.encode(t) if t is not None else None for t in texts.to_pylist()])

    # else a query that also decodes the ids has the optimiser merge both steps, and texts are encoded twice
    return encoded.asNondeterministic()


def reader(values: tuple):
    """Ids, the text that they spell, and the best sum of scores with the pieces of its path: all in one pass through one worker."""

    @F.arrow_udf(T.StructType([T.StructField("ids", IDS), T.StructField("decoded", T.StringType()), T.StructField("best_score", T.DoubleType()), T.StructField("n_best", T.LongType())]))
    def read(texts: pa.Array) -> pa.Array:
        pieces, parts, sums = _pieces(values), [], []
        for t in texts.to_pylist():
            ids, total = pieces.both(t) if t is not None else (None, None)
            parts.append(ids)
            sums.append(total)
        spelt = pa.array([None if x is None else pieces.decode(np.frombuffer(x, np.int32)).decode("utf-8", "replace") for x in parts], pa.string())
        scores = pa.array([None if x is None else x.real for x in sums], pa.float64())
        steps = pa.array([None if x is None else int(x.imag) for x in sums], pa.int64())
        return pa.StructArray.from_arrays([_lists(parts), spelt, scores, steps], names=["ids", "decoded", "best_score", "n_best"])

    return read.asNondeterministic()


def proved(values: tuple):
    """Ids, and whether they decode to the text: both in one pass through one worker."""

    @F.arrow_udf(T.StructType([T.StructField("ids", IDS), T.StructField("round_trip", T.BooleanType())]))
    def encoded(texts: pa.Array) -> pa.Array:
        pieces, parts, same = _pieces(values), [], []
        for t in texts.to_pylist():
            parts.append(pieces.encode(t) if t is not None else None)
            same.append(None if t is None else pieces.decode(np.frombuffer(parts[-1], np.int32)) == t.encode())
        return pa.StructArray.from_arrays([_lists(parts), pa.array(same, pa.bool_())], names=["ids", "round_trip"])

    return encoded


def decoder(values: tuple):
    @F.arrow_udf(T.StringType())
    def decoded(lists: pa.Array) -> pa.Array:
        pieces, out = _pieces(values), []
        for one in lists:
            ids = one.values
            out.append(None if ids is None else pieces.decode(ids.to_numpy()).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return decoded


def encode(docs: DataFrame, text: str = "text", into: str = "ids", model: str = MODEL) -> DataFrame:
    """``docs`` and the ids of each whole text. A column of that name is replaced."""
    return docs.withColumn(into, encoder(load(model))(F.col(text)))


def decode(docs: DataFrame, ids: str = "ids", into: str = "decoded", model: str = MODEL) -> DataFrame:
    """``docs`` and the text that each row's ids spell. A column of that name is replaced."""
    return docs.withColumn(into, decoder(load(model))(F.col(ids)))


def tokenised(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """``docs`` and ids, n_tokens, and round_trip: whether decoding the ids gives the text (null for a null text).
    A column of ``docs`` that has one of these names, in any case, is replaced."""
    new = ("ids", "n_tokens", "round_trip")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    (both,) = unused(docs, "pieces")
    made = docs.withColumn(both, proved(load(model))(F.col(text)))
    return made.select(
        *docs.columns,
        F.col(f"{both}.ids").alias("ids"),
        F.coalesce(F.array_size(f"{both}.ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.col(f"{both}.round_trip").alias("round_trip"),
    )


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, the digest of what they decode to, and the best sum of scores over the same pieces."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.withColumn("read", reader(load())("text")).select(
        "doc_id",
        F.col("read.ids").alias("ids"),
        F.coalesce(F.array_size("read.ids"), F.lit(0)).cast("long").alias("n_tokens"),
        F.sha2("read.decoded", 256).alias("decoded_sha256"),
        (F.col("read.decoded") == F.col("text")).alias("round_trip"),
        F.col("read.best_score").alias("best_score"),
        F.col("read.n_best").alias("n_best"),
    )
