"""Language-model scoring by masked pseudo-likelihood.

Words (white space splits, A-Z lower-cased) are numbered by corpus counts over all documents. The most frequent have numbers of their own, in
classes by rank; the others share one more class of hash buckets. A network predicts each word from ``SIDE`` words on
either side, never from itself: hidden = tanh(sum of each neighbour's vector, weighted by place), then a softmax over classes and one over the
words of the class. A word of a bucket has the bucket's probability times its share of the bucket's count; the ``KNOWN`` most frequent words
have their own shares, the rest of a bucket's count is shared evenly by the rest of its words. So probabilities add up to one over all words of
the corpus. A document's score is the sum over its words of the logs of these conditional probabilities.

*Size.* With n words in the corpus there are c * c words of their own in c classes, c being the power of two next above the fifth root of n, at
most ``MOST_CLASSES``. What is gathered grows with the input: a count for each word, and a copy of the network for each group of documents.

*Training* covers every position of all documents once. Documents are dealt by a hash into groups of about ``GROUP_WORDS`` words, and each group,
in the order of its hashes, trains a copy in numpy from where the round starts. A round takes one position in as many as there are
rounds, each round others. Copies are averaged by positions: as whole numbers in fixed point, which add up to the same in
any order, in the task first and then over tasks. So neither the number of partitions nor a lost executor changes a score. Only the
averaged network and the known words, 12 bytes each, come to the driver.

Null and empty texts have no words: n_words 0, score 0, and a null mean. A text's borders count as a word of their own.
A corpus without words gives an untrained network. A word that the corpus did not have counts as one of the rest of its bucket. Repeated rows
count and are scored each. Other columns are ignored by ``train`` and carried by ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, table
from .wordhash import by_size, word_hashes

SIDE = 2
WIDTH = 16
ROUNDS = 2
BATCH = 8192
RATE = 0.1
#: Classes of a network, at most: 256 * 256 words of their own make 17 MB.
MOST_CLASSES = 256
#: Words whose share of their bucket is broadcast, at most.
KNOWN = 1 << 20
#: Words of a group of documents, about.
GROUP_WORDS = 1 << 19
#: Bytes of text that are scored at a time: what a window takes in numpy stays in a core's cache.
SCORED_AT_ONCE = 1 << 16
#: Values in a block of a network's copy, and the steps to one in which they are summed.
BLOCK = 4096
FINE = 1 << 16

_PLACES = [k for k in range(-SIDE, SIDE + 1) if k]


def classes_for(n_words: int) -> int:
    """How many classes, and words of each, a corpus of so many words gets."""
    c = 8
    while c < MOST_CLASSES and c**5 < n_words:
        c *= 2
    return c


class WindowNet:
    """Weights as float32 arrays; ``flat`` lays them out in one. Class ``size`` is that of the buckets."""

    def __init__(self, size: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.size, self.border = size, (size + 1) * size
        self.weights = {
            "vectors": draw(self.border + 1, WIDTH),
            "places": np.ones((len(_PLACES), WIDTH), np.float32),
            "shift": np.zeros(WIDTH, np.float32),
            "to_class": draw(WIDTH, size + 1),
            "class_bias": np.zeros(size + 1, np.float32),
            "to_word": draw(size + 1, size, WIDTH),
            "word_bias": np.zeros((size + 1, size), np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights.values()])

    def load(self, flat: np.ndarray) -> WindowNet:
        at = 0
        for name, w in self.weights.items():
            self.weights[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return self

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """Of neighbours, a row for each place."""
        w = self.weights
        total = np.tile(w["shift"], (around.shape[1], 1))
        for k in range(len(_PLACES)):
            total += (w["vectors"] * w["places"][k])[around[k]]
        return np.tanh(total, out=total)

    def _by_class(self, words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order that puts words of a class together, and (class, from, to) in it."""
        classes = (words // self.size).astype(np.uint16)
        order = np.argsort(classes, kind="stable")
        ends = np.searchsorted(classes[order], np.arange(self.size + 2))
        return order, [(c, int(a), int(b)) for c, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]

    def _spread(self, h: np.ndarray, parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """What both softmaxes are taken of, for positions in the order of classes."""
        w = self.weights
        first = h @ w["to_class"]
        first += w["class_bias"]
        second = np.empty((len(h), self.size), np.float32)
        for c, a, b in parts:
            np.dot(h[a:b], w["to_word"][c].T, out=second[a:b])
            second[a:b] += w["word_bias"][c]
        if self._largest() > 80:  # else no exponential leaves the range of float32
            for z in (first, second):
                z -= z.max(axis=1, keepdims=True)
        return first, second

    def _largest(self) -> float:
        """A bound on what the softmaxes are taken of, as no hidden value is beyond 1."""
        w = self.weights
        first = np.abs(w["to_class"]).sum(axis=0) + np.abs(w["class_bias"])
        return float(max(first.max(), (np.abs(w["to_word"]).sum(axis=2) + np.abs(w["word_bias"])).max()))

    def log_probabilities(self, around: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of each word or bucket, given its neighbours."""
        order, parts = self._by_class(words)
        rows, sorted_words = np.arange(len(words)), words[order]
        out = np.zeros(len(words), np.float32)
        for z, at in zip(self._spread(self.hidden(around[:, order]), parts), np.divmod(sorted_words, self.size), strict=True):
            out += z[rows, at]
            out -= np.log(np.exp(z, out=z).sum(axis=1))
        back = np.empty_like(out)
        back[order] = out
        return back

    def gradients(self, around: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(words)
        order, parts = self._by_class(words)
        around, words = around[:, order], words[order]
        h, rows = self.hidden(around), np.arange(n)
        first, second = self._spread(h, parts)
        for z, at in zip((first, second), np.divmod(words, self.size), strict=True):
            np.exp(z, out=z)
            z *= (1 / (n * z.sum(axis=1)))[:, None]
            z[rows, at] -= np.float32(1 / n)
        back = first @ w["to_class"].T
        to_word, word_bias = np.zeros_like(w["to_word"]), np.zeros_like(w["word_bias"])
        for c, a, b in parts:
            back[a:b] += second[a:b] @ w["to_word"][c]
            np.dot(second[a:b].T, h[a:b], out=to_word[c])
            word_bias[c] = second[a:b].sum(axis=0)
        h_rest = 1 - h * h
        back *= h_rest
        vectors, places = np.zeros_like(w["vectors"]), np.empty_like(w["places"])
        numbers = np.uint16 if self.border < 1 << 16 else np.int32  # 16 bits are sorted by radix
        for k in range(len(_PLACES)):
            near = np.argsort(around[k].astype(numbers), kind="stable")
            found = around[k][near]
            starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            pulled = np.add.reduceat(back[near], starts, axis=0)  # of each word at this place
            at = found[starts]
            vectors[at] += pulled * w["places"][k]
            places[k] = (pulled * w["vectors"][at]).sum(axis=0)
        return {
            "vectors": vectors, "places": places, "shift": back.sum(axis=0), "to_class": h.T @ first,
            "class_bias": first.sum(axis=0), "to_word": to_word, "word_bias": word_bias,
        }


class Trainer:
    """Adagrad on one copy of the network, batch by batch as positions come."""

    def __init__(self, net: WindowNet):
        self.net, self.seen = net, 0
        self.squares = {k: np.full_like(v, 1e-3) for k, v in net.weights.items()}
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, around: np.ndarray, words: np.ndarray, last: bool = False) -> None:
        self.waiting.append((around, words))
        self.held += len(words)
        if self.held < BATCH and not last or not self.held:
            return
        around, words = (np.concatenate(x, axis=-1) for x in zip(*self.waiting, strict=True))
        stop = len(words) if last else len(words) // BATCH * BATCH
        for k in range(0, stop, BATCH):
            a, w = around[:, k : min(k + BATCH, stop)], words[k : min(k + BATCH, stop)]
            for name, g in self.net.gradients(a, w).items():
                self.squares[name] += g * g
                g *= RATE
                g /= np.sqrt(self.squares[name])
                self.net.weights[name] -= g
            self.seen += len(w)
        self.waiting, self.held = [(around[:, stop:], words[stop:])], len(words) - stop


class Numbering:
    """Word hashes to word numbers: by rank, or a bucket of the last class."""

    def __init__(self, ranked: np.ndarray, size: int):
        ranks = np.asarray(ranked, np.int64).view(np.uint64)
        self.size, self.border = size, (size + 1) * size
        self.order = np.argsort(ranks).astype(np.int32)
        self.sorted = ranks[self.order]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = (self.size * self.size + (hashes >> np.uint64(48)) % np.uint64(self.size)).astype(np.int32)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            known = self.sorted[at] == hashes
            out[known] = self.order[at[known]]
        return out

    def windows(self, words: np.ndarray, first: np.ndarray, every: int = 1, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Of the numbers of all texts, text k being ``first[k]`` to ``first[k + 1]``: the words, and a row of neighbours for each place; or only
        at one position of ``every`` of each text; turns 0 to ``every`` - 1 take each position once, the text's length deciding when."""
        n = np.diff(first)
        owner = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(words))
        place = at + SIDE * (1 + owner)  # texts are SIDE borders apart
        padded = np.full(len(words) + SIDE * (len(n) + 1), self.border, np.int32)
        padded[place] = words
        if every > 1:
            own = np.flatnonzero((at - first[owner] + turn + n[owner]) % every == 0)
            place, words = place[own], words[own]
        return words, np.stack([padded[place + k] for k in _PLACES])


def _counts(batches):
    """(word hash, count) of each chunk of texts."""
    for batch in batches:
        raws = (t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist())
        for part in by_size(raws):
            words, n = np.unique(word_hashes(part)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """How often each word hash occurs in all of ``docs``."""
    return docs.select(F.col(text).alias("text")).mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


_LAYOUT = "block int, seen long, sums binary"


def numbered(ranked: np.ndarray, size: int):
    """The word numbers of each text, as bytes."""

    @F.arrow_udf(T.BinaryType())
    def made(texts: pa.Array) -> pa.Array:
        numbering, out = Numbering(ranked, size), []
        kind = np.uint16 if numbering.border < 1 << 16 else np.int32
        for part in by_size([t or b"" for t in texts.cast(pa.binary()).to_pylist()]):
            hashes, _, _, first = word_hashes(part)
            words = numbering.numbers(hashes).astype(kind)
            out += [words[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
        return pa.array(out, pa.binary())

    return made


def _copies(size: int, start: np.ndarray, every: int, turn: int):
    """Rows (group, word numbers), groups together, to the sums of the groups' copies of the network, in blocks: each value in fixed point times
    the positions seen."""

    def trained(batches):
        numbering, none = Numbering(np.zeros(0, np.int64), size), np.zeros(0, np.int32)
        kind = np.uint16 if numbering.border < 1 << 16 else np.int32
        seen, sums, trainer, at = 0, np.zeros(len(start), np.int64), None, None

        def take():
            trainer.add(none.reshape(len(_PLACES), 0), none, last=True)
            return trainer.seen, np.rint(trainer.net.flat().astype(np.float64) * (trainer.seen * FINE)).astype(np.int64)

        for batch in batches:
            groups = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a and groups[a] != at:
                    if trainer is not None:
                        n, flat = take()
                        seen, sums = seen + n, sums + flat
                    trainer, at = Trainer(WindowNet(size).load(start)), groups[a]
                for part in by_size(batch.column(1).slice(a, b - a).to_pylist()):  # its borders change nothing
                    words = np.frombuffer(b"".join(part), kind).astype(np.int32)
                    first = np.cumsum([0, *(len(t) // np.dtype(kind).itemsize for t in part)])
                    found, around = numbering.windows(words, first, every, turn)
                    trainer.add(around, found)
        if trainer is not None:
            n, flat = take()
            seen, sums = seen + n, sums + flat
        if seen:
            parts = [sums[k : k + BLOCK].tobytes() for k in range(0, len(sums), BLOCK)]
            columns = (pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()), pa.array(parts, pa.binary()))
            yield pa.RecordBatch.from_arrays(list(columns), names=["block", "seen", "sums"])

    return trained


def _summed(batches):
    """Blocks of copies to the sum of each block."""
    totals: dict[int, list] = {}
    for batch in batches:
        for block, seen, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            one = totals.setdefault(block, [0, 0])
            one[0] += seen
            one[1] = one[1] + np.frombuffer(sums, np.int64)
    columns = (
        pa.array(list(totals), pa.int32()),
        pa.array([x[0] for x in totals.values()], pa.int64()),
        pa.array([x[1].tobytes() for x in totals.values()], pa.binary()),
    )
    yield pa.RecordBatch.from_arrays(list(columns), names=["block", "seen", "sums"])


@dataclass
class Model:
    ranked: np.ndarray
    net: WindowNet
    #: hashes of known words in buckets, ascending, and the logs of their shares
    known: np.ndarray
    shares: np.ndarray
    #: the log of the share of any other word, by bucket
    others: np.ndarray

    def share(self, hashes: np.ndarray) -> np.ndarray:
        """The logs of the shares of words that are in buckets."""
        out = self.others[((hashes >> np.uint64(48)) % np.uint64(self.net.size)).astype(np.int64)]
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            found = self.known[at] == hashes
            out[found] = self.shares[at[found]]
        return out


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, n) of all words that occur at least so often that there are at most ``most`` of them, by falling n."""
    often = F.least("n", F.lit(1_000_000))
    at_least, held = 1, 0
    for n, words in sorted(counts.groupBy(often.alias("n")).count().collect(), reverse=True):
        held += words
        if held > most:
            at_least = n + 1
            break
    if at_least > 1_000_000:  # so many words are as frequent as that only in a corpus of 10**12 words
        chosen = counts.orderBy(F.desc("n"), "word").limit(most)
    else:
        chosen = counts.where(F.col("n") >= at_least)
    got = chosen.select("word", "n").toArrow()
    words, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    order = np.lexsort((words, -n))
    return words[order], n[order]


def train(docs: DataFrame, text: str = "text", doc_id: str | None = None, rounds: int = ROUNDS) -> Model:
    """A model of all of ``docs``. ``doc_id`` only spreads copies of a text over groups."""
    counts = settle(count_words(docs, text), "counts")
    n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    size = classes_for(n_words)
    words, often = _frequent(counts, KNOWN)
    ranked, net = words[: size * size], WindowNet(size)
    bucket = F.pmod(F.shiftrightunsigned("word", 48), F.lit(size))
    total, distinct = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for b, n, d in counts.groupBy(bucket.alias("bucket")).agg(F.sum("n"), F.count("*")).collect():
        total[b], distinct[b] = n, d
    own = ((words.view(np.uint64) >> np.uint64(48)) % np.uint64(size)).astype(np.int64)
    np.subtract.at(total, own[: len(ranked)], often[: len(ranked)])
    np.subtract.at(distinct, own[: len(ranked)], 1)
    left, rest = total.copy(), distinct.copy()
    np.subtract.at(left, own[len(ranked) :], often[len(ranked) :])
    np.subtract.at(rest, own[len(ranked) :], 1)
    others = np.where(rest > 0, np.log(np.maximum(left, 1) / np.maximum(rest, 1)), 0.0) - np.log(total + (rest == 0))
    hashes = words[len(ranked) :].view(np.uint64)
    order = np.argsort(hashes)
    shares = np.log(often[len(ranked) :] / np.maximum(total[own[len(ranked) :]], 1))[order].astype(np.float32)
    if len(ranked):
        rows = docs.select(*([F.col(doc_id)] if doc_id else []), F.coalesce(F.col(text), F.lit("")).alias("text"))
        dealt = F.xxhash64(*rows.columns)
        groups = int(-(-n_words // GROUP_WORDS))
        rows = rows.select(F.pmod(dealt, F.lit(groups)).alias("group"), dealt.alias("place"), numbered(ranked, size)("text").alias("words"))
        rows = rows.repartition("group").sortWithinPartitions("group", "place", "words").select("group", "words")
        for turn in range(rounds):
            blocks = rows.mapInArrow(_copies(size, net.flat(), rounds, turn), _LAYOUT).repartition("block").mapInArrow(_summed, _LAYOUT)
            found = sorted((r.block, r.seen, bytes(r["sums"])) for r in blocks.collect())
            if found:  # a round may find no position where texts are short
                net.load(np.concatenate([np.frombuffer(v, np.int64) / (seen * FINE) for _, seen, v in found]))
    return Model(ranked, net, hashes[order], shares, others)


SCORE = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("log_likelihood", T.DoubleType())])


def scorer(model: Model):
    """Of each text how many words it has, and the sum of the logs of their probabilities."""

    @F.arrow_udf(SCORE)
    def scored(texts: pa.Array) -> pa.Array:
        size = model.net.size
        numbering = Numbering(model.ranked, size)
        raws = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        sizes, sums = [], []
        for part in by_size(raws, SCORED_AT_ONCE):
            hashes, _, _, first = word_hashes(part)
            numbers = numbering.numbers(hashes)
            words, around = numbering.windows(numbers, first)
            logs = model.net.log_probabilities(around, words).astype(np.float64)
            rare = np.flatnonzero(numbers >= size * size)
            logs[rare] += model.share(hashes[rare])
            total = np.concatenate([[0.0], np.cumsum(logs)])
            sizes.append(np.diff(first))
            sums.append(np.where(np.diff(first) > 0, total[first[1:]] - total[first[:-1]], 0.0))
        whole = [np.concatenate([np.zeros(0), *x]) for x in (sizes, sums)]
        return pa.StructArray.from_arrays(
            [pa.array(whole[0].astype(np.int64)), pa.array(whole[1])], names=["n_words", "log_likelihood"]
        )

    return scored


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "lm") -> DataFrame:
    """``docs`` and a struct (n_words, log_likelihood) of each whole text. A column of that name is replaced."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() == into.lower()])
    return docs.withColumn(into, scorer(model)(F.col(text)))


def op9_pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-log-likelihood of every document under a network trained on all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, doc_id="doc_id")).select(
        "doc_id",
        F.col("lm.n_words").alias("n_words"),
        F.col("lm.log_likelihood").alias("log_likelihood"),
        F.when(F.col("lm.n_words") > 0, F.col("lm.log_likelihood") / F.col("lm.n_words")).alias("mean_log_probability"),
    )
