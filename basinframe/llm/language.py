"""Language identification by a byte convolutional network.

Texts are cut into overlapping windows of ``WINDOW`` bytes of their UTF-8 form (A-Z lower-cased), so that every
byte n-gram of a text of any length lies in a window. A window's bytes are embedded; filters of several widths run
over it, each is max-pooled over the window, and a softmax over the pooled values gives a probability for each language.
A text's prediction is the language with the largest mean over its windows, its score that mean.

The network is trained in numpy on the driver, on a bounded sample of rows: about ``DOCS_PER_LANG`` labelled documents of each
language, and of very many languages as many of each as make ``SAMPLED_DOCS``, but 20 at least, so that no language is left out;
all windows of each document that is drawn, each weighing so much that a document counts as ``WEIGHT`` windows at most, however long. Documents are
drawn by a hash of doc_id; those whose crc32(doc_id as text) mod 4 is 2 are held out. Only text and lang are learned from.

A null text, and one without a letter, is ``und`` with score 0, as is every text if there is nothing to learn from; ``keep_known`` then goes by
letters alone, so that an unlabelled table keeps its texts.
Null languages and null doc_ids are not learned from; a null doc_id is not held out. Repeated rows are predicted alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, unused

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 4
DOCS_PER_LANG = 300
WEIGHT = 8
SAMPLED_DOCS = 64_000
#: Languages whose shares are broadcast at most, some 10 MB.
LANGS_SENT = 100_000
EPOCHS = 8
UNKNOWN = "und"

_WIDEST = max(WIDTHS)
_STEP = WINDOW - _WIDEST + 1  # positions at which a filter can start
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_AT_ONCE = 512


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text, padded with zeros; an empty text has one."""
    n = max(1, -(-len(raw) // _STEP))
    padded = np.zeros((n - 1) * _STEP + WINDOW, np.uint8)
    padded[: len(raw)] = _LOWER[np.frombuffer(raw, np.uint8)]
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::_STEP]


class ByteConvNet:
    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.langs, n = langs, FILTERS * len(WIDTHS)
        self.weights = {
            "bytes": draw(256, EMBEDDING) * 0.5,
            "filters": draw(_WIDEST, EMBEDDING, n) / np.sqrt(_WIDEST * EMBEDDING).astype(np.float32),
            "shift": np.zeros(n, np.float32),
            "out": draw(n, len(langs)) * 0.1,
            "bias": np.zeros(len(langs), np.float32),
        }
        #: narrow filters have no weight beyond their width
        self.mask = np.zeros((_WIDEST, 1, n), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1

    def convolved(self, windows: np.ndarray) -> np.ndarray:
        w = self.weights
        x = w["bytes"][windows]
        columns = np.concatenate([x[:, k : k + _STEP] for k in range(_WIDEST)], axis=2)
        return columns.reshape(-1, _WIDEST * EMBEDDING) @ (w["filters"] * self.mask).reshape(_WIDEST * EMBEDDING, -1)

    def softmax(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.weights["shift"], 0) @ self.weights["out"] + self.weights["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = [np.zeros((0, len(self.langs)), np.float32)]
        for k in range(0, len(windows), _AT_ONCE):
            part = windows[k : k + _AT_ONCE]
            out.append(self.softmax(self.convolved(part).reshape(len(part), _STEP, -1).max(axis=1)))
        return np.concatenate(out)

    def gradients(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy, each window's being multiplied by its weight."""
        w, n, rows = self.weights, len(windows), np.arange(len(windows))
        conv = self.convolved(windows).reshape(n, _STEP, -1)
        at = conv.argmax(axis=1)  # window x filter: where each filter answers most
        pooled = np.take_along_axis(conv, at[:, None, :], axis=1)[:, 0]
        error = self.softmax(pooled)
        error[rows, labels] -= 1
        error /= n
        if weights is not None:
            error *= weights[:, None]
        active = np.maximum(pooled + w["shift"], 0)
        back = (error @ w["out"].T) * (active > 0)
        patch = windows[rows[:, None, None], at[:, :, None] + np.arange(_WIDEST)]  # window x filter x width
        seen = w["bytes"][patch]
        filters = np.einsum("nf,nfkd->kdf", back, seen, optimize=True) * self.mask
        to_bytes = np.einsum("nf,kdf->nfkd", back, w["filters"] * self.mask, optimize=True)
        embedded = np.zeros_like(w["bytes"])
        np.add.at(embedded, patch.ravel(), to_bytes.reshape(-1, EMBEDDING))
        return {
            "bytes": embedded, "filters": filters, "shift": back.sum(axis=0), "out": active.T @ error,
            "bias": error.sum(axis=0),
        }

    def fit(self, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, epochs: int = EPOCHS, batch: int = 256, rate: float = 0.01) -> None:
        """Adam over shuffled batches; every language weighs the same."""
        rng, step = np.random.default_rng(11), 0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        most = np.bincount(labels).max()
        for epoch in range(epochs):
            even = np.concatenate([rng.permutation(np.resize(np.flatnonzero(labels == c), most)) for c in np.unique(labels)])
            order = rng.permutation(even)
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for k in range(0, len(order), batch):
                step += 1
                part = order[k : k + batch]
                for name, g in self.gradients(windows[part], labels[part], None if weights is None else weights[part]).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    move = now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    self.weights[name] -= move.astype(np.float32)

    def predict(self, raws: list[bytes]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; windows of all are taken together."""
        cut = [windows_of(r) for r in raws]
        p = self.probabilities(np.concatenate(cut))
        begin = np.cumsum([0, *(len(c) for c in cut[:-1])])
        mean = np.add.reduceat(p.astype(np.float64), begin) / np.array([len(c) for c in cut])[:, None]
        best = mean.argmax(axis=1)
        return [self.langs[k] for k in best], np.clip(mean[np.arange(len(best)), best], 0, 1)


def remainder(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


@F.arrow_udf(T.BinaryType())
def _windows(texts: pa.Array) -> pa.Array:
    """All windows of each text, one after the other."""
    return pa.array([windows_of(t.as_py()).tobytes() for t in texts.cast(pa.binary())], pa.binary())


def train(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_lang: int = DOCS_PER_LANG
) -> ByteConvNet | None:
    """A network for the languages of the rows that are not held out, or None if none has one."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where((remainder("doc_id") != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.where(has_letter("text")).groupBy("lang").count()
    n_langs = counts.count()
    if not n_langs:
        return None
    each = float(min(docs_per_lang, max(20, SAMPLED_DOCS // n_langs)))  # of 20 to be expected, some are drawn
    wanted = counts.select("lang", F.least(F.lit(1.0), F.lit(each) / F.col("count")).alias("share"))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    if n_langs <= LANGS_SENT:  # else texts are shuffled by language
        wanted = F.broadcast(wanted)
    sample = rows.where(has_letter("text")).join(wanted, "lang").where(drawn)
    got = sorted((r.lang, bytes(r.w)) for r in sample.select("lang", _windows("text").alias("w")).collect())
    if not got:
        return None
    langs = sorted({x for x, _ in got})
    net = ByteConvNet(langs)
    windows = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, WINDOW)
    number = {x: k for k, x in enumerate(langs)}
    sizes = np.array([len(w) // WINDOW for _, w in got])
    weights = (np.minimum(sizes, WEIGHT) / sizes).astype(np.float32)
    net.fit(windows, np.repeat([number[x] for x, _ in got], sizes), np.repeat(weights, sizes))
    return net


PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])


def predictor(net: ByteConvNet, bytes_at_once: int = 1 << 20):
    @F.arrow_udf(PREDICTION)
    def predicted(texts: pa.Array, readable: pa.Array) -> pa.Array:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        batch, rows, held = [], [], 0

        def flush():
            for k, lang, score in zip(rows, *net.predict(batch), strict=True):
                langs[k], scores[k] = lang, score

        for k, (text, ok) in enumerate(zip(texts.cast(pa.binary()), readable, strict=True)):
            if not ok.as_py():
                continue
            batch.append(text.as_py())
            rows.append(k)
            held += len(batch[-1])
            if held > bytes_at_once:
                flush()
                batch, rows, held = [], [], 0
        if batch:
            flush()
        return pa.StructArray.from_arrays([pa.array(langs), pa.array(scores)], names=["lang", "score"])

    return predicted


def identify(docs: DataFrame, net: ByteConvNet | None, text: str = "text", into: str = "prediction") -> DataFrame:
    """``docs`` and a struct (lang, score) for each whole text."""
    if net is None:
        nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
        return docs.withColumn(into, nothing)
    return docs.withColumn(into, predictor(net)(F.col(text), has_letter(text)))


def keep_known(docs: DataFrame, net: ByteConvNet | None, text: str = "text", langs: list[str] | None = None) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or, where ``langs`` is given, none of those."""
    if net is None:
        return docs.where(has_letter(text)) if not langs else docs.limit(0)
    (into,) = unused(docs, "prediction")
    found = F.col(f"{into}.lang")
    good = found.isin(langs) if langs else found != UNKNOWN
    return identify(docs, net, text, into).where(good).drop(into)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train(docs)
    return identify(docs.select("doc_id", "text"), net).select(
        "doc_id",
        F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out"),
        F.col("prediction.lang").alias("lang_pred"),
        F.col("prediction.score").alias("score"),
    )
