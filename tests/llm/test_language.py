import random
import zlib

import numpy as np
import pytest

from basinframe.llm import language

SYLLABLES = {"aa": ["the", "ing", "er", "on"], "bb": ["que", "ñ", "ción", "os"], "cc": ["ß", "sch", "ü", "ein"]}


def documents(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(list(SYLLABLES))
        word = lambda s=SYLLABLES[lang]: "".join(rng.choice(s) for _ in range(rng.randint(1, 3)))
        text = " ".join(word() for _ in range(rng.randint(5, 120)))
        out.append((k, text.upper() if k % 9 == 0 else text, lang))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "bb"), (1003, "theing er", None), (None, "theing er on", "aa")]
    odd += [(1004, "the er on ing " * 20_000, "aa"), (3, documents()[3][1], "aa")]
    rows = [(*r, "clash") for r in documents() + odd]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, prediction string")


def test_held_out_accuracy_and_odd_rows(docs):
    net = language.train(docs)
    assert net.langs == ["aa", "bb", "cc"]
    found = {}
    for r in language.identify(docs, net, into="found").collect():
        found.setdefault(r.doc_id, (r.found.lang, r.found.score))
    held = [(k, lang) for k, _, lang in documents() if zlib.crc32(str(k).encode()) % 4 == 2]
    assert np.mean([found[k][0] == lang for k, lang in held]) > 0.97
    assert all(found[k] == ("und", 0.0) for k in (1000, 1001, 1002))
    assert found[1004][0] == "aa" and found[None][0] == "aa"
    assert all(0 <= s <= 1 for _, s in found.values())


def test_stage_keeps_readable_rows_and_columns(docs):
    kept = language.keep_known(docs, language.train(docs))
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 3


def test_nothing_to_learn_from(docs):
    empty = docs.limit(0)
    assert language.train(empty) is None
    assert language.identify(empty, None, into="found").collect() == []
    unlabelled = docs.withColumn("lang", language.F.lit(None).cast("string"))
    assert language.train(unlabelled) is None
    lettered = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in language.keep_known(docs, None).collect()} == lettered


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLED_DOCS", 50)
    monkeypatch.setattr(language, "EPOCHS", 1)
    rows = [(k, f"text {k} of lang", f"l{k % 200}") for k in range(1600)]
    rows += [(2000 + k, "rare one", "rare") for k in range(3)]
    net = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(net.langs) == {f"l{k}" for k in range(200)} | ({"rare"} if "rare" in net.langs else set())


def test_held_out_rows_are_not_learned_from(docs):
    """A label that only held-out rows have is never learned."""
    held = language.remainder("doc_id") == 2
    marked = docs.withColumn("lang", language.F.when(held, "held").otherwise(docs.lang))
    assert "held" not in language.train(marked).langs


def test_every_filter_position_lies_in_a_window():
    for n in (0, 1, 3, 125, 126, 250, 1000):
        raw = bytes(np.random.default_rng(n).integers(1, 60, n, dtype=np.uint8))
        grams = {w[k : k + 4].tobytes() for w in language.windows_of(raw) for k in range(language._STEP)}
        assert {raw[k : k + 4] for k in range(n - 3)} <= grams


def test_gradients_match_differences():
    rng = np.random.default_rng(5)
    net = language.ByteConvNet(["x", "y"])
    for name in net.weights:
        net.weights[name] = net.weights[name].astype(np.float64)
    windows, labels = rng.integers(0, 256, (12, language.WINDOW)).astype(np.uint8), rng.integers(0, 2, 12)
    loss = lambda: -np.log(net.probabilities(windows)[np.arange(12), labels]).mean()
    for name, g in net.gradients(windows, labels).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = net.weights[name][at]
        net.weights[name][at] = old + 1e-5
        up = loss()
        net.weights[name][at] = old - 1e-5
        assert (up - loss()) / 2e-5 == pytest.approx(g[at], rel=1e-3), name
        net.weights[name][at] = old


def test_convolution_and_pooling_match_plain_loops():
    rng = np.random.default_rng(9)
    net = language.ByteConvNet(["x", "y", "z"])
    net.weights["shift"] += rng.normal(0, 0.1, net.weights["shift"].shape).astype(np.float32)
    windows, w = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8), net.weights
    for window, got in zip(windows, net.probabilities(windows), strict=True):
        pooled = []
        for f in range(language.FILTERS * len(language.WIDTHS)):
            width, best = language.WIDTHS[f // language.FILTERS], -np.inf
            for at in range(language._STEP):
                total = 0.0
                for k in range(width):
                    for d in range(language.EMBEDDING):
                        total += float(w["bytes"][window[at + k], d]) * float(w["filters"][k, d, f])
                best = max(best, total)
            pooled.append(max(best + float(w["shift"][f]), 0.0))
        z = [sum(p * float(w["out"][f, c]) for f, p in enumerate(pooled)) + float(w["bias"][c]) for c in range(3)]
        e = np.exp(np.array(z) - max(z))
        assert got == pytest.approx(e / e.sum(), rel=1e-4)


def test_weights_multiply_the_loss():
    rng = np.random.default_rng(6)
    net = language.ByteConvNet(["x", "y"])
    windows, labels = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8), rng.integers(0, 2, 5)
    twice = np.array([2, 1, 0, 1, 1], np.float32)
    weighted = net.gradients(windows, labels, twice)
    again = [0, 0, 1, 3, 4]
    repeated = net.gradients(windows[again], labels[again])
    assert all(np.allclose(weighted[k], repeated[k], atol=1e-6) for k in weighted)


def test_a_long_text_is_learned_from_whole(spark):
    """What tells two languages apart stands only near the end of long texts."""
    filler = "zz yy xx ww " * 2_000
    rows = [(k, filler + (" qaqa qaqa" if k % 2 else " vivi vivi") * (40 + k), "ab"[k % 2]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language.train(docs)
    assert net.predict([b"qaqa " * 30, b"vivi " * 30])[0] == ["b", "a"]
