import random

import numpy as np
import pyarrow as pa
import pytest

from basinframe.llm import pseudo
from basinframe.llm.wordhash import word_hashes


def corpus(n=400):
    """Words that follow each other in a fixed cycle: both sides tell the word between."""
    rng = random.Random(2)
    cycle = [f"w{k}" for k in range(40)]
    out = []
    for k in range(n):
        at = rng.randrange(40)
        out.append((k, " ".join(cycle[(at + j) % 40] for j in range(rng.randint(20, 120)))))
    return out


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in corpus()], "doc_id long, text string, lm string").repartition(3)
    return docs, pseudo.train(docs, rounds=3)


def test_counts_cover_all_words(trained):
    docs, _ = trained
    counted = {r.word: r.n for r in pseudo.count_words(docs).collect()}
    want = {}
    for _, text in corpus():
        for h in word_hashes([text.encode()])[0].view(np.int64).tolist():
            want[h] = want.get(h, 0) + 1
    assert counted == want


def test_order_makes_likely(spark, trained):
    _, model = trained
    words = corpus(1)[0][1].split()
    shuffled = words[:]
    random.Random(1).shuffle(shuffled)
    rows = [(1, " ".join(words)), (2, " ".join(shuffled)), (3, None), (4, ""), (5, "never seen"), (6, "w1 " * 40_000), (1, " ".join(words))]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, LM string, key int")
    scored = pseudo.score(docs, model)
    assert scored.columns == ["doc_id", "text", "key", "lm"] and scored.count() == len(rows)
    got = {r.doc_id: r.lm for r in scored.collect()}
    assert got[1].n_words == got[2].n_words == len(words)
    assert got[1].log_likelihood > got[2].log_likelihood + len(words) / 2
    assert (got[3].n_words, got[3].log_likelihood, got[4].n_words) == (0, 0.0, 0)
    assert got[5].n_words == 2 and got[6].n_words == 40_000 and got[6].log_likelihood < 0
    assert pseudo.score(docs.limit(0), model).collect() == []


def plain(model, text):
    """The score of a text, word by word."""
    numbering, w, size = pseudo.Numbering(model.ranked, model.net.size), model.net.weights, model.net.size
    known = dict(zip(model.known.tolist(), model.shares.tolist(), strict=True))
    hashes = word_hashes([text])[0]
    words = numbering.numbers(hashes).tolist()
    padded = [model.net.border] * 2 + words + [model.net.border] * 2
    total = 0.0
    for t, word in enumerate(words):
        h = np.tanh(sum(w["vectors"][padded[t + 2 + k]] * w["places"][i] for i, k in enumerate(pseudo._PLACES)) + w["shift"])
        first, second = h @ w["to_class"] + w["class_bias"], w["to_word"][word // size] @ h + w["word_bias"][word // size]
        total += first[word // size] - np.log(np.exp(first).sum()) + second[word % size] - np.log(np.exp(second).sum())
        if word >= size * size:
            total += known.get(int(hashes[t]), model.others[word % size])
    return total


def test_scores_match_a_plain_loop(spark, trained):
    _, model = trained
    for text in ("w1 w2 w3 unknown w5 w6", "w1", "q q w2 r q"):
        (got,) = pseudo.score(spark.createDataFrame([(text,)], "text string"), model).collect()
        assert got.lm.log_likelihood == pytest.approx(plain(model, text.encode()), rel=1e-4)


@pytest.mark.parametrize("known", [1 << 20, 80, 64])
def test_words_without_a_number_share_their_bucket(spark, monkeypatch, known):
    monkeypatch.setattr(pseudo, "KNOWN", known)
    rng = random.Random(6)
    texts = [" ".join(f"v{int(rng.expovariate(0.01))}" for _ in range(50)) for _ in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    model = pseudo.train(docs, rounds=1)
    counts = {r.word % 2**64: r.n for r in pseudo.count_words(docs).collect()}
    size = model.net.size
    own = {w % 2**64 for w in model.ranked.tolist()}
    rest = {w: n for w, n in counts.items() if w not in own}
    assert len(own) <= size * size == 64 and rest and (known < 64 + len(rest) or len(model.known) == len(rest))
    assert min(counts[w] for w in own) >= max(rest.values())
    buckets = {}
    for w in rest:
        buckets.setdefault((w >> 48) % size, []).append(w)
    for b, words in buckets.items():
        shares = np.exp(model.share(np.array(words, np.uint64)))
        assert shares.sum() == pytest.approx(1, rel=1e-5)  # all words of a bucket
        for w, share in zip(words, shares, strict=True):
            if w in set(model.known.tolist()):
                assert share == pytest.approx(rest[w] / sum(rest[x] for x in words), rel=1e-5)
    (got,) = pseudo.score(docs.limit(1), model).collect()
    assert got.lm.log_likelihood == pytest.approx(plain(model, got.text.encode()), rel=1e-4)


def test_partitions_do_not_change_scores(spark, monkeypatch):
    monkeypatch.setattr(pseudo, "GROUP_WORDS", 2000)  # some 14 groups
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    found = []
    was = spark.conf.get("spark.sql.shuffle.partitions")
    for n in (2, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        model = pseudo.train(docs.repartition(n), doc_id="doc_id")
        found.append((model.net.flat(), {r.doc_id: r.lm.log_likelihood for r in pseudo.score(docs, model).collect()}))
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert (found[0][0] == found[1][0]).all() and found[0][1] == pytest.approx(found[1][1], abs=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = pseudo.WindowNet(8)
    words, around = rng.integers(0, 72, 40), rng.integers(0, 73, (4, 40)).astype(np.int32)
    for w in net.weights.values():
        w += rng.normal(0, 0.2, w.shape).astype(np.float32)
    made = net.gradients(around, words)
    for name, w in net.weights.items():
        for _ in range(6):
            at = tuple(rng.integers(0, k) for k in w.shape)
            was, sides = w[at], []
            for step in (0.01, -0.01):
                w[at] = was + step
                sides.append(-net.log_probabilities(around, words).astype(np.float64).mean())
            w[at] = was
            assert made[name][at] == pytest.approx((sides[0] - sides[1]) / 0.02, abs=2e-3), name


def test_size_follows_the_corpus():
    assert [pseudo.classes_for(n) for n in (0, 4096, 4097, 15_000_000, 10**12)] == [8, 8, 8, 32, 256]


def test_windows_do_not_cross_texts():
    numbering = pseudo.Numbering(np.zeros(0, np.int64), 8)
    _, around = numbering.windows(np.array([5, 6, 7], np.int32), np.array([0, 2, 2, 3]))
    out = numbering.border
    assert around.T.tolist() == [[out, out, 6, out], [out, 5, out, out], [out] * 4]


def test_probabilities_sum_to_one():
    net = pseudo.WindowNet(16)
    n = 17 * 16
    around = np.tile(np.array([[1], [2], [3], [4]]), (1, n))
    assert np.exp(net.log_probabilities(around, np.arange(n))).sum() == pytest.approx(1, rel=1e-4)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    model = pseudo.train(docs)
    assert len(model.ranked) == 0
    assert [r.lm.log_likelihood for r in pseudo.score(docs, model).collect()] == [0.0, 0.0]


def test_rounds_train_on_every_position_once(spark, monkeypatch):
    texts = ["a b c d e f g h i j k", "l m", "n", "", None]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    seen, copies = [], pseudo._copies
    numbers = [np.arange(len((t or "").split()), dtype=np.uint16).tobytes() for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 1, 1, 2]), pa.array(numbers, pa.binary())], names=["group", "words"])

    def counted(*args):
        seen.append(sum(b.column(1)[0].as_py() for b in copies(*args)([batch])))
        return copies(*args)

    monkeypatch.setattr(pseudo, "_copies", counted)
    pseudo.train(docs)
    assert sum(seen) == 14
    numbering, words, first = pseudo.Numbering(np.zeros(0, np.int64), 8), np.arange(8, dtype=np.int32), np.array([0, 8])
    parts = [numbering.windows(words, first, 3, turn)[0].tolist() for turn in range(3)]
    assert sorted(sum(parts, [])) == words.tolist()


def test_one_word_leaves_a_round_without_positions(spark):
    assert len(pseudo.train(spark.createDataFrame([(1, "word")], "doc_id long, text string")).ranked) == 1
