import random
import re

import numpy as np
import pytest
import xxhash

from basinframe.llm import simhash

SCHEMA = "doc_id long, text string, fp string, component_id int, anchor string"


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for k, (doc_id, _) in zip(label, rows, strict=True):
        if doc_id is not None:
            least[k] = min(least.get(k, doc_id), doc_id)
    return sorted(((d, p, least.get(k)) for (d, _), p, k in zip(rows, prints, label, strict=True)), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeÉß") for _ in range(rng.randint(1, 6)))
    out = [(k, " ".join(word() for _ in range(rng.randint(1, 60)))) for k in range(60)]
    base = " ".join(word() for _ in range(400)).split()
    for k in range(60, 90):  # near copies: a word or two changed
        changed = list(base)
        for _ in range(rng.randint(0, 2)):
            changed[rng.randrange(400)] = word()
        out.append((k, " ".join(changed)))
    out += [(90, None), (91, ""), (92, " \t\n"), (93, "A b"), (94, "a B"), (95, "one"), (None, "one"), (None, "lonely text here")]
    out += [(96, "x " * 50_000), (97, "x " * 50_000), (5, out[5][1]), (5, out[5][1])]
    return out


def made(spark, rows):
    return spark.createDataFrame([(d, t, "clash", 7, None) for d, t in rows], SCHEMA)


def test_components_match_brute_force(spark, rows):
    got = simhash.near_duplicates(made(spark, rows)).collect()
    found = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str)
    assert found == slow_components(rows)


def five_words(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_classes(texts, least=0.8):
    """The index of the first text of each one's class."""
    sets, label = [five_words(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if label[i] != label[j] and (len(x & y) >= least * len(x | y) if x | y else True):
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    return label


def slow_first(rows):
    """The (doc_id, text) that stays of each class; of texts of one doc_id any may."""
    label, best = slow_classes([t for _, t in rows]), {}
    for k, (d, t) in zip(label, rows, strict=True):
        best.setdefault(k, []).append((d is None, d, t or ""))
    least = [sorted(b, key=lambda x: (x[0], x[1] or 0))[0][:2] for b in best.values()]
    return sorted((d for _, d in least), key=str)


def test_near_copies_match_brute_force(spark, rows):
    label = slow_classes([t for _, t in rows])
    least = {}
    for k, (d, _) in zip(label, rows, strict=True):
        if d is not None:
            least[k] = min(least.get(k, d), d)
    got = simhash.near_copies(made(spark, rows)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == sorted(((d, least.get(k)) for k, (d, _) in zip(label, rows, strict=True)), key=str)


def test_keep_first_keeps_one_of_each_class(spark, rows):
    kept = simhash.keep_first(made(spark, rows))
    assert kept.columns == ["doc_id", "text", "fp", "component_id", "anchor"]
    assert sorted((r.doc_id for r in kept.collect()), key=str) == slow_first(rows)


def test_keep_first_goes_by_rows(spark):
    """A doc_id that several texts share neither keeps a copy nor takes another text with it."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(1, a), (2, a), (2, b), (5, c), (5, d), (None, a), (None, "alone"), (None, "alone"), (5, c)]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (2, b), (5, c), (5, d), (None, "alone")], key=str)
    wide = [(1, a, {"x": k}, k) for k in range(5)]
    one = simhash.keep_first(spark.createDataFrame(wide, "doc_id long, text string, kept_key map<string,int>, n int").repartition(3)).collect()
    assert [r.n for r in one] == [0]


def two_close_groups():
    """Two texts of a likeness of 0.801 and 40 copies of each two words away: of all pairs between the groups that one passes, and it is not the likeliest by estimate."""
    first = [f"w{k}" for k in range(1000)]
    second = list(first)
    for j in range(22):
        second[20 + j * 44] = f"y{j}"
    out = []
    for words, tag in ((first, "p"), (second, "q")):
        out.append(" ".join(words))
        for k in range(40):
            copy = list(words)
            copy[(k * 5) % 980 + 7], copy[(k * 5 + 411) % 980 + 9] = f"{tag}a{k}", f"{tag}b{k}"
            out.append(" ".join(copy))
    return out


def test_two_close_groups_are_linked_by_their_only_pair(spark):
    docs = spark.createDataFrame(list(enumerate(two_close_groups())), "doc_id long, text string")
    assert {r.class_id for r in simhash.near_copies(docs).collect()} == {0}


def test_codewords_cover_all_words_within_three_bits():
    x = np.random.default_rng(3).integers(0, 1 << 23, 20_000).astype(np.uint32)
    c = simhash.codewords(x)
    assert np.bitwise_count(c ^ x).max() <= 3 and (simhash.codewords(c) == c).all()
    assert len(np.unique(simhash.codewords(np.arange(1 << 23, dtype=np.uint32)))) == 1 << 12


def test_near_copies_share_an_anchor():
    rng, met, pairs = random.Random(5), 0, 0
    for _ in range(60):
        base = [f"w{rng.random()}" for _ in range(120)]
        texts = [list(base), list(base)]
        for at in rng.sample(range(120), 2):
            texts[1][at] = f"x{rng.random()}"
        texts = [" ".join(t).encode() for t in texts]
        if len(five_words(texts[0].decode()) & five_words(texts[1].decode())) >= 0.8 * len(five_words(texts[0].decode()) | five_words(texts[1].decode())):
            pairs += 1
            a, b = simhash.anchors_of_blocks(simhash.wide_leads(texts)[0])
            met += bool(set(a.tolist()) & set(b.tolist()))
    assert pairs > 20 and met >= 0.95 * pairs


def test_wide_fingerprints_count_each_shingle_once():
    text = "a b c d e f g h a b c d e f"
    words = text.split()
    hashes = np.unique(np.concatenate([simhash.shingles_of([" ".join(words[k : k + 5]).encode()])[0] for k in range(10)]))
    counts = simhash._bits(hashes).astype(int).sum(axis=0)
    leads, sizes = simhash.wide_leads([text.encode(), b"", b"one", (text + " x") .encode() * 300])
    assert sizes.tolist()[:3] == [8, 0, 1] and len(hashes) == 8
    tie = simhash._bits(hashes[:1])[0]
    assert (leads[0] == 2 * (2 * counts + tie - 8) - 1).all() and (leads[1] < 0).all()


def test_empty_table(spark):
    empty = made(spark, []).select("doc_id", "text")
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_first(empty).collect() == []


def test_anchors_meet_for_every_pair_in_reach():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 31, 200, dtype=np.uint64)
    for bit in range(31):
        y = x ^ np.uint64(1 << bit)
        a, b = simhash.anchors_of(x), simhash.anchors_of(y)
        assert all(set(p.tolist()) & set(q.tolist()) for p, q in zip(a, b, strict=True))
    assert (np.bitwise_count(simhash.anchors_of(x) ^ x[:, None]) <= 2).all()


def test_midpoints_link_like_pairs():
    rng = np.random.default_rng(2)
    fps = np.unique(np.uint64(77) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64)))
    groups = [simhash._roots(len(fps), *f(fps)).tolist() for f in (simhash.links_by_pairs, simhash.links_by_midpoints)]
    assert groups[0] == groups[1]


def test_large_buckets_and_batch_borders_link_alike(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    fps = np.unique(rng.integers(0, 1 << 12, 900, dtype=np.int64))
    anchors = np.sort(np.repeat(np.arange(3), -(-len(fps) // 3))[: len(fps)])
    def edges(size):
        batches = [
            pa.RecordBatch.from_arrays([pa.array(anchors[k : k + size]), pa.array(fps[k : k + size])], names=["anchor", "fp"])
            for k in range(0, len(fps), size)
        ]
        return {(a, b) for t in simhash._compare(iter(batches)) for a, b in zip(*(c.to_pylist() for c in t.columns), strict=True)}

    def classes(found):
        index = {v: k for k, v in enumerate(fps.tolist())}
        a, b = (np.array([index[e[k]] for e in found], int) for k in (0, 1))
        return simhash._roots(len(fps), a, b).tolist()

    whole = classes(edges(len(fps)))
    assert classes(edges(7)) == whole
    monkeypatch.setattr(simhash, "PAIRWISE", 2)
    assert classes(edges(50)) == whole
