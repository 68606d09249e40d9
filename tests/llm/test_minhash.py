import hashlib
import random

import numpy as np
import pytest

from basinframe.llm import linking, minhash
from basinframe.llm.wordhash import jaccard


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5)))
    out = [(k, " ".join(word() for _ in range(rng.randint(1, 80)))) for k in range(80)]
    base = [word() for _ in range(200)]
    for k in range(80, 100):
        changed = list(base)
        for _ in range(k % 4):
            changed[rng.randrange(200)] = word()
        out.append((k, " ".join(changed)))
    return [*out, (100, None), (101, ""), (102, "  "), (103, "one two"), (104, "x y z " * 30_000), (105, out[7][1])]


@pytest.mark.parametrize("partitions", [1, 7])
def test_edited_neighbours(spark, partitions):
    made = rows()
    docs = spark.createDataFrame([(d, t, 3) for d, t in made], "doc_id long, text string, h int").repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = {r.doc_id: r for r in minhash.edited_neighbours(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    order = sorted(((d, t or "") for d, t in made), reverse=True)
    assert len(got) == len(order)
    for k, (d, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - alike(text, edited)) < 0.2
        assert abs(r.near_next - alike(text, after)) < 0.2
    assert got[105].fingerprint == got[7].fingerprint and got[100].fingerprint == got[101].fingerprint


def test_ties_nulls_and_single_rows(spark):
    odd = [(1, "a b c"), (1, "a b c"), (1, "d e"), (None, "n u l l"), (None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    assert minhash.edited_neighbours(docs).count() == 5
    one = minhash.edited_neighbours(docs.limit(1)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert minhash.edited_neighbours(docs.limit(0)).collect() == []


def test_signatures_estimate_jaccard_without_bias():
    rng = random.Random(9)
    base = [str(rng.random()) for _ in range(3000)]
    errors = []
    for k in range(20):
        cut = rng.randint(100, 2900)
        a, b = " ".join(base[:cut]), " ".join(base[: cut // (1 + k % 3)])
        errors.append(minhash.likeness(*minhash.signatures([a.encode(), b.encode()])) - alike(a, b))
        assert jaccard(a.encode(), b.encode()) == pytest.approx(alike(a, b))
    assert abs(np.mean(errors)) < 0.03


def test_near_duplicates_match_brute_force(spark):
    made = [*rows(), (None, rows()[85][1])]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in made], "doc_id long, text string, key string")
    label = list(range(len(made)))
    sets = [shingles(t) for _, t in made]
    for i in range(len(made)):
        for j in range(i):
            same = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 if sets[i] | sets[j] else True
            if same and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    least = {}
    for k, (d, _) in zip(label, made, strict=True):
        least[k] = min(least.get(k, 1 << 40), d if d is not None else 1 << 40)
    want = sorted(((d, least[k]) for k, (d, _) in zip(label, made, strict=True)), key=str)
    assert sorted(((r.doc_id, r.class_id) for r in minhash.near_duplicates(docs).collect()), key=str) == want
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_no_link_is_lost_for_another_pair(spark):
    """Groups of copies whose likenesses lie round the threshold: estimates rank a failing pair above a true one."""
    rng = random.Random(11)
    made = []
    for g in range(20):
        base = [f"g{g}w{k}" for k in range(100)]
        for _ in range(12):
            words = list(base)
            for at in rng.sample(range(100), rng.randint(1, 3)):
                words[at] = f"x{rng.random()}"
            made.append((len(made), " ".join(words)))
    sets = [shingles(t) for _, t in made]
    label = list(range(len(made)))
    for i in range(len(made)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if k == high else k for k in label]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert [found[k] for k in range(len(made))] == label


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
    assert {r.class_id for r in minhash.near_duplicates(docs).collect()} == {0}


def test_blocks_of_a_band_meet(spark, monkeypatch):
    monkeypatch.setattr(linking, "TOGETHER", 3)
    test_no_link_is_lost_for_another_pair(spark)


def test_query_tells_the_class_of_each_row(spark, tmp_path):
    made = [*rows(), (None, rows()[85][1]), (7, "another text of seven"), (7, "another text of seven")]
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in made], "doc_id long, text string, raw string, class_id int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = minhash.op3_minhash(spark, str(tmp_path)).collect()
    want = minhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == sorted(((r.doc_id, r.class_id) for r in want), key=str)
    assert len(got) == len(made)
