import random

import numpy as np
import pytest

from basinframe.llm import linking, minhash, simhash
from basinframe.llm.wordhash import different, jaccard


def copies(n, words, changed, seed=3):
    """Texts that each have some other words of one text changed."""
    rng, out = random.Random(seed), []
    for k in range(n):
        one = [f"w{j}" for j in range(words)]
        for at in rng.sample(range(words), changed):
            one[at] = f"x{k}.{at}"
        out.append(" ".join(one))
    return out


def test_sketches_never_rule_out_a_likeness_that_holds():
    texts = [b"", b" ", b"one", b"a b c d e f a b c d e f"]
    for size, changed in ((40, 1), (170, 2), (600, 12), (4000, 60)):
        texts += [t.encode() for t in copies(8, size, changed, size)]
    rows = linking.sketches(*different(texts))
    exact = np.array([[jaccard(a, b) for b in texts] for a in texts])
    for threshold in (0.5, 0.8, 1.0):
        assert not ((exact >= threshold) & ~linking.may_reach(rows, rows, threshold)).any()
    assert (rows.shape, linking.may_reach(rows[:0], rows, 0.8).shape) == ((len(texts), linking.SKETCH), (0, len(texts)))


@pytest.mark.parametrize("classes", [minhash.near_duplicates, simhash.near_copies])
def test_pairs_of_a_group_just_below_the_likeness_are_not_checked_one_by_one(spark, monkeypatch, classes):
    """Texts whose 1,770 pairs all have likenesses of some 0.7, and one text that is like the first."""
    texts = copies(60, 230, 4, seed=8)
    texts.append(texts[0] + " end")
    checked, before = [], linking._checked

    def counted(near, own, threshold):
        made, n = before(near, own, threshold)
        checked.append(n)
        return made, n

    monkeypatch.setattr(linking, "_checked", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in classes(docs).collect()}
    assert found == {k: k for k in range(60)} | {60: 0}
    assert sum(checked) < 2 * len(texts)
