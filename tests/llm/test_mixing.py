import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from basinframe.llm import mixing
from basinframe.llm.common import settle


def level(sizes, weights, most=3):
    """Targets by the rule as it is said: share, stop at ``most`` times the size, share the excess again."""
    total, stopped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[k] for k in stopped)
        free = sum(w for k, w in enumerate(weights) if k not in stopped)
        now = [most * s if k in stopped else Fraction(w * left, free or 1) for k, (s, w) in enumerate(zip(sizes, weights, strict=True))]
        over = {k for k in range(len(sizes)) if k not in stopped and now[k] > most * sizes[k]}
        if not over:
            return now
        stopped |= over


def seats(targets, rooms, n):
    """One seat after the other."""
    out = [0] * len(targets)
    for _ in range(min(n, sum(rooms))):
        open_to = [k for k in range(len(targets)) if out[k] < rooms[k]]
        out[max(open_to, key=lambda k: (targets[k] / (2 * out[k] + 1), -k))] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_quotas_against_one_seat_at_a_time(spark, seed):
    draw = random.Random(seed)
    n = draw.choice([1, 2, 7, 13])
    sizes = [draw.choice([0, 1, 5, 100, 3000]) for _ in range(n)]
    names = [f"s{k:02}" for k in range(n - 1)] + [None]
    rows = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")
    got = {r.source: r for r in mixing.targets(rows).collect()}
    want = level(sizes, [(5, 2, 1)[k % 3] for k in range(n)])
    assert [got[s].target for s in names] == pytest.approx([float(x) for x in want])
    assert sum(got[s].target for s in names) == pytest.approx(sum(sizes))
    rooms = [draw.randrange(40) for _ in range(n)]
    targets = [got[s].target for s in names]
    table = spark.createDataFrame(list(zip(names, targets, rooms, strict=True)), "source string, target double, blocks long")
    for house in (1, 10, 57):
        given = {r.source: r.quota for r in mixing.quotas(table, house).collect()}
        assert [given[s] for s in names] == seats(targets, [r if t else 0 for r, t in zip(rooms, targets, strict=True)], house)
    # a shard has what its seats add to those of the shards before
    shards = mixing.quotas(table, 50, 20).collect()
    for s, house in ((0, 20), (1, 40), (2, 50)):
        upto = {r.source: r.quota for r in mixing.quotas(table, house).collect()}
        for r in (r for r in shards if r.shard == s):
            assert r.seats_before + r.quota == upto[r.source] and r.quota >= 0


def test_words_of_odd_texts(spark):
    texts = ["", None, " \t\n", "one", " a  b\x0b\x0c c\r", "é x y", "x" * 300_000 + " y", "a\n" * 50_000]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.words(F.col("t")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_mix_of_odd_rows(spark):
    text = " ".join("abcdefgh" * 20)
    rows = [(k, text[: 2 * (k % 90)], "abc"[k % 3], 1) for k in range(600)]
    rows += [(7, text, "a", 1)] * 50 + [(None, None, None, 1), (None, text, None, 2), (9, "", "empty", 3), (1000, text * 40, "tiny", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int").repartition(7)
    sized = settle(mixing.sized(docs), "sizes")
    plan = settle(mixing.plan(sized), "plan")
    got = mixing.mixed(sized, plan).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((r[0] or -1, len((r[1] or "").split())) for r in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target, r.source_size])[0] += r.taken
    assert all(abs(taken - target) <= mixing.BLOCK for taken, target, _ in by.values())
    # the slices are the same mix, in shards of equal blocks
    parts = mixing.slices(sized, plan, shard_blocks=100).collect()
    taken = {}
    for p in parts:
        assert p.words > 0
        taken[p.source, p.doc_id] = taken.get((p.source, p.doc_id), 0) + p.words
    want = {}
    for r in got:
        if r.taken:
            want[r.source, r.doc_id] = want.get((r.source, r.doc_id), 0) + r.taken
    assert taken == want
    blocks = {}
    for p in parts:
        blocks.setdefault(p.shard, set()).add((p.source, p.block))
    assert all(len(v) == 100 for k, v in blocks.items() if k < max(blocks))
    again = mixing.mixed(settle(mixing.sized(docs.repartition(3)), "again"), plan).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    sized = settle(mixing.sized(docs), "sizes")
    assert mixing.mixed(sized, mixing.plan(sized)).collect() == []


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    sized = settle(mixing.sized(docs), "sizes")
    assert [(r.taken, r.target) for r in mixing.mixed(sized, mixing.plan(sized)).collect()] == [(0, 0.0), (0, 0.0)]
