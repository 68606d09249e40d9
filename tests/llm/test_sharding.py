import zlib

import pytest
from pyspark.sql import functions as F

from basinframe.llm import sharding
from basinframe.llm.sharding import TREE, Tree


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(8000).withColumn("key", F.col("id").cast("string")).cache()


def placed(keys, tree):
    return {r.id: r.s for r in sharding.place(keys, F.col("key"), tree, "s").collect()}


def test_shares_follow_weights(keys):
    tree = TREE.weighted({0: 3.0})
    counts = [list(placed(keys, tree).values()).count(k) for k in range(8)]
    assert counts[0] == pytest.approx(2400, rel=0.1)
    assert all(c == pytest.approx(800, rel=0.15) for c in counts[1:])


def test_one_more_shard_takes_rows_only_into_itself(keys):
    for tree in (TREE, TREE.grown(), Tree.regular(1, 1, 3)):
        before, after = placed(keys, tree), placed(keys, tree.grown())
        new = max(s.number for s in tree.shards) + 1
        moved = [k for k in before if before[k] != after[k]]
        assert moved and all(after[k] == new for k in moved)
        assert len(moved) == pytest.approx(8000 / (new + 1), rel=0.15)


def test_movement_stays_in_changed_subtrees(keys):
    before, after = placed(keys, TREE), placed(keys, TREE.weighted({0: 2.0, 1: 0.5}))
    moved = [k for k in before if before[k] != after[k]]
    # rack 0 of region 0 grew by 0.5: rows enter it from elsewhere, or move inside it
    assert moved and all(after[k] in (0, 1, 2, 3) for k in moved)
    assert all(after[k] in (0, 1) for k in moved if before[k] in (2, 3))
    same = placed(keys, TREE.weighted({0: 1.5, 1: 0.5}))
    assert all(before[k] in (0, 1) and same[k] in (0, 1) for k in before if before[k] != same[k])


def test_rows_sizes_and_slots(spark):
    rows = [(k, f"text é {k % 7}") for k in range(300)] + [(5, "again")] * 400 + [(None, None), (None, "x"), (301, ""), (302, "y" * 200_000)]
    docs = spark.createDataFrame([(*r, 9, "clash") for r in rows], "doc_id long, text string, shard int, salt string").repartition(5)
    got = sharding.sharded(docs, TREE, grown=TREE.grown()).collect()
    assert len(got) == len(rows)
    want = sorted((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in got) == want
    for k in range(8):
        own = sorted((r for r in got if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order = [(r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in own]
        assert order == sorted(order)
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert sharding.sharded(docs.limit(0), TREE).collect() == []
