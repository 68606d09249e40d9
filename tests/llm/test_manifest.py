import hashlib
import random
import zlib

import pytest

from basinframe.llm import manifest
from basinframe.llm.manifest import Stack, digest


def levels_of(leaves, fanout):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
    return out


def climb(levels, i, value, fanout):
    """(siblings, root) of a leaf, level by level."""
    siblings = []
    for level in levels[:-1]:
        run = i - i % fanout
        left, right = level[run:i], level[i + 1 : run + fanout]
        siblings += left + right
        value = digest("".join([*left, value, *right]))
        i //= fanout
    return siblings, value


def brute(rows, fanout):
    trees = {}
    for tree, own, leaf, tampered in rows:
        trees.setdefault(tree, []).append((own is None, own or 0, leaf, tampered))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    own = {t: levels_of([x[2] for x in sorted(trees[t], key=lambda x: x[:3])], fanout) for t in names}
    over = levels_of([own[t][-1][0] for t in names], fanout)
    out = []
    for at, t in enumerate(names):
        for i, (none, k, leaf, tampered) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            low, top = climb(own[t], i, tampered or leaf, fanout)
            high, _ = climb(over, at, own[t][-1][0], fanout)
            folded = climb(over, at, top, fanout)[1]
            out.append((None if none else k, leaf, own[t][-1][0], over[-1][0], digest("".join(low + high)), folded, folded == over[-1][0]))
    return out


@pytest.mark.parametrize(("fanout", "levels"), [(2, 12), (2, 2), (3, 1), (5, 2)])
def test_against_levels_in_memory(spark, fanout, levels):
    draw = random.Random(fanout * 10 + levels)
    rows = []
    for tree, n in (("en", 400), ("de", 33), ("", 1), (None, 7), ("é", 2), ("f\u0000", 26)):
        for k in range(n):
            leaf = digest(f"{tree} {k}")
            rows.append((tree, draw.choice([k, k, k // 2, None]), leaf, digest("bad" + leaf) if k % 7 == 0 else None))
    rows += [("en", 5, digest("same"), None)] * 40
    leaves = spark.createDataFrame([(*r, "clash") for r in rows], "tree string, id long, leaf string, tampered string, idx string").repartition(6)
    got = [tuple(r) for r in manifest.manifest(leaves, fanout, levels).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, fanout)))


def test_stack_leaves_what_edges_cut():
    leaves = [digest(str(k)) for k in range(23)]
    levels = levels_of(leaves, 2)
    for lo in range(23):
        for hi in range(lo + 1, 24):
            out = []
            stack = Stack(23, 2, 3, lambda *node: out.append(node))
            for k in range(lo, hi):
                stack.push(0, k, leaves[k])
            stack.close()
            assert all(levels[level][idx] == value for level, idx, value in out)
            covered = sorted(i for level, idx, _ in out for i in range(idx << level, min((idx + 1) << level, 23)))
            assert covered == list(range(lo, hi))
            assert len(out) <= 6 + (hi - lo) // 8


def test_one_leaf_and_none(spark):
    schema = "tree string, id long, leaf string, tampered string"
    one = spark.createDataFrame([("en", 1, digest("x"), None)], schema)
    assert [tuple(r) for r in manifest.manifest(one).collect()] == [(1, digest("x"), digest("x"), digest("x"), digest(""), digest("x"), True)]
    assert manifest.manifest(one.limit(0)).collect() == []


def test_record_digests_and_tampering(spark, tmp_path):
    rows = [(k, f"t é {k}", "en", None, 2**63 - 1 if k == 1 else k) for k in range(60)] + [(None, None, None, "s", None), (77, "", "", "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in manifest.op12_manifest(spark, str(tmp_path)).collect()}
    for k, text, lang, source, n in rows:
        spelt = "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (k, source, lang, n, text))
        assert got[k].leaf == hashlib.sha256(spelt.encode()).hexdigest()
        assert got[k].verified == (k is None or n is None or zlib.crc32(str(k).encode()) % 7 != 0)


def test_node_records_hold_all_leaves(spark):
    leaves = spark.createDataFrame([("", k, digest(str(k))) for k in range(50)], "tree string, id long, digest string")
    rows, sizes = manifest.indexed(leaves, ["id"])
    got = manifest.node_records(rows.drop("n"), sizes).collect()
    assert sorted(r.idx for r in got if r.level == 0) == list(range(50))
    levels = levels_of([digest(str(k)) for k in range(50)], 2)
    assert all(levels[r.level][r.idx] == r.digest for r in got)
