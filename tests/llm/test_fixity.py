import random

import pytest

from basinframe.llm import fixity

SCHEMA = "replica string, file string, at long, length long, digest string, node string"


def made(spark, a, b):
    rows = [("a", *r, "clash") for r in a] + [("b", *r, "clash") for r in b]
    return spark.createDataFrame(rows, SCHEMA)


def slow(a, b):
    first, second = {(r[0], r[1]): r for r in a}, {(r[0], r[1]): r for r in b}
    out = [(*r, "intact" if second.get(k) == r else "corrupt" if k in second else "missing") for k, r in first.items()]
    return sorted(out + [(*r, "extra") for k, r in second.items() if k not in first])


@pytest.fixture(scope="module")
def replicas():
    rng = random.Random(8)
    a = []
    for f in ("x", "y", "z", "only a"):
        at = 0
        for k in range(rng.randint(140, 200)):
            size = rng.choice([1, 50, 900, 7_000])
            a.append((f, at, size, f"{f}{k}"))
            at += size
    b = [r for r in a if r[0] != "only a"]
    for k in (3, 50, 51, 120):
        b[k] = (*b[k][:3], "damaged")
    del b[70], b[10]
    return a, [*b, ("x", 1 << 30, 5, "tail"), ("only b", 0, 9, "new")]


@pytest.mark.parametrize(("span", "fanout"), [(1 << 16, 16), (20_000, 4), (1 << 40, 4)])
def test_finds_what_a_full_compare_finds(spark, replicas, span, fanout):
    got = fixity.audit(made(spark, *replicas), span, fanout).collect()
    assert sorted(tuple(r) for r in got) == slow(*replicas)


def test_equal_replicas_differ_nowhere_and_only_bad_branches_are_opened(spark, replicas):
    a, _ = replicas
    levels = fixity.trees(fixity.distinct_records(made(spark, a, a)), 50_000, 4)
    assert fixity.differing_leaves(levels, 4).count() == 0
    bad = [a[0][:3] + ("bad",), *a[1:]]
    levels = fixity.trees(fixity.distinct_records(made(spark, a, bad)), 50_000, 4)
    assert [tuple(r) for r in fixity.differing_leaves(levels, 4).collect()] == [(a[0][0], 0)]


def test_repeated_rows_and_empty_tables(spark):
    row = ("f", 0, 3, "d")
    got = fixity.audit(made(spark, [row, row], [row])).collect()
    assert [r.status for r in got] == ["corrupt"]  # a copy too many is a difference
    assert fixity.audit(made(spark, [], [])).collect() == []


def test_query_over_odd_pages(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>{k}é</p>") for k in range(600)] + [(600, None, None), (None, "u", "h"), (601, "", ""), (602, "v", "x" * 300_000)]
    spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, length int").write.parquet(f"{tmp_path}/pages.parquet")
    got = fixity.op1_fixity(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.status for r in got} == {"intact", "corrupt", "missing"}
