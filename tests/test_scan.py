"""Segmented scans against plain windows, with one object that holds all rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from basinframe.operators import catalogue, samples
from basinframe.operators.scan import ranged


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(8)
    data = [("all", k, draw.choice([None, 1.5, 2.0, -3.0])) for k in range(3000)]
    data += [(g, draw.choice([None, *range(20)]), draw.choice([None, 0.5])) for g in ("few", None, "é") for _ in range(40)] + [("few", 3, 0.5)] * 9
    return spark.createDataFrame(data, "g string, k int, v double").repartition(6).cache()


def test_one_object_is_spread_over_ranges(rows):
    dealt = ranged(rows, ["g"], ["k"])
    assert dealt.rows.where("g = 'all'").select("range_no").distinct().count() >= 4
    got = dealt.numbered("at").where("g = 'all'").select("k", "at").collect()
    assert sorted((r.k, r["at"]) for r in got) == [(k, k) for k in range(3000)]
    for g, n in ((None, 40), ("few", 49)):
        at = [r["at"] for r in dealt.numbered("at").where(F.col("g").eqNullSafe(g)).collect()]
        assert sorted(at) == list(range(n))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_sums_and_greatest(rows, inclusive):
    frame = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    one = rows.where("g = 'all'")
    for by in (F.sum, F.max):
        want = {r.k: r.x for r in one.select("k", by("v").over(frame).alias("x")).collect()}
        got = {r.k: r.x for r in ranged(rows, ["g"], ["k"]).running({"x": F.col("v")}, inclusive, by).where("g = 'all'").collect()}
        assert got == ({k: x or 0.0 for k, x in want.items()} if by is F.sum and not inclusive else want)


def test_previous_and_last_present(rows):
    dealt, one = ranged(rows, ["g"], ["k"]), rows.where("g = 'all'")
    w = Window.partitionBy("g").orderBy("k")
    want = {r.k: r.x for r in one.select("k", F.lag("v").over(w).alias("x")).collect()}
    assert {r.k: r.was for r in dealt.previous({"was": F.col("v")}).where("g = 'all'").collect()} == want
    want = {r.k: r.x for r in one.select("k", F.last("v", ignorenulls=True).over(w).alias("x")).collect()}
    assert {r.k: r.last for r in dealt.previous({"last": F.col("v")}, F.col("v").isNotNull()).where("g = 'all'").collect()} == want


def test_operators_over_one_object(rows):
    one = rows.where("g = 'all'")
    got = {(r.start, r.length, r.v) for r in samples.runs(one, ["g"], ["k"], "v", "k").collect()}
    want, data = set(), [r.v for r in one.orderBy("k").collect()]
    start = 0
    for k in range(1, len(data) + 1):
        if k == len(data) or data[k] != data[start]:
            want.add((start, k - start, data[start]))
            start = k
    assert got == want
    assert sorted(r.k for r in samples.decimated(one, ["g"], ["k"], 100).collect()) == sorted({*range(0, 3000, 30), 2999})


def test_empty(spark, rows):
    dealt = ranged(rows.limit(0), ["g"], ["k"])
    assert dealt.numbered("at").collect() == [] and dealt.previous({"was": F.col("v")}).collect() == []


def test_a_long_chain_takes_few_rounds(spark):
    n = 100_000
    chain = spark.range(n).select(F.concat(F.lit("c"), "id").alias("a"), F.when(F.col("id") > 0, F.concat(F.lit("c"), F.col("id") - 1)).alias("b"))
    got = catalogue.levels(chain, "a", "b")
    assert got.where(F.col("level") == F.substring("a", 2, 9).cast("int")).count() == n


def brute_levels(edges):
    needs = {}
    for a, b in edges:
        needs.setdefault(a, set()).update([b] if b is not None else [])
    out, busy = {}, set()

    def level(a):
        if a not in needs or a in busy:
            return None
        if a not in out:
            busy.add(a)
            below = [level(b) for b in needs[a]]
            busy.discard(a)
            found = None if None in below else max(below, default=-1) + 1
            if found is None:
                return None
            out[a] = found
        return out[a]

    return {a: level(a) for a in needs}


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_random_graphs(spark, seed):
    draw = random.Random(seed)
    edges = []
    for part in range(12):
        n = draw.randrange(1, 12)
        for k in range(n):
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                edges.append((f"{part}-{k}", f"{part}-{draw.randrange(n) if part % 3 == 0 else draw.randrange(k + 1) - (part % 2)}"))
            edges += [(f"{part}-{k}", None)] * draw.randrange(2)
    got = {r.a: r.level for r in catalogue.levels(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == brute_levels(edges)


def test_following(rows):
    dealt, one = ranged(rows, ["g"], ["k"]), rows.where("g = 'all'")
    w = Window.partitionBy("g").orderBy("k")
    want = {r.k: (r.x, r.last) for r in one.select("k", F.lead("v").over(w).alias("x"), (F.lead("k").over(w).isNull()).alias("last")).collect()}
    got = dealt.following({"next": F.col("v"), "at": F.col("k")})
    assert {r.k: (r.next, r["at"] is None) for r in got.where("g = 'all'").collect()} == want
    for g, n in ((None, 40), ("é", 40), ("few", 49)):
        rest = got.where(F.col("g").eqNullSafe(g)).collect()
        assert len(rest) == n and all(r["at"] is None or r["at"] >= r.k for r in rest if r.k is not None)


def test_levels_broadcast_nothing(spark, monkeypatch):
    plans = []
    settle = catalogue.settle
    monkeypatch.setattr(catalogue, "settle", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df, name))
    edges = spark.createDataFrame([(k, k - 1 if k % 9 else None) for k in range(40)], "c long, p long")
    made = catalogue.contracted(edges, "c", "p", spark.createDataFrame([(3,)], "c long"))
    plans.append(made._jdf.queryExecution().executedPlan().toString())
    assert {r.c: r.level for r in made.collect()}[2] == 2 and len(plans) > 3
    assert not any("Broadcast" in p for p in plans)
