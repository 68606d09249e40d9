"""Write, read back; stream, compare with the batch result."""

import pytest
from pyspark.sql import functions as F

from basinframe.sources import sinks
from basinframe.streaming import events

SF = "/root/testdata/sf0.001"


def test_snapshot_pointer_moves(spark, tmp_path):
    target = str(tmp_path / "t")
    assert sinks.published(spark, target) is None
    sinks.publish(spark.range(3).toDF("k"), target, "one")
    assert sinks.published(spark, target).count() == 3
    spark.range(9).write.parquet(f"{target}/unfinished")  # no pointer: not seen
    assert sinks.published(spark, target).count() == 3
    sinks.publish(spark.range(4).toDF("k"), target, "before")  # by number, not by name or time
    sinks.publish(spark.range(5).toDF("k"), target, "a")
    assert sinks.published(spark, target).count() == 5
    with pytest.raises(Exception, match="exist"):
        sinks.publish(spark.range(1).toDF("k"), target, "a")
    assert sinks.published(spark, target).count() == 5


def test_empty_tables_are_not_written(spark, tmp_path):
    path = str(tmp_path / "x")
    assert sinks.write_if_any(spark.range(2).toDF("k"), path)
    assert not sinks.write_if_any(spark.range(0).toDF("k"), path)
    assert not (tmp_path / "x").exists()


def test_read_back(spark, tmp_path):
    d = spark.createDataFrame([(1, 0.1), (1, 0.1), (2, float("nan")), (3, None)], "k int, v double")
    d.write.parquet(str(tmp_path / "p"))
    assert sinks.read_back_equal(d, spark.read.parquet(str(tmp_path / "p")))
    assert not sinks.read_back_equal(d, d.distinct())
    a = sinks.write_jsonl(d, str(tmp_path / "j")).first()
    b = sinks.write_jsonl(d.repartition(3), str(tmp_path / "j2")).first()
    assert a.rows == 4 and a.sha256 == b.sha256
    assert sinks.write_jsonl(d.distinct(), str(tmp_path / "j3")).first().sha256 != a.sha256
    assert sinks.write_jsonl(d.limit(0), str(tmp_path / "j4")).first().rows == 0
    assert sinks.write_by_object(d, "k", str(tmp_path / "o"))


def test_grids_as_text(spark):
    nodes = [(i, j, 10.0 * i, 5.0 * j, float(i + j) if (i, j) != (1, 1) else None, (i, j) != (0, 2)) for i in range(2) for j in range(3)]
    d = spark.createDataFrame([*nodes, (1, 2, 10.0, 10.0, float("nan"), True)][:6], "i int, j int, x double, y double, raw double, defined boolean")
    assert sorted(r.line for r in sinks.xyz_lines(d, "x", "y", "raw", "defined").collect()) == ["0.0 0.0 0.0", "0.0 5.0 1.0", "10.0 0.0 1.0", "10.0 10.0 3.0"]
    head = sinks.zmap_head(d, "g").first()
    assert head["code"] == -1e30 and "\n3, 2, 0.0, 10.0, 0.0, 10.0\n" in head["head"] and head["head"].startswith("@g HEADER, GRID, 5\n")
    big = d.withColumn("raw", F.lit(5e31))
    assert sinks.zmap_head(big, "g").first()["code"] == -1e32


def test_numbers_that_json_cannot_spell(spark):
    d = spark.createDataFrame([(1.5,), (float("nan"),), (float("-inf"),), (None,)], "v double")
    assert [r[0] for r in d.select(sinks.typed_number(F.col("v"))).collect()] == ["1.5", '{"non_finite":"NaN"}', '{"non_finite":"-Infinity"}', "null"]


def test_null_codes_are_free(spark):
    data = [([1.0, None],), ([-999.25, 5.0],), ([-999.25, -99925.0, 1e9],), ([-999.25, 1e300],), ([],)]
    d = spark.createDataFrame(data, "v array<double>")
    got = [r[0] for r in d.select(sinks.null_code(F.col("v"), -999.25)).collect()]
    assert got[0] == -999.25 and got[1] == -9992.5 and got[4] == -999.25
    assert all(g not in v[0] and abs(g) > max(map(abs, v[0])) for g, v in zip(got[2:4], data[2:4]))


def test_las_round_trip(spark):
    d = spark.createDataFrame([("w", 1.0, 5.0), ("w", 1.5, None), ("w", 2.0, -999.25), ("v", 3.0, 1.0)], "well string, md double, v double")
    las = sinks.las_lines(d, "well", "md", "v")
    text = {r.well: r.las for r in las.collect()}
    assert "NULL. -9992.5 :" in text["w"] and "STEP. 0.5 :" in text["w"] and "STEP. 0.0 :" in text["v"]
    back = sinks.read_las(las, "well", "las")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, d.collect()), key=str)


def test_zmap_head_and_body_agree(spark):
    inf, nan = float("inf"), float("nan")
    schema = "i int, j int, x double, y double, raw double, defined boolean"
    values = [5e31, -10.0, -1e30, 7.0, nan, inf, -inf, None]
    nodes = spark.createDataFrame([(i, j, 1.0 * i, 2.0 * j, values[(i * 7 + j) % 8], (i, j) != (1, 6)) for i in range(2) for j in range(7) if (i, j) != (0, 3)], schema)
    head = sinks.zmap_head(nodes, "g").first()
    assert head.code == -1e32 and head["head"].split("\n")[0].endswith("GRID, 5") and "-1.0E32" in head["head"].split("\n")[1]
    lines = {(r.i, r.k): [float(x) for x in r.line.split()] for r in sinks.zmap_lines(nodes, sinks.zmap_head(nodes, "g")).collect()}
    assert {k: len(v) for k, v in lines.items()} == {(0, 0): 5, (0, 1): 2, (1, 0): 5, (1, 1): 2}

    def stated(i, j):
        v = values[(i * 7 + j) % 8]
        return -1e32 if (i, j) in ((1, 6), (0, 3)) or v in (None, inf, -inf) or v != v else v

    for i in range(2):
        assert lines[i, 0] + lines[i, 1] == [stated(i, j) for j in range(6, -1, -1)]
    plain = spark.createDataFrame([(0, 0, 0.0, 0.0, 1.0, True), (0, 1, 0.0, 1.0, 2.0, True), (1, 0, 1.0, 0.0, 3.0, False), (1, 1, 1.0, 1.0, 4.0, True)], schema)
    assert {r.i: r.line for r in sinks.zmap_lines(plain, sinks.zmap_head(plain, "z")).collect()} == {0: "2.0 1.0", 1: "4.0 -1.0E30"}
    empty = plain.where("i < 0")
    assert sinks.zmap_lines(empty, sinks.zmap_head(empty, "z")).collect() == []



@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "events")
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(4).write.parquet(path)
    return path, e


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streamed_windows_match_batch(spark, folder):
    path, e = folder
    stream = events.with_event_time(events.read_events(spark, path, e.schema), "ts", "40 days")
    got = run(events.tumbling(stream, "ts", ["event_type"], "value", "1 hour"), "tumbling", "complete").select("window_start", "event_type", "n", "total")
    batch = events.tumbling(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 hour")
    assert sinks.read_back_equal(got, batch.select("window_start", "event_type", "n", "total"))


def test_repeated_events_are_dropped(spark, folder, tmp_path):
    _, e = folder
    path = str(tmp_path / "twice")
    e.union(e).write.parquet(path)
    stream = events.with_event_time(events.read_events(spark, path, e.schema), "ts", "40 days")
    assert run(events.first_of_each(stream, ["event_id"]), "firsts").count() == e.count()


def test_retry_state_across_batches(spark, tmp_path):
    path = tmp_path / "retries"
    data = [(1, 1, True), (1, 2, True), (2, 1, True), (1, 3, False), (2, 2, False), (2, 3, True)]
    for k, part in enumerate((data[:3], data[3:])):
        spark.createDataFrame(part, "id long, seq long, bad boolean").coalesce(1).write.mode("append").parquet(str(path))
    stream = events.read_events(spark, str(path), "id long, seq long, bad boolean", files_per_trigger=1)
    got = run(events.retry_state(stream, "id", "seq", F.col("bad")), "retries")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 1, 3), (2, 1, 1, 2)]


def test_commits_withdraw_and_restore(spark, tmp_path):
    path = str(tmp_path / "receipts")
    data = [("c", 1, "s", "s"), ("d", 1, "s", "s"), ("c", 2, "s", None), ("d", 2, "s", "bad"), ("d", 3, "s", "s")]
    schema = "commit string, at long, declared string, found string"
    spark.createDataFrame(data, schema).write.parquet(path)
    got = run(events.commit_states(events.read_events(spark, path, schema), "commit", "at"), "commits", "complete")
    assert {r.commit: r.status for r in got.collect()} == {"c": "withdrawn", "d": "accepted"}


def test_merge_commits_keeps_the_newest(spark, tmp_path):
    merge = events.merge_commits(str(tmp_path / "m"), "k", "at")
    schema = "k string, at long, v string"
    merge(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema), 0)
    merge(spark.createDataFrame([("a", 2, "z")], schema), 1)
    merge(spark.createDataFrame([("a", 2, "z")], schema), 1)
    assert sorted(tuple(r) for r in sinks.published(spark, str(tmp_path / "m")).collect()) == [("a", 2, "z"), ("b", 1, "y")]


def test_frames_among_other_lines(spark):
    d = spark.createDataFrame([('EVENT {"a": 1}',), ("noise",), ("EVENT {broken",), (None,)], "line string")
    assert [r.event and r.event.a for r in events.framed(d, "line", "EVENT ", "a int").collect()] == [1, None, None, None]


def test_scratch_tables_are_released(spark):
    from basinframe.sources import scratch

    scratch.release(spark)
    back = scratch.settle(spark.range(3).toDF("k"), "t")
    assert back.count() == 3
    assert scratch.release(spark) == 1 and scratch.release(spark) == 0
    with pytest.raises(Exception, match="(?i)not exist|no such file|FILE_NOT_EXIST"):
        back.collect()
