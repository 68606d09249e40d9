"""Streamed containers against whole ones."""

import random
import struct
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from basinframe.sources import containers as C
from basinframe.sources import streamed as S
from basinframe.sources.scratch import settle

from .test_containers import LOG, array, element, envelope, frame, string, varint


def whole(rows):
    """Slices put together, as rows of ``node_table``."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.path, r.status, r.document or 0, r.node or 0, r.begin or 0)):
        key = (r.path, r.document, r.node, r.parent, r.name, r.type, r.text, r.status)
        out[key] = out.get(key, [] if r.numbers is not None else None)
        if r.numbers is not None:
            out[key] = out[key] + list(r.numbers)
    return sorted(((*k, v) for k, v in out.items()), key=str)


def plain(rows):
    return sorted(((r.path, r.document, r.node, r.parent, r.name, r.type, r.text, r.status, None if r.numbers is None else list(r.numbers)) for r in rows), key=str)


def packed():
    draw = random.Random(3)
    many = [element(f"d{k}", b"\x42\x00\x99\x01x" if k % 3 else b"", array("v", [draw.random() for _ in range(draw.randrange(200))], 0x92)) for k in range(40)]
    late = C.FRAME_MAGIC + b"".join(bytes([C.FRAME_DICTIONARY]) + string(f"n{k}") + b"\xa0" + bytes([len(b)]) + b + b"\xa2" for k, b in ((k, b"\x42" + bytes([2 * k]) + b"\x01") for k in range(9)))
    yield "many", envelope(frame(*many, names=["first"]), 100)
    yield "plain", frame(LOG, LOG, split=9)
    yield "late", envelope(late, 5)
    yield "open", envelope(frame(LOG)[:-1])
    yield "empty_array", frame(element("a", array("v", [], 0x90)))
    head = C.PROJECT_MAGIC + struct.pack("<H", len(C.PROJECT_NAME)) + C.PROJECT_NAME + bytes(C.PROJECT_FIELDS)
    yield "project", head + envelope(frame(LOG))
    yield "nothing", frame()


def broken():
    yield "cut", envelope(frame(LOG, LOG))[:-3]
    yield "mark", frame(LOG) + b"\x07"
    yield "second", frame(LOG, element("x") + b"\x01")
    yield "end", frame(LOG) + b"\xa2"
    yield "magic", b"nothing of ours"
    yield "head", C.PROJECT_MAGIC + struct.pack("<H", 3) + b"abc"
    yield "none", b""
    yield "null", None


@pytest.mark.parametrize(("run_bytes", "slice_of"), [(1, 7), (500, 64), (1 << 20, 1 << 16)])
def test_rows_are_those_of_whole_containers(spark, run_bytes, slice_of):
    rows = [(n, None if b is None else bytearray(b)) for n, b in [*packed(), *broken()]]
    table = spark.createDataFrame(rows, "path string, content binary").repartition(4)
    found = settle(S.runs(table, run_bytes=run_bytes), "runs")
    got, want = S.streamed(table, found, slice_of=slice_of).collect(), C.node_table(table).collect()
    good = {n for n, _ in packed()}
    assert whole(r for r in got if r.status == "ok") == plain(r for r in want if r.status == "ok")
    assert {r.path for r in got if r.status == "ok"} <= good
    bad = {r.path: r.status for r in got if r.status != "ok"}
    assert set(bad) == {n for n, _ in broken()} and all(s.startswith("rejected: ") for s in bad.values())
    assert max(len(r.numbers) for r in got if r.numbers is not None) <= slice_of
    if run_bytes == 1:
        assert found.where("path = 'many'").count() == 40


def test_files_and_log_samples(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(envelope(frame(LOG, LOG, split=9)))
    (tmp_path / "b.bin").write_bytes(frame(LOG))
    (tmp_path / "c.bin").write_bytes(envelope(frame(LOG))[:-3])
    got = S.read_streamed(spark, str(tmp_path), "*.bin", slice_of=2)
    assert [r.path.rsplit("/", 1)[1] for r in got.where("status <> 'ok'").collect()] == ["c.bin"]
    want = C.log_samples(C.read_containers(spark, str(tmp_path), "*.bin"))
    assert sorted(map(tuple, S.streamed_log_samples(got).collect())) == sorted(map(tuple, want.collect()))


_SMALL = """
import resource, sys
sys.path.insert(0, {repo!r})
import pyarrow as pa
from basinframe.sources import streamed as S
resource.setrlimit(resource.RLIMIT_AS, ({limit}, {limit}))
n = 0
runs = [r for b in S._run_rows(32 << 20, False)([pa.RecordBatch.from_arrays([pa.array([{path!r}])], names=["path"])]) for r in b.to_pylist()]
assert all(r["status"] == "ok" for r in runs), runs[0]["status"]
for r in runs:
    one = pa.RecordBatch.from_arrays([pa.array([r[c]], t) for c, t in (("path", pa.string()), ("document", pa.int32()), ("documents", pa.int32()),
        ("offset", pa.int64()), ("skip", pa.int64()), ("names", pa.list_(pa.string())))], names=list("pdoskn"))
    for b in S._parse(1 << 16, False)([one]):
        n += sum(len(x) for x in b.column(8).to_pylist() if x is not None)
print(len(runs), n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_container_of_400_mb_in_a_small_worker(tmp_path):
    values = np.arange(6_250_000, dtype="<f8")
    body = b"\x40" + string("log") + b"\x03\x40" + string("md") + b"\x01\x93" + varint(len(values)) + values.tobytes() + b"\x01"
    path = tmp_path / "large.bin"
    with path.open("wb") as out:
        out.write(C.FRAME_MAGIC)
        for _ in range(8):
            out.write(b"\xa0" + varint(len(body)) + body + b"\xa2")
    assert path.stat().st_size > 400_000_000
    code = _SMALL.format(repo=str(Path(__file__).resolve().parent.parent), limit=2 << 30, path=str(path))
    made = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env={"OPENBLAS_NUM_THREADS": "1", "PATH": "/usr/bin", "OMP_NUM_THREADS": "1"})
    assert made.stdout, made.stderr[-500:]
    found, numbers, megabytes = map(int, made.stdout.split())
    assert (found, numbers) == (8, 8 * len(values)) and megabytes < 400


def test_a_run_carries_its_own_blocks(spark):
    """Not a copy of its container for each run of it, which grows with the square of the container."""
    many = envelope(frame(*[element(f"d{k}", array("v", range(100), 0x92)) for k in range(40)]), 100)
    table = spark.createDataFrame([("many", bytearray(many)), ("plain", bytearray(frame(LOG, LOG)))], "path string, content binary")
    found = settle(S.runs(table, run_bytes=1), "runs")
    runs = found.where("path = 'many'").collect()
    assert len(runs) == 40 and sum(r.until - r.offset for r in runs) < len(many) + 40 * 2 * 150
    assert all(r.until <= len(many) for r in runs)
    assert whole(S.streamed(table, found).collect()) == plain(C.node_table(table).collect())
