"""Containers are packed here, decoded by the library and compared."""

import struct

import numpy as np
import pytest

from basinframe.sources import containers as C


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def string(s):
    return varint(len(s.encode())) + s.encode()


def element(name, *inside):
    return b"\x40" + string(name) + b"".join(inside) + b"\x01"


def array(name, values, code):
    form = C.ARRAYS[code]
    return b"\x03\x40" + string(name) + b"\x01" + bytes([code | 1]) + varint(len(values)) + np.array(values, form).tobytes()


def frame(*bodies, split=None, names=()):
    out = C.FRAME_MAGIC + b"".join(bytes([C.FRAME_DICTIONARY]) + string(n) for n in names)
    for body in bodies:
        parts = [body[:split], body[split:]] if split else [body]
        out += b"".join(b"\xa0" + varint(len(p)) + p for p in parts) + b"\xa2"
    return out


def literal(data):
    head = bytes([min(len(data), 15) << 4])
    n = len(data) - 15
    while n >= 0:
        head += bytes([min(n, 255)])
        n -= 255
    return head + data


def envelope(payload, size=37):
    blocks = [literal(payload[k : k + size]) for k in range(0, len(payload), size)]
    return C.LZ4_MAGIC + b"".join(struct.pack("<II", len(b), 0) + b for b in blocks)


MD, VALUES = [10.25, 11.25, 13.25], [1.25, float(np.finfo(np.float32).max), 2.5]
LOG = element("log", b"\x04" + string("v") + b"\x8c" + struct.pack("<i", 7), array("md", MD, 0x92), array("float_values", VALUES, 0x90))


def test_log_samples_from_files(spark, tmp_path):
    (tmp_path / "good.bin").write_bytes(envelope(frame(LOG, LOG, split=9)))
    (tmp_path / "plain.bin").write_bytes(frame(LOG))
    (tmp_path / "cut.bin").write_bytes(envelope(frame(LOG))[:-3])
    (tmp_path / "none.bin").write_bytes(b"")
    table = C.read_containers(spark, str(tmp_path), "*.bin")
    bad = {r.path.rsplit("/", 1)[1]: r.status for r in table.where("status <> 'ok'").collect()}
    assert set(bad) == {"cut.bin"}  # Spark lists no empty files
    empty = spark.createDataFrame([("p", bytearray(b"")), ("q", None)], "path string, content binary")
    assert {r.status for r in C.node_table(empty).collect()} == {"rejected: empty"}
    got = C.log_samples(table).collect()
    assert len(got) == 9
    assert sorted({(r.md, r.is_null) for r in got}) == [(10.25, False), (11.25, True), (13.25, False)]


def test_nodes_keep_order_parents_and_types():
    body = element(
        "a", b"\x42" + varint(0) + b"\x98" + string("é")[:0] + bytes([2]) + "é".encode() + b"\x01", b"\x02" + string("note"),
        element("n", b"\x92" + struct.pack("<d", 0.1)), b"\x40" + string("t") + b"\x87", b"\x40" + string("u") + b"\xb0" + bytes(range(16)) + b"\x01",
    )
    got = [x for b, names in C.documents(frame(body, names=["first"])) for x in C.nodes(b, names)]
    assert [(x[1], x[2], x[3], x[4]) for x in got] == [
        (None, "a", "element", None), (0, "first", "element", None), (1, "", "text", "é"), (0, "n", "element", None), (3, "", "float", "0.1"),
        (0, "t", "element", None), (5, "", "bool", "true"), (0, "u", "element", None), (7, "", "uuid", "03020100-0504-0706-0809-0a0b0c0d0e0f"),
    ]


def test_lz4_matches_may_overlap():
    assert C.unblocked(b"\x1fa\x01\x00\x05" + b"\x10b", 100) == b"a" * 25 + b"b"
    for bad in (b"\x10a\x05\x00", b"\xf0\xff"):
        with pytest.raises(C.BadContainer):
            C.unblocked(bad, 100)
    with pytest.raises(C.BadContainer):
        C.unblocked(b"\x1fa\x01\x00\xff\xff\x00", 100)


@pytest.mark.parametrize("bad", [b"\x01", b"\x40\x01a", b"\x77", b"\x40\x01a\x84", b"\x03\x40\x01a\x01\x77\x01", element("a") * 0 + b"\x40\x01a" * 200])
def test_bad_documents_are_rejected(bad):
    with pytest.raises((C.BadContainer, IndexError)):
        list(C.nodes(bad, []))


def test_bad_frames_are_rejected():
    for bad in (b"", b"XXXXX", C.FRAME_MAGIC + b"\xa2", C.FRAME_MAGIC + b"\xa0\x05ab", C.FRAME_MAGIC + b"\xa0\x00", C.FRAME_MAGIC + b"\x00", C.FRAME_MAGIC + b"\xa1\x00", C.FRAME_MAGIC + b"\xa1\x01a\xa1\x01a"):
        with pytest.raises(C.BadContainer):
            list(C.documents(bad))


def project(payload):
    return C.PROJECT_MAGIC + struct.pack("<H", len(C.PROJECT_NAME)) + C.PROJECT_NAME + bytes(9) + payload


def test_project_files_have_a_header(spark, tmp_path, monkeypatch):
    (tmp_path / "p.bin").write_bytes(project(envelope(frame(LOG))))
    (tmp_path / "open.bin").write_bytes(envelope(frame(LOG)[:-1]))  # its last document ends without a mark
    (tmp_path / "other.bin").write_bytes(project(b"no envelope"))
    (tmp_path / "name.bin").write_bytes(project(envelope(frame(LOG))).replace(b"ProjectS", b"projectS"))
    (tmp_path / "long.bin").write_bytes(bytes(5000))
    monkeypatch.setattr(C, "MOST_BYTES", 4000)
    table = C.read_containers(spark, str(tmp_path), "*.bin")
    status = {r.path.rsplit("/", 1)[1]: r.status for r in table.select("path", "status").distinct().collect()}
    assert {k: v.split(":")[0] for k, v in status.items()} == {"p.bin": "ok", "open.bin": "ok", "other.bin": "rejected", "name.bin": "rejected", "long.bin": "rejected"}
    assert C.log_samples(table).count() == 6


def test_values_of_all_kinds():
    ticks = 638_000_000_123_456_789
    cases = [
        (b"\x96" + struct.pack("<Q", ticks | 1 << 62), "datetime", "2022-09-28T22:13:32.3456789Z"),
        (b"\xb6\x04" + "é!".encode("utf-16-le"), "text", "é!"), (b"\xbc\x01\x00", "text", "b:first"),
        (b"\xac" + bytes(16), "uuid", "urn:uuid:00000000-0000-0000-0000-000000000000"), (b"\xae" + bytes(8), "timespan", "00" * 8),
    ]
    for raw, kind, text in cases:
        (found,) = [x for x in C.nodes(element("a", raw), ["first"]) if x[1] is not None]
        assert found[3:5] == (kind, text)
    for bad in (b"\xb4\x02", b"\xbc\x1a\x00", b"\xaa\x01", b"\xaa\x08"):
        with pytest.raises(C.BadContainer):
            list(C.nodes(element("a", bad), ["first"]))
