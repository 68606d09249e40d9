"""Binary containers as node tables.

A container is an LZ4 envelope (independent blocks) around framed documents of binary XML in the public [MC-NBFX] layout. Spark
reads files as binary rows and spreads them; a task decodes one container at a time into flat rows, so a project's containers are as
parallel as they are many, and a bad one is a row with a status, not a failed job.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats: magic bytes, frame marks and record types.
LZ4_MAGIC, FRAME_MAGIC = b"LZ4\x01", b"BXML\x01"
PROJECT_MAGIC, PROJECT_NAME, PROJECT_FIELDS = b"\xff\xff\x01\x00", b"ProjectSerializer", 9
FRAME_BODY, FRAME_DICTIONARY, FRAME_END = 0xA0, 0xA1, 0xA2
END, COMMENT, ARRAY = 0x01, 0x02, 0x03
ATTRIBUTE, DICTIONARY_ATTRIBUTE, ELEMENT, DICTIONARY_ELEMENT = 0x04, 0x06, 0x40, 0x42
NAMESPACE, DICTIONARY_NAMESPACE, LIST, LIST_END = 0x08, 0x0A, 0xA4, 0xA6
NUMBERS = {0x88: "b", 0x8A: "h", 0x8C: "i", 0x8E: "q", 0x90: "f", 0x92: "d", 0xB2: "Q"}
CONSTANTS = {0x80: ("int", "0"), 0x82: ("int", "1"), 0x84: ("bool", "false"), 0x86: ("bool", "true"), 0xA8: ("text", "")}
LENGTHS = {0x98: (1, "text"), 0x9A: (2, "text"), 0x9C: (4, "text"), 0x9E: (1, "bytes"), 0xA0: (2, "bytes"), 0xA2: (4, "bytes")}
OPAQUE = {0x94: (16, "decimal"), 0xAE: (8, "timespan")}
WIDE_LENGTHS = {0xB6: "B", 0xB8: "H", 0xBA: "I"}
ARRAYS = {0x8A: "<i2", 0x8C: "<i4", 0x8E: "<i8", 0x90: "<f4", 0x92: "<f8", 0xB4: "u1"}

MOST_BYTES = 512 << 20
MOST_BLOCKS = 4096
MOST_DOCUMENT = 128 << 20
MOST_NAMES = 100_000
MOST_NODES = 2_000_000
MOST_DEPTH = 128


class BadContainer(ValueError):
    """Why a container is rejected."""


class Bytes:
    """A bounded walk over bytes."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0

    def take(self, n: int) -> memoryview:
        if n < 0 or self.at + n > len(self.data):
            raise BadContainer("truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self, code: str):
        return struct.unpack(f"<{code}", self.take(struct.calcsize(code)))[0]

    def varint(self) -> int:
        out = 0
        for shift in range(0, 35, 7):
            b = self.byte()
            out |= (b & 127) << shift
            if b < 128:
                return out
        raise BadContainer("varint")

    def text(self) -> str:
        return str(self.take(self.varint()), "utf-8")

    def left(self) -> int:
        return len(self.data) - self.at


def unblocked(block: bytes, most: int) -> bytes:
    """One raw LZ4 block."""
    src, out = Bytes(block), bytearray()

    def length(n: int) -> int:
        if n == 15:
            while True:
                b = src.byte()
                n += b
                if b < 255:
                    break
        return n

    while src.left():
        token = src.byte()
        out += src.take(length(token >> 4))
        if src.left():
            back, n = src.number("H"), length(token & 15) + 4
            if not 0 < back <= len(out):
                raise BadContainer("match before the start")
            while n:  # a match may overlap what it writes
                part = out[len(out) - back : len(out) - back + n]
                out += part
                n -= len(part)
        if len(out) > most:
            raise BadContainer("too long")
    return bytes(out)


def unwrapped(raw: bytes, most: int = MOST_BYTES) -> bytes:
    """The payload of an envelope, which a project file has behind a header of its own; other bytes are their own payload."""
    if raw[:4] == PROJECT_MAGIC:
        head = Bytes(raw)
        head.take(4)
        if bytes(head.take(head.number("H"))) != PROJECT_NAME:
            raise BadContainer("header of another serializer")
        head.take(PROJECT_FIELDS)
        raw = raw[head.at :]
        if raw[:4] != LZ4_MAGIC:
            raise BadContainer("project header without an envelope")
    if raw[:4] != LZ4_MAGIC:
        return raw
    src, out, blocks = Bytes(raw[4:]), bytearray(), 0
    while src.left():
        blocks += 1
        if blocks > MOST_BLOCKS:
            raise BadContainer("too many blocks")
        size = src.number("I")
        src.number("I")
        out += unblocked(bytes(src.take(size)), most - len(out))
    return bytes(out)


def documents(payload: bytes) -> Iterator[tuple[bytes, list[str]]]:
    """Each framed document with the names of its dictionary so far. The last one may end without its mark."""
    src = Bytes(payload)
    if bytes(src.take(len(FRAME_MAGIC))) != FRAME_MAGIC:
        raise BadContainer("no frame")
    names: list[str] = []
    body, seen = bytearray(), set()
    while src.left():
        mark = src.byte()
        if mark == FRAME_DICTIONARY:
            name = src.text()
            if not name or name in seen or len(names) >= MOST_NAMES:
                raise BadContainer("dictionary name")
            names.append(name)
            seen.add(name)
        elif mark == FRAME_BODY:
            n = src.varint()
            if not n or len(body) + n > MOST_DOCUMENT:
                raise BadContainer("document size")
            body += src.take(n)
        elif mark == FRAME_END:
            if not body:
                raise BadContainer("empty document")
            yield bytes(body), names
            body = bytearray()
        else:
            raise BadContainer(f"frame mark {mark:#x}")
    if body:
        yield bytes(body), names


#: 100-ns steps from year 1 to 1970.
_TICKS_1970 = 621_355_968_000_000_000


def _moment(data: bytes) -> str:
    """A date and time record: 62 bits of 100-ns steps since year 1, then its kind (0: unstated, 1: UTC, 2: local)."""
    value = int.from_bytes(data, "little")
    ticks, kind = value & (1 << 62) - 1, value >> 62
    seconds, part = divmod(ticks - _TICKS_1970, 10_000_000)
    try:
        day = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    except OverflowError as why:
        raise BadContainer("date") from why
    return f"{day.isoformat()}.{part:07d}" + ("", "Z", "local", "?")[kind]


def _named(src: Bytes, names: list[str]) -> str:
    key = src.varint()
    if key & 1 or key // 2 >= len(names):
        raise BadContainer("dictionary key")
    return names[key // 2]


def _record(src: Bytes, kind: int, names: list[str]) -> tuple[str, str]:
    """(type, text) of a value record; what has no exact text is hexadecimal."""
    if kind in CONSTANTS:
        return CONSTANTS[kind]
    if kind in NUMBERS:
        code = NUMBERS[kind]
        return ("float" if code in "fd" else "int"), repr(src.number(code))
    if kind in LENGTHS:
        width, what = LENGTHS[kind]
        data = src.take(src.number({1: "B", 2: "H", 4: "I"}[width]))
        return what, str(data, "utf-8") if what == "text" else data.hex()
    if kind == LIST:
        items = []
        while (item := src.byte()) != LIST_END:
            if item & 1 or item == LIST:
                raise BadContainer("list item")
            what, text = _record(src, item, names)
            items.append(text if what in ("int", "float", "bool") else json.dumps(text, ensure_ascii=False))
        return "list", f"[{','.join(items)}]"
    if kind == 0x96:
        return "datetime", _moment(bytes(src.take(8)))
    if kind in OPAQUE:
        return OPAQUE[kind][1], src.take(OPAQUE[kind][0]).hex()
    if kind in WIDE_LENGTHS:
        return "text", str(src.take(src.number(WIDE_LENGTHS[kind])), "utf-16-le")
    if kind == 0xAA:
        return "text", _named(src, names)
    if kind in (0xAC, 0xB0):
        return "uuid", ("urn:uuid:" if kind == 0xAC else "") + str(uuid.UUID(bytes_le=bytes(src.take(16))))
    if kind == 0xB4:
        value = src.byte()
        if value > 1:
            raise BadContainer("boolean")
        return "bool", "true" if value else "false"
    if kind == 0xBC:
        prefix = src.byte()
        if prefix > 25:
            raise BadContainer("prefix")
        return "text", f"{chr(97 + prefix)}:{_named(src, names)}"
    raise BadContainer(f"record {kind:#x}")


def nodes(body: bytes | Bytes, names: list[str], slice_of: int | None = 0) -> Iterator[tuple]:
    """(node, parent, name, type, text, numbers) in document order; attributes are nodes whose name starts with ``@``. With a ``slice_of``, a
    ``begin`` stands before the numbers and a longer array is several rows; None checks arrays without building them."""
    src, path, count = body if isinstance(body, Bytes) else Bytes(body), [], 0
    begun = () if slice_of == 0 else (None,)

    def new() -> int:
        nonlocal count
        count += 1
        if count > MOST_NODES:
            raise BadContainer("too many nodes")
        return count - 1

    while src.left():
        kind = src.byte()
        above = path[-1] if path else None
        if kind == END:
            if not path:
                raise BadContainer("end without a start")
            path.pop()
        elif kind == COMMENT:
            src.text()
        elif kind in (ELEMENT, DICTIONARY_ELEMENT):
            name = src.text() if kind == ELEMENT else _named(src, names)
            path.append(new())
            if len(path) > MOST_DEPTH:
                raise BadContainer("too deep")
            yield path[-1], above, name, "element", None, *begun, None
        elif kind in (ATTRIBUTE, DICTIONARY_ATTRIBUTE):
            name = src.text() if kind == ATTRIBUTE else _named(src, names)
            yield new(), above, f"@{name}", *_record(src, src.byte(), names), *begun, None
        elif kind in (NAMESPACE, DICTIONARY_NAMESPACE):
            yield new(), above, "@xmlns", "text", src.text() if kind == NAMESPACE else _named(src, names), *begun, None
        elif kind == ARRAY:
            if src.byte() != ELEMENT:
                raise BadContainer("array of no element")
            name = src.text()
            if src.byte() != END:
                raise BadContainer("array of a full element")
            form = ARRAYS.get(src.byte() & ~1)
            if form is None:
                raise BadContainer("array type")
            n, width, own = src.varint(), np.dtype(form).itemsize, new()
            if slice_of == 0:
                yield own, above, name, form, None, np.frombuffer(src.take(n * width), form).astype(np.float64)
                continue
            step = slice_of or 1 << 16
            for begin in range(0, max(n, 1), step):
                part = src.take(min(step, n - begin) * width)
                if slice_of:
                    yield own, above, name, form, None, begin, np.frombuffer(part, form).astype(np.float64)
        elif kind >= 0x80:
            yield new(), above, "", *_record(src, kind & ~1, names), *begun, None
            if kind & 1:
                if not path:
                    raise BadContainer("end without a start")
                path.pop()
        else:
            raise BadContainer(f"record {kind:#x}")
    if path:
        raise BadContainer("unfinished element")


_SCHEMA = "path string, document int, node int, parent int, name string, type string, text string, numbers array<double>, status string"
_FIELDS = [
    ("path", pa.string()), ("document", pa.int32()), ("node", pa.int32()), ("parent", pa.int32()), ("name", pa.string()),
    ("type", pa.string()), ("text", pa.string()), ("numbers", pa.list_(pa.float64())), ("status", pa.string()),
]


def _decoded(path: str, raw: bytes | None) -> list[tuple]:
    try:
        if not raw:
            raise BadContainer("empty")
        return [
            (path, k, *node, "ok") for k, (body, names) in enumerate(documents(unwrapped(raw))) for node in nodes(body, names)
        ]
    except (BadContainer, UnicodeDecodeError, IndexError, struct.error) as why:
        return [(path, None, None, None, None, None, None, None, f"rejected: {why}")]


def _decode(batches):
    for batch in batches:
        for path, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = _decoded(path, raw.as_py())
            for k in range(0, len(rows), 50_000):
                columns = zip(*rows[k : k + 50_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def node_table(containers: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Containers as node rows; a container that is rejected is one row with a status, and none of its nodes appear."""
    return containers.select(path, content).mapInArrow(_decode, _SCHEMA)


def read_containers(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files of up to ``MOST_BYTES`` as containers; a longer one is rejected unread and is a row with a status."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    made = node_table(files.where(F.col("length") <= MOST_BYTES))
    long = files.where(F.col("length") > MOST_BYTES).select("path", F.lit(f"rejected: over {MOST_BYTES} bytes").alias("status"))
    return made.unionByName(long, allowMissingColumns=True)


def log_samples(table: DataFrame) -> DataFrame:
    """Well logs of a node table: documents with a depth array ``md`` and a value array ``float_values`` of its length."""
    arrays = table.where("numbers is not null and name in ('md', 'float_values')")
    wide = arrays.groupBy("path", "document").pivot("name", ["md", "float_values"]).agg(F.first("numbers"))
    paired = wide.where(F.size("md") == F.size("float_values"))
    zipped = paired.select("path", "document", F.posexplode(F.arrays_zip("md", "float_values")).alias("sample_index", "z"))
    value = F.col("z.float_values")
    sentinel = value == F.lit(float(np.finfo(np.float32).max))
    return zipped.select("path", "document", "sample_index", F.col("z.md").alias("md"), value.alias("raw_value"), sentinel.alias("is_null"))
