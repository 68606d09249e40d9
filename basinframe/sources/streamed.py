"""Containers read in bounded memory.

``containers.node_table`` takes a container as one row. Here a container is a stream: its envelope is decoded block by block, frames are walked as their bytes arrive, and a
document is parsed while it is read, so a task holds one block, one value and one slice of an array, whatever the container's size.

*Two passes.* ``runs`` walks each container once without building rows: it proves that all of it can be parsed and cuts its documents into runs of about ``RUN_BYTES``, each
with the place of its first block, what to skip of it and the dictionary up to there. ``streamed`` then deals runs to tasks, so one large container is read by many. A
container that can't be parsed to its end is one row with a status and gives no other rows.

Rows are those of ``containers.node_table`` with a ``begin``: a long array is several rows of one node, of ``SLICE`` numbers at most, and ``begin`` is the place of the first; it is null for what is no
array. An empty array is one row. Contents come as a column or, where a table has paths only, from the file through Arrow's file systems.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containers as C
from .containers import BadContainer, Bytes
from .scratch import settle

#: Numbers of a slice, and bytes of documents of a run, about.
SLICE = 1 << 16
RUN_BYTES = 32 << 20
#: Bytes of a plain payload that are read at a time, and rows of an Arrow batch.
CHUNK, ROWS = 1 << 20, 8192
#: Numbers of the arrays of an Arrow batch, about.
NUMBERS = 1 << 18

_RUNS = "path string, status string, document int, documents int, head long, offset long, until long, skip long, names array<string>"
_NODES = "path string, document int, node int, parent int, name string, type string, text string, begin long, numbers array<double>, status string"
_FIELDS = [*C._FIELDS[:7], ("begin", pa.int64()), *C._FIELDS[7:]]


def opened(path: str):
    """A file for reading, of any store that Arrow knows; the form ``file:/x`` is a local path."""
    local = re.sub(r"^file:/+", "/", path)
    system, place = (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


class Blocks:
    """The payload of an envelope, or a plain payload, block by block; ``offset`` is the place in the file of the block that comes next."""

    def __init__(self, file, offset: int | None = None):
        self.file, self.blocks = file, 0
        first = self._start()
        #: Bytes that tell what kind of file this is.
        self.head = max(first, len(C.LZ4_MAGIC))
        self.offset = first if offset is None else offset
        file.seek(self.offset)

    def _start(self) -> int:
        """Where the first block is; sets whether blocks are compressed."""
        self.file.seek(0)
        magic = self.file.read(4)
        at = 0
        if magic == C.PROJECT_MAGIC:
            name = self.file.read(struct.unpack("<H", self._whole(2))[0])
            if name != C.PROJECT_NAME:
                raise BadContainer("header of another serializer")
            self._whole(C.PROJECT_FIELDS)
            at, magic = self.file.tell(), self.file.read(4)
            if magic != C.LZ4_MAGIC:
                raise BadContainer("project header without an envelope")
        self.wrapped = magic == C.LZ4_MAGIC
        return at + len(C.LZ4_MAGIC) if self.wrapped else at

    def _whole(self, n: int) -> bytes:
        data = self.file.read(n)
        if len(data) != n:
            raise BadContainer("truncated")
        return data

    def __iter__(self) -> Iterator[bytes]:
        while True:
            self.at = self.offset
            if self.wrapped:
                head = self.file.read(8)
                if not head:
                    return
                if len(head) != 8:
                    raise BadContainer("truncated")
                self.blocks += 1
                if self.blocks > C.MOST_BLOCKS:
                    raise BadContainer("too many blocks")
                data = C.unblocked(self._whole(struct.unpack("<I", head[:4])[0]), C.MOST_DOCUMENT)
            else:
                data = self.file.read(CHUNK)
                if not data:
                    return
            self.offset = self.file.tell()
            yield data


class Flow(Bytes):
    """A walk over bytes that arrive in parts: ``Bytes`` with a refill."""

    def __init__(self, parts: Iterator[bytes]):
        super().__init__(b"")
        self.parts = parts

    def _refill(self, n: int) -> None:
        held = [self.data[self.at :]]
        size = len(held[0])
        while size < n and (part := next(self.parts, None)) is not None:
            held.append(part)
            size += len(part)
        self.data, self.at = memoryview(b"".join(held)), 0

    def take(self, n: int) -> memoryview:
        if n > len(self.data) - self.at:
            self._refill(n)
        return super().take(n)

    def left(self) -> int:
        if self.at == len(self.data):
            self._refill(1)
        return super().left()


class Payload(Flow):
    """The payload's bytes, with the place of the block that holds the next one."""

    def __init__(self, blocks: Blocks, skip: int = 0):
        self.blocks, self.starts = blocks, []  # (bytes of the payload before a block, its place)
        self.seen = 0
        super().__init__(self._each())
        if skip:
            self.take(skip)

    def _each(self):
        for data in self.blocks:
            self.starts.append((self.seen, self.blocks.at))
            self.seen += len(data)
            yield data

    def place(self) -> tuple[int, int]:
        """(place of the block, bytes to skip) of the next byte."""
        at = self.seen - self.left()
        while len(self.starts) > 1 and self.starts[1][0] <= at:
            self.starts.pop(0)
        return self.starts[0][1], at - self.starts[0][0]


class Frames:
    """Documents of a framed payload, each a stream that must be read to its end before the next."""

    def __init__(self, payload: Payload, names: list[str], first: bool = True):
        self.payload, self.names, self.known, self.size = payload, names, set(names), 0
        if first and bytes(payload.take(len(C.FRAME_MAGIC))) != C.FRAME_MAGIC:
            raise BadContainer("no frame")
        self.before = payload.place() if payload.left() else (0, 0)

    def _body(self) -> Iterator[bytes]:
        """Bodies of one document up to its mark; the last document may end without."""
        src, self.size = self.payload, 0
        while src.left():
            mark = src.byte()
            if mark == C.FRAME_DICTIONARY:
                name = src.text()
                if not name or name in self.known or len(self.names) >= C.MOST_NAMES:
                    raise BadContainer("dictionary name")
                self.names.append(name)
                self.known.add(name)
            elif mark == C.FRAME_BODY:
                n = src.varint()
                self.size += n
                if not n or self.size > C.MOST_DOCUMENT:
                    raise BadContainer("document size")
                while n:
                    part = src.take(min(n, CHUNK))
                    n -= len(part)
                    yield bytes(part)
            elif mark == C.FRAME_END:
                if not self.size:
                    raise BadContainer("empty document")
                return
            else:
                raise BadContainer(f"frame mark {mark:#x}")

    def __iter__(self) -> Iterator[Flow]:
        while self.payload.left():
            self.before, self.named = self.payload.place(), len(self.names)
            document = Flow(self._body())
            if document.left():  # dictionary names alone are no document
                yield document
                if document.left():
                    raise BadContainer("a document that was not read")


def _source(path: str, content: bytes | None, has_content: bool):
    if has_content:
        if not content:
            raise BadContainer("empty")
        return io.BytesIO(content)
    return opened(path)


_ERRORS = (BadContainer, UnicodeDecodeError, IndexError, struct.error, OSError)


def _walked(path: str, file, run_bytes: int) -> list[tuple]:
    blocks = Blocks(file)
    frames = Frames(Payload(blocks), [])
    out, size, k = [], 0, 0
    for document in frames:
        if not out or size >= run_bytes:
            offset, skip = frames.before
            out.append([path, "ok", k, 0, blocks.head, offset, offset, skip, list(frames.names[: frames.named])])
            size = 0
        for _ in C.nodes(document, frames.names, None):
            pass
        out[-1][3] += 1
        out[-1][6] = blocks.offset  # behind the last block that the run needs
        size += frames.size
        k += 1
    return [tuple(x) for x in out]


def _run_rows(run_bytes: int, has_content: bool):
    def walked(batches):
        for batch in batches:
            for i, path in enumerate(batch.column(0).to_pylist()):
                try:
                    rows = _walked(path, _source(path, batch.column(1)[i].as_py() if has_content else None, has_content), run_bytes)
                except _ERRORS as why:
                    rows = [(path, f"rejected: {why}", *[None] * 7)]
                if rows:
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.string()))
                    names = ["path", "status", "document", "documents", "head", "offset", "until", "skip", "names"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return walked


def _parse(slice_of: int, has_content: bool):
    """(path, document, documents, offset, skip, names[, content]) to node rows; a content may be the head and the run's own blocks only."""

    def batch(rows):
        columns = zip(*rows, strict=True)
        made = [pa.array(list(c), t) for c, (_, t) in zip(columns, _FIELDS, strict=True)]
        return pa.RecordBatch.from_arrays(made, names=[n for n, _ in _FIELDS])

    def parsed(batches):
        rows, numbers = [], 0
        for part in batches:
            for i in range(part.num_rows):
                path, first, count, offset, skip, names = (part.column(c)[i].as_py() for c in range(6))
                file = _source(path, part.column(6)[i].as_py() if has_content else None, has_content)
                frames = Frames(Payload(Blocks(file, offset), skip), list(names), first=False)
                for k, document in enumerate(frames):
                    for node, parent, name, kind, text, begin, values in C.nodes(document, frames.names, slice_of):
                        rows.append((path, first + k, node, parent, name, kind, text, begin, values, "ok"))
                        numbers += 0 if values is None else len(values)
                        if len(rows) >= ROWS or numbers >= NUMBERS:
                            yield batch(rows)
                            rows, numbers = [], 0
                    if k + 1 == count:
                        break
        if rows:
            yield batch(rows)

    return parsed


def runs(containers: DataFrame, path: str = "path", content: str | None = "content", run_bytes: int = RUN_BYTES) -> DataFrame:
    """(path, status, document, documents, head, offset, until, skip, names): runs of documents of each container, or why it is rejected. A container without documents has no row."""
    columns = [path] if content is None else [path, content]
    return containers.select(*columns).mapInArrow(_run_rows(run_bytes, content is not None), _RUNS)


def streamed(containers: DataFrame, found: DataFrame, path: str = "path", content: str | None = "content", slice_of: int = SLICE) -> DataFrame:
    """Node rows of the containers whose runs were ``found`` (a written table: it is used twice)."""
    good = found.where("status = 'ok'")
    columns = ["path", "document", "documents", "offset", "skip", "names"]
    if content is None:
        good = good.select(*columns)
    else:  # a run carries its own blocks, not its container
        met = good.join(containers.select(F.col(path).alias("path"), F.col(content).alias("content")), "path")
        cut = lambda start, stop: F.substring("content", (start + 1).cast("int"), (stop - start).cast("int"))
        own = F.concat(cut(F.lit(0), F.col("head")), cut(F.col("offset"), F.col("until")))
        good = met.withColumns({"content": own, "offset": F.col("head")}).select(*columns, "content")
    spread = good.repartition(F.col("path"), F.col("document"))
    made = spread.mapInArrow(_parse(slice_of, content is not None), _NODES)
    return made.unionByName(found.where("status <> 'ok'").select("path", "status"), allowMissingColumns=True)


def read_streamed(spark: SparkSession, folder: str, pattern: str = "*", run_bytes: int = RUN_BYTES, slice_of: int = SLICE) -> DataFrame:
    """Container files of any size as node rows. Only names and lengths are listed by Spark; tasks open the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
    n = max(1, min(files.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = settle(runs(files.repartition(n, "path"), content=None, run_bytes=run_bytes), "runs")
    return streamed(files, found, content=None, slice_of=slice_of)


def streamed_log_samples(table: DataFrame) -> DataFrame:
    """``containers.log_samples`` of streamed rows: slices are numbered by their places and meet by equal place, so no row holds a log."""
    arrays = table.where("numbers is not null and name in ('md', 'float_values')")
    values = arrays.select("path", "document", "name", "begin", F.posexplode("numbers").alias("k", "value"))
    placed = values.select("path", "document", "name", (F.col("begin") + F.col("k")).alias("sample_index"), "value")
    sizes = placed.groupBy("path", "document").agg(
        F.count_if(F.col("name") == "md").alias("n"), F.count_if(F.col("name") == "float_values").alias("m")
    )
    whole = sizes.where("n = m").select("path", "document")
    wide = placed.groupBy("path", "document", "sample_index").agg(
        F.max(F.when(F.col("name") == "md", F.col("value"))).alias("md"), F.max(F.when(F.col("name") == "float_values", F.col("value"))).alias("raw_value")
    )
    sentinel = F.col("raw_value") == F.lit(float(np.finfo(np.float32).max))
    return wide.join(whole, ["path", "document"]).select("path", "document", F.col("sample_index").cast("int").alias("sample_index"), "md", "raw_value", sentinel.alias("is_null"))
