"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import settle

__all__ = ["bounded", "hex_of", "packed", "settle", "table", "unpacked", "unused"]


#: Bytes of an Arrow batch that goes to a Python worker; texts may be long, and a batch is held several times over there.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Have the session bound Arrow batches by bytes, not by rows alone; a smaller bound of its own stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    digits, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
    if not 0 < int(digits) << 10 * " kmgtp".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def hex_of(column) -> F.Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))


@F.arrow_udf(T.BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    """A column of compressed texts, for a shuffle between two Python workers; null stays null."""
    press = zstandard.ZstdCompressor(level=1).compress
    return pa.array([None if t is None else press(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def unpacked(raw: bytes) -> bytes:
    """The UTF-8 text of a value of ``packed``."""
    return zstandard.ZstdDecompressor().decompress(raw)
