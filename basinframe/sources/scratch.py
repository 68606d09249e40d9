"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions that name no shared folder, by application.
_OWN: dict[str, str] = {}
#: Folders that this process has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session that names none (a test) gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not named:
        master = spark.sparkContext.master
        if "cluster" in master or not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="basinframe-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        _OWN[spark.sparkContext.applicationId] = named
    return named.rstrip("/")


def written(df: DataFrame, name: str, by: Sequence[str] = ()) -> str:
    """The path of ``df`` written as a table in the shared folder, partitioned ``by`` columns."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/basinframe-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(folder)
    df.write.partitionBy(*by).parquet(f"{folder}/{name}")
    return f"{folder}/{name}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost executor costs a
    reread only."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def discard(spark: SparkSession, path: str) -> None:
    """Delete one table that ``written`` has made, when all that was computed from it has been written itself."""
    folder = path.rsplit("/", 1)[0]
    _WRITTEN.get(spark.sparkContext.applicationId, []).remove(folder)
    _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> int:
    """Delete the tables that ``settle`` has written for this application, and say how many. Call it when no result that reads
    them is needed any more; a long session otherwise keeps them all."""
    folders = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        _delete(spark, folder)
    return len(folders)
