"""Event streams. Each function takes a streaming (or batch) DataFrame and returns one; the caller starts the query."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import exact_sum
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of event files as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def with_event_time(events: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as an instant, with a watermark. Zoneless timestamps are read in the session's time zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def first_of_each(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each identity; state is dropped behind the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def tumbling(events: DataFrame, ts: str, keys: list[str], value: str, size: str, slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window; sliding if ``slide`` is given."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = events.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), exact_sum(F.col(value)).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str) -> DataFrame:
    out = events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def retry_state(events: DataFrame, identity: str, order: str, failed: Column) -> DataFrame:
    """Runs of failures, emitted when a success ends them: (identity, failures, first, last). An identity's state is two numbers
    and a count; events of one identity must come in order across batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, first = state.get if state.exists else (0, -1)
        out: list[tuple[Any, ...]] = []
        rows = pd.concat(list(batches)).sort_values("seq")
        for seq, bad in zip(rows["seq"], rows["failed"], strict=True):
            if bad:
                failures, first = failures + 1, int(seq) if failures == 0 else first
            elif failures:
                out.append((key[0], failures, first, int(seq)))
                failures, first = 0, -1
        state.update((failures, first))
        yield pd.DataFrame(out, columns=["identity", "failures", "first", "recovered_at"])

    rows = events.select(F.col(identity).cast("long").alias("identity"), F.col(order).cast("long").alias("seq"), failed.alias("failed"))
    return rows.groupBy("identity").applyInPandasWithState(
        step,
        "identity long, failures long, first long, recovered_at long",
        "failures long, first long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def commit_states(receipts: DataFrame, key: str, order: str) -> DataFrame:
    """The newest receipt of each commit in update mode: ``accepted`` while its artifact is there with the declared signature, else
    ``withdrawn`` until a later receipt restores it."""
    newest = F.max_by(F.struct("declared", "found"), order).alias("r")
    status = F.when(F.col("r.found").eqNullSafe(F.col("r.declared")) & F.col("r.found").isNotNull(), "accepted").otherwise("withdrawn")
    return receipts.groupBy(key).agg(newest, F.max(order).alias("at")).select(key, "at", status.alias("status"))


def withdraw_failed(rows: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """Rows without the objects that failed; a failure that names no object withdraws all rows. One row tells the latter."""
    anything = failures.agg(F.coalesce(F.bool_or(F.col(key).isNull()), F.lit(False)).alias("all_fail"))
    kept = rows.join(failures.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
    return kept.crossJoin(F.broadcast(anything)).where("not all_fail").drop("all_fail")  # one row


def framed(lines: DataFrame, text: str, prefix: str, schema: str) -> DataFrame:
    """Events that child processes print as JSON behind a prefix, among other lines; other lines have a null event."""
    body = F.regexp_extract(F.col(text), rf"^{prefix}(\{{.*\}})\s*$", 1)
    return lines.withColumn("event", F.from_json(F.nullif(body, F.lit("")), schema))


def merge_commits(target: str, key: str, order: str):
    """A ``foreachBatch`` function that keeps the newest row of each key in the table at ``target``: it reads the last snapshot, writes the
    next beside it and then moves the pointer; a batch that is run twice is merged twice, which changes nothing."""
    from ..sources.sinks import publish, published

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = published(spark, target)
        rows = batch if base is None else base.unionByName(batch)
        rest = [c for c in rows.columns if c != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])
        publish(newest, target, f"batch-{number:012d}-{uuid.uuid4().hex}")

    return merge
