"""Streams over the event files, run to their end with what is available, and read back as tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir
from ..streaming import events as E
from .base import Plans

P = Plans()


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream; a glob makes a table of one file a folder of files."""
    return E.read_events(spark, f"{d}/events*.parquet", spark.read.parquet(f"{d}/events.parquet").schema)


def _finished(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all files there are. Each batch is written under its number, so one that is run again replaces itself."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/basinframe-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out" if mode == "complete" else f"{root}/out/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(*stream.columns)


@P.query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total FROM events GROUP BY ALL""")
def stream_hourly_counts(spark, d):
    """Tumbling windows of the stream, in complete mode."""
    timed = E.with_event_time(_events(spark, d), "ts", "1 hour")
    out = _finished(E.tumbling(timed, "ts", ["event_type"], "value", "1 hour"), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@P.query("""SELECT event_id, user_id, event_type FROM events""")
def stream_first_events(spark, d):
    """Events read twice and kept once each."""
    timed = E.with_event_time(_events(spark, d).union(_events(spark, d)), "ts", "1 day")
    return _finished(E.first_of_each(timed, ["event_id"]).select("event_id", "user_id", "event_type"), "append")


@P.query("""WITH m AS (SELECT user_id, event_id, event_type = 'error' AS failed FROM events), r AS (SELECT *, coalesce(sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM m)
SELECT user_id AS identity, count(*) FILTER (failed) AS failures, min(event_id) FILTER (failed) AS "first", max(event_id) AS recovered_at FROM r GROUP BY user_id, run HAVING count(*) FILTER (failed) > 0 AND NOT bool_and(failed)""")
def stream_retries(spark, d):
    """Runs of failures that a success ended, from state per identity."""
    return _finished(E.retry_state(_events(spark, d), "user_id", "event_id", F.col("event_type") == "error"), "append")


@P.query("""SELECT user_id, max(event_id) AS at, CASE WHEN arg_max(event_type, event_id) = 'error' THEN 'withdrawn' ELSE 'accepted' END AS status FROM events GROUP BY user_id""")
def stream_commit_states(spark, d):
    """The newest receipt of each commit decides whether it is accepted."""
    e = _events(spark, d)
    receipts = e.select("user_id", "event_id", F.lit("ok").alias("declared"), F.when(F.col("event_type") != "error", "ok").alias("found"))
    return _finished(E.commit_states(receipts, "user_id", "event_id"), "complete")
