"""Registered queries that run Structured Streaming over fixture tables until all input is read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.dedup import last_wins
from .operators.durable import scratch
from .queries import query
from .streaming import attempts


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet" if not sf.endswith("/") else "*").parquet(sf)


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    """Final rows of a query: every micro-batch is written to the shared folder; in complete mode the last one counts, in update mode each key's last row."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")
    keep = "overwrite" if mode == "complete" else "append"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode(keep).parquet(f"{path}/rows")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/rows")
    if mode == "update":
        keys = [c for c in ("run_id", "url", "start", "end") if c in rows.columns]
        rows = last_wins(rows, [F.col(c) for c in keys], [F.col("batch")])
    return rows.drop("batch")


def _attempts(spark, sf):
    e = _stream(spark, sf, "events")
    return e.select(F.col("user_id").alias("run_id"), F.concat(F.lit("u"), (F.col("event_id") % 5).cast("string")).alias("url"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("reason"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("ts").cast("timestamp").alias("at"))


@query("SELECT user_id AS run_id, count(*) AS done, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def stream_live_counts(spark, sf):
    return _drained(attempts.live_counts(_attempts(spark, sf)), "complete")


@query(
    """
    WITH e AS (SELECT user_id AS run_id, 'u' || (event_id % 5) AS url, event_type = 'error' AS bad, ts FROM events),
         l AS (SELECT run_id, url, bad, row_number() OVER (PARTITION BY run_id, url ORDER BY ts DESC) AS k, count(*) OVER g AS attempts, count(*) FILTER (bad) OVER g AS failures FROM e WINDOW g AS (PARTITION BY run_id, url))
    SELECT run_id, url, attempts::INTEGER AS attempts, failures::INTEGER AS failures, NOT bad AND failures > 0 AS resolved FROM l WHERE k = 1"""
)
def stream_failure_state(spark, sf):
    return _drained(attempts.failure_state(_attempts(spark, sf)), "update").select("run_id", "url", "attempts", "failures", "resolved")


@query("SELECT DISTINCT event_id FROM events")
def stream_new_cards(spark, sf):
    e = _stream(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    return _drained(attempts.new_cards(e, "event_id", "at", "40 days"), "append").select("event_id")


@query("SELECT date_trunc('day', ts) AS day, count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def stream_windowed_counts(spark, sf):
    counts = _drained(attempts.windowed_counts(_attempts(spark, sf), "at", "1 day", "40 days"), "update")
    return counts.select(F.to_timestamp_ntz(F.date_format("start", "yyyy-MM-dd HH:mm:ss")).alias("day"), "ok", "failed")
