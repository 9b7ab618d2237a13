"""Streaming twins: attempts to failure state, cards without repeats, live counts, last-wins tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "attempts int, failures int, reason string, last_ms long, bad_ms long, good boolean"
OUT = "run_id long, url string, attempts int, failures int, reason string, resolved boolean, retry_at_ms long"


def failure_state(attempts: DataFrame, retries: int = 2, backoff_ms: int = 1000, expire_ms: int | None = None) -> DataFrame:
    """State of each (run, url) after every batch of ``run_id, url, ok, reason, ts_ms`` rows.

    A failure counts and reopens; a success resolves. ``retry_at_ms`` is when to try again: exponential backoff from the last
    failure, null once resolved or after ``retries + 1`` attempts. With ``expire_ms`` state is dropped after that much processing time
    without news, which bounds it; without it the state is running aggregates, so no group costs a call of Python.
    """
    if not expire_ms:
        bad = ~F.col("ok")
        state = attempts.groupBy("run_id", "url").agg(
            F.count(F.lit(1)).cast("int").alias("attempts"), F.count_if(bad).cast("int").alias("failures"),
            F.max(F.when(bad, F.struct("ts_ms", "reason")))["reason"].alias("reason"), F.max(F.struct("ts_ms", "ok")).alias("end"),
        )
        resolved = F.col("end.ok") & (F.col("failures") > 0)
        again = F.when(~resolved & (F.col("failures") > 0) & (F.col("attempts") <= retries), F.col("end.ts_ms") + (backoff_ms * F.pow(F.lit(2.0), F.col("attempts") - 1)).cast("long"))
        return state.select("run_id", "url", "attempts", "failures", "reason", resolved.alias("resolved"), again.alias("retry_at_ms"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tried, failed, reason, last, bad_ms, good = state.get if state.exists else (0, 0, None, 0, 0, False)
        for rows in batches:  # each batch is counted as a whole; the latest row decides, whichever batch brings it
            bad, end = rows[~rows["ok"]], rows.iloc[rows["ts_ms"].to_numpy().argmax()]
            tried, failed = tried + len(rows), failed + len(bad)
            if len(bad) and bad["ts_ms"].max() >= bad_ms:
                bad_ms, reason = int(bad["ts_ms"].max()), bad.iloc[bad["ts_ms"].to_numpy().argmax()]["reason"]
            if int(end["ts_ms"]) >= last:
                last, good = int(end["ts_ms"]), bool(end["ok"])
        resolved = good and failed > 0
        state.update((tried, failed, reason, last, bad_ms, good))
        state.setTimeoutDuration(expire_ms)
        again = None if resolved or failed == 0 or tried > retries else last + backoff_ms * 2 ** (tried - 1)
        yield pd.DataFrame({"run_id": [key[0]], "url": [key[1]], "attempts": [tried], "failures": [failed], "reason": [reason], "resolved": [resolved], "retry_at_ms": pd.array([again], "Int64")})

    return attempts.groupBy("run_id", "url").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def new_cards(cards: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each card once; state is kept only as far back as ``late``."""
    return cards.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def live_counts(attempts: DataFrame) -> DataFrame:
    """Counters per run, for complete or update mode."""
    return attempts.groupBy("run_id").agg(F.count(F.lit(1)).alias("done"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


def windowed_counts(attempts: DataFrame, at: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Failures and successes per time window; windows close when the watermark passes them."""
    return attempts.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed")).select("window.start", "window.end", "ok", "failed")


def run_status(counts: DataFrame, total: str = "total") -> DataFrame:
    """``queued``, ``running``, ``done`` or ``failed`` by what has been done of what was planned."""
    status = F.when(F.col("done") == 0, "queued").when(F.col("done") < F.col(total), "running").when(F.col("ok") == 0, "failed").otherwise("done")
    return counts.withColumn("status", status).withColumn("progress", F.when(F.col(total) > 0, F.round(100.0 * F.col("done") / F.col(total))).otherwise(0.0))


PARTS = 64


def upsert_batches(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, parts: int = PARTS):
    """Keep a Parquet table of the last row of each key: a micro-batch rewrites only those of ``parts`` that its keys fall into.

    A part's rows are merged, written aside and moved into place. What is there already, from an earlier run too, takes part; a batch that
    is run again gives the same rows. Parts are folders ``part=K`` of ``path``.
    """
    from ..operators.dedup import last_wins

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = last_wins(batch.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")), [F.col(key)], [F.col(order)])
        touched = [r["part"] for r in new.select("part").distinct().collect()]  # at most ``parts``
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            old = spark.read.schema(new.schema).parquet(path).where(F.col("part").isin(touched))
            new = last_wins(old.unionByName(new), [F.col(key)], [F.col(order)])
        aside = f"{path.rstrip('/')}_aside"
        new.write.mode("overwrite").parquet(aside)
        spark.read.schema(new.schema).parquet(aside).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
