"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Word separators of every operator here: space and the controls from tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session. Where that is unset, a local session (tests) gets a
    temporary folder, remembered in the session; any other session falls back to its warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] == "local":
            found = tempfile.mkdtemp(prefix="gleanery-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths in the shared folder that are still there, each with the JVM and the settings that reach it.
_SCRATCH: dict[str, tuple] = {}

CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder. It is deleted when the driver's Python ends, or before by ``forget``."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH[path] = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return path


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for the jobs that run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, gives sizes.

    What the write shuffled is deleted when it is done.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with setting(spark, CLEAN_SHUFFLES, "true"):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.gleanery_path = path
    return back


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder as a table bucketed by a column, as the rows lie, and read it back: grouping by that column doesn't shuffle it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    table = "gleanery_" + path.rsplit("/", 1)[1].replace("-", "_")
    with setting(spark, CLEAN_SHUFFLES, "true"):
        df.write.bucketBy(buckets, column).format("parquet").option("path", path).saveAsTable(table)
    back = spark.table(table)
    back.gleanery_path, back.gleanery_table = path, table
    return back


def forget(*tables: DataFrame) -> None:
    """Delete what ``materialise`` or ``bucketed`` wrote for tables that nothing reads any more."""
    for df in tables:
        if hasattr(df, "gleanery_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.gleanery_table}")
        _delete(df.gleanery_path)


def _delete(path: str) -> None:
    if path in _SCRATCH:
        jvm, settings = _SCRATCH.pop(path)
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(settings).delete(target, True)


@atexit.register
def _delete_rest() -> None:
    for path in list(_SCRATCH):
        try:
            _delete(path)
        except Exception:  # the JVM, and with it the way to the shared folder, is gone
            return


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for the jobs that run inside: wide rows then need less memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    with setting(spark, key, str(rows if before <= 0 else min(rows, before))):
        yield


def running(rows: DataFrame, keys: list[str], sub: str, order: list, **sums) -> DataFrame:
    """Add what the rows before sum to, in the order of ``sub``, then ``order``: inside ``sub`` row by row, over ``sub`` as a whole."""
    inner = W.partitionBy(*keys, sub).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*keys).orderBy(sub).rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, sub).agg(*[F.sum(v).alias(f"{c}_all") for c, v in sums.items()])
    offsets = totals.select(*keys, sub, *[F.sum(f"{c}_all").over(outer).alias(f"{c}_off") for c in sums])
    # Written, so that its size is known: rows aren't shuffled for a small one.
    offsets = materialise(offsets, "offsets")
    rows = rows.select("*", *[F.sum(v).over(inner).alias(c) for c, v in sums.items()]).join(offsets, [*keys, sub])
    zero = {c: F.lit(0) for c in sums}
    return rows.withColumns({c: F.coalesce(c, zero[c]) + F.coalesce(f"{c}_off", zero[c]) for c in sums}).drop(*[f"{c}_off" for c in sums])


def ordered(rows: DataFrame, *by) -> DataFrame:
    """Rows written in ranges of an order, with the number of their range as ``chunk``."""
    return materialise(rows.repartitionByRange(*by).withColumn("chunk", F.spark_partition_id()), "ordered")


def few_rows(batches: Iterator, rows: int) -> Iterator:
    """Batches cut to at most so many rows, for workers that turn them into Python objects."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


#: Bytes of text that one group of a packed shuffle stands for at most.
PART_BYTES = 32 << 20


def parts_for(docs: DataFrame, text_col: str) -> int:
    """Groups of a packed shuffle: as many as shuffle partitions, and more where the texts need more."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // PART_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
