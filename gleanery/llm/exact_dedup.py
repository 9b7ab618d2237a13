"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by SHA-256 digest. A batch is reduced to one row per
digest (partial aggregation runs before the shuffle, so a group that holds a third of all rows arrives
as one row per map task), digests that the index lacks are found by a sort-merge anti-join and appended.
The index side of that join is never shuffled, because its buckets already are the join's partitioning.

Digests are appended under the name of their batch. A batch that is repeated, as after a run that died behind its append, finds
its digests under its own name, appends none twice and gives the same result.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, materialise, scratch, shuffle_partitions, text_or_empty


class DigestIndex:
    """Persistent index of digests already seen: ``digest binary, keep_id bigint, batch string``.

    ``buckets`` must be the same every time a path is opened; it is part of the path's name so that a
    mistaken value opens another index instead of damaging this one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.path = f"{path.rstrip('/')}/digests_b{buckets}"
        self.name = "digest_index_" + re.sub(r"\W+", "_", self.path.split("://")[-1]).strip("_").lower()
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, rows: DataFrame, batch: str) -> None:
        """Append ``digest, keep_id`` of a batch: one file per bucket."""
        (
            rows.select("digest", "keep_id", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .mode("append")
            .format("parquet")
            .option("path", self.path)
            .saveAsTable(self.name)
        )


    def drop(self) -> None:
        """Forget the table and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch_name: str | None = None) -> DataFrame:
    """Mark each row of a batch as kept or dropped and add the batch to ``index``.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row. Among equal texts
    of a batch the largest id stays; a text that the index already holds keeps the id stored there and
    no row of the batch. ``group_size`` counts the batch's rows with that text. A null text equals the
    empty text. Rows repeated with the same id and text count in ``group_size``; one of them is kept.
    Null ids lose to any other id; if a text has only null ids, one of its rows stays and ``keep_id`` is
    null. An empty batch gives no rows. Extra columns are ignored, whatever their names.

    ``batch_name`` (default: a new one for each call) names the batch in the index: repeating a batch under its name gives the same
    result again. Rows join their digest's verdict in a sort-merge join; a digest that holds very many rows is split by AQE.
    """
    name = batch_name or uuid.uuid4().hex
    rows = materialise(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")),
        "digests",
    )
    # The row number, fixed by having been written, decides among repeated rows of one id and text.
    best = F.max(F.struct("doc_id", "row"))
    batch = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    # Written, because the optimiser moves an anti-join below an aggregate, where hot digests are not yet one row.
    batch = materialise(batch, "batch")
    fresh = materialise(batch.select("digest", "keep_id").hint("merge").join(index.read().select("digest"), "digest", "left_anti"), "fresh")
    index.append(fresh, name)
    known = batch.select("digest", "keep_row", "group_size").hint("merge").join(index.read(), "digest")
    judged = materialise(known.select("digest", "keep_id", "keep_row", "group_size", (F.col("batch") == name).alias("is_new")), "judged")
    forget(batch, fresh)
    return (
        rows.join(judged, "digest")
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("is_new") & (F.col("row") == F.col("keep_row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` table as the first batch of a new index."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, scratch(spark, "op5"), shuffle_partitions(spark))
    judged = exact_dedup(docs, index, batch_name="documents")
    index.drop()  # what the query returns doesn't read it any more
    return judged


def without_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch_name: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, that ``exact_dedup`` keeps. Of rows equal in id and text one stays."""
    judged = exact_dedup(docs, index, id_col, text_col, batch_name)
    judged = materialise(judged.select("doc_id", F.unhex("text_sha256").alias("digest"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("best"), "kept"), "judged")
    kept = judged.where("kept").select("doc_id", "digest")
    many = judged.where("kept").select(F.col("digest")).join(judged.where("best and not kept").select("digest"), "digest", "left_semi")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty(f"`{text_col}`"), 256)).alias("digest"))
    left = own.join(kept, own.doc_id.eqNullSafe(kept.doc_id) & (own.digest == kept.digest), "left_semi")
    if many.limit(1).count():  # rows equal in id and text
        left = left.dropDuplicates(["doc_id", "digest"])
    return left.select("row.*")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
