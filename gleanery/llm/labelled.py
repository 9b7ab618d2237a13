"""Bounded, reproducible samples of labelled documents for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS, HELD_OUT = 3, 1


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; remainder 1 is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def held_out(id_col: str = "doc_id"):
    """True for rows that no model may learn from; a null id counts as held out."""
    return F.coalesce(fold(id_col) == HELD_OUT, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, positives: int, negatives: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, label`` and columns to ``keep``: at most so many documents of each label, first in hash order of their ids.

    Conflicting labels of an id count as 1; null labels and held-out ids are left out. The sample of ids is bounded
    by its parameters, so it is broadcast and texts are not shuffled.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    own = own.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = [own.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in ((1, positives), (0, negatives))]
    sample = picked[0].unionAll(picked[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)
    return rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label", *keep)


def read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
