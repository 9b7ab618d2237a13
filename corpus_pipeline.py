"""Corpus pipeline: toxicity, exact dedup, near dedup, mixing, tokenising.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as the next stage's
``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from gleanery.llm.common import forget, materialise, scratch, shuffle_partitions

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the machine learns from the labelled documents of ``sf_dir``.

    Null and empty texts score as texts without words. Every row is judged by its own text, whatever its id.
    """
    machine = toxicity.toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.with_scores(docs.select(*COLUMNS), machine)
    return scored.where(F.col("score") < toxicity.THRESHOLD).drop("score")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, against a digest index that starts empty; the largest id stays.

    A null text is an empty one. A null id loses to any other; rows that repeat an id and its text are one document.
    """
    index = exact_dedup.DigestIndex(spark, scratch(spark, "pipeline"), shuffle_partitions(spark))
    left = exact_dedup.without_copies(docs.select(*COLUMNS), index, batch_name="documents")
    index.drop()
    return left


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles: the one whose id names the group.

    Texts without words and rows with a null id link with nothing and stay. Rows that repeat an id are told apart by their texts.
    """
    return jaccard_join.without_near_copies(docs.select(*COLUMNS))


def apply_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them.

    A document of which ``taken`` words are taken appears floor(taken / size) times, and once more with the
    remaining fraction as its chance, by seeded hash: sources keep to their targets and reruns agree. Documents without words
    aren't taken; rows that repeat an id are taken each for itself.
    """
    return mixing.mixed_rows(docs.select(*COLUMNS))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document of the mix, each row for itself; null ids stay null."""
    import public_tokenizers

    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode_digests(docs, tokens, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", apply_mix),
    ("byte-level BPE", tokenise),
]

#: The first stage is a learned model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
