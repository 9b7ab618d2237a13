"""Two-pass external shuffle into shards.

Pass one scatters whole records into buckets by a seeded hash; the number of buckets follows from the
table's bytes, so that any bucket fits in memory. Pass two gathers each bucket as one array, permutes it
with Fisher-Yates (Spark's ``shuffle``, which swaps each element with one drawn from the rest) and
emits its records in that order. Buckets laid end to end are one global permutation of the table. Shards
are cut from it at equal row counts, so a shard's rows are a run of positions and slots have no gaps. A bucket's
rows are a run of one shard, or the end of one and the start of the next: each bucket's task writes them as they are, so records are
shuffled once, and as many tasks write as there are buckets.

The array is sorted before it is permuted, and bucket ``b`` is partition ``b`` of the exchange, from which the
generator's seed derives: a task that is run again gives the same order. Where a bucket starts arrives in the same exchange, as a row of its
own; no table of buckets is broadcast or joined.

Equal rows would share a bucket. Those that repeat very often are counted first, and each of their copies is scattered by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import CLEAN_SHUFFLES, materialise, running, scratch, setting

SHARDS = 16
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 64
EQUAL = 1000  # rows of one id, size and checksum beyond which copies are scattered one by one
FILES = 100_000  # files whose starts may be broadcast: some 10 MB


def external_shuffle(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = BUCKET_BYTES,
    least_buckets: int = LEAST_BUCKETS,
    equal: int = EQUAL,
) -> DataFrame:
    """``record`` (struct of all input columns), ``size``, ``shard`` and ``slot``: every row exactly once.

    ``size`` is the text's UTF-8 bytes (null: none) plus one. Row counts of shards differ by one at most;
    the first shards have the additional rows. Null ids are ordinary rows, scattered
    by hash of id and text like any other. Rows repeated more than ``equal`` times are scattered copy by copy, so no bucket holds them all. A
    text larger than a bucket makes its bucket that much larger. An
    empty table gives no rows. Input columns live inside ``record``, so their names can't clash.
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.col(f"`{text_col}`").cast("string").cast("binary"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(f"`{id_col}`").cast("string").alias("id"), size.alias("size"), crc.alias("crc"))
    keys = whole.groupBy("id", "crc", "size").agg(F.count(F.lit(1)).alias("n"))
    keys = materialise(keys, "keys")
    total, most = keys.agg(F.sum(F.col("size") * F.col("n")), F.max("n")).first()
    buckets = max(least_buckets, -(-(total or 0) // bucket_bytes))
    place = [F.lit(seed), F.coalesce("id", F.lit("")), F.coalesce("crc", F.lit(-1)), "size"]

    def bucket(*more):
        return F.pmod(F.xxhash64(*place, *more), F.lit(buckets)).cast("int").alias("bucket")

    held = F.struct("id", "crc", "size", "record").alias("held")
    if (most or 0) <= equal:
        scattered = whole.select(bucket(), held)
        counts = keys.select(bucket(), "n")
    else:
        often = keys.where(F.col("n") > equal).select("id", "crc", "size", F.lit(True).alias("often"))
        same = whole.id.eqNullSafe(often.id) & whole.crc.eqNullSafe(often.crc) & (whole["size"] == often["size"])
        scattered = whole.join(often, same, "left_anti").select(bucket(), held)
        # Copies are told apart by their number; kinds that differ in other columns count for themselves.
        kinds = whole.join(often, same, "left_semi").groupBy("record", "id", "crc", "size").agg(F.count(F.lit(1)).alias("n"))
        kinds = materialise(kinds.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(bucket(F.xxhash64("record"), "copy"), held), "often")
        scattered = scattered.unionByName(kinds)
        counts = keys.where(F.col("n") <= equal).select(bucket(), "n").unionByName(kinds.select("bucket", F.lit(1).cast("long").alias("n")))
    return _cut(scattered, _starts(counts), buckets, seed, shards)


def _starts(counts: DataFrame) -> DataFrame:
    """``bucket, start, rows``: where each bucket's rows start, and how many rows there are in all."""
    counts = materialise(counts.groupBy("bucket").agg(F.sum("n").cast("long").alias("n")).withColumn("chunk", F.expr("bucket div 4096")), "counts")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    return running(counts, [], "chunk", ["bucket"], start=F.col("n")).select("bucket", F.col("start").cast("long").alias("start"), F.lit(rows).cast("long").alias("rows"))


def _cut(scattered: DataFrame, starts: DataFrame, buckets: int, seed: int, shards: int) -> DataFrame:
    """Pass two: each bucket permuted, with shard and slot from the bucket's start and the position inside it."""
    none = F.lit(None)
    rows = scattered.select("bucket", "held", none.cast("long").alias("start"), none.cast("long").alias("rows"))
    marks = starts.select("bucket", none.cast(scattered.schema["held"].dataType).alias("held"), "start", "rows")
    dealt = rows.unionByName(marks).repartitionById(buckets, F.col("bucket"))
    held = dealt.groupBy("bucket").agg(F.sort_array(F.collect_list("held")).alias("held"), F.max("start").alias("start"), F.max("rows").alias("rows"))
    mixed = held.select("bucket", "start", "rows", F.posexplode(F.shuffle("held", seed)).alias("at", "held"))
    place = F.col("start") + F.col("at")
    each, more = F.expr(f"rows div {shards}"), F.col("rows") % shards
    head = more * (each + 1)
    # The first `more` shards hold one row more than the others.
    shard = F.when(place < head, F.floor(place / (each + 1))).otherwise(more + F.floor((place - head) / F.greatest(each, F.lit(1))))
    slot = F.when(place < head, place % (each + 1)).otherwise((place - head) % F.greatest(each, F.lit(1)))
    return mixed.select("held.record", "held.size", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def _folder(records: list[str]) -> str:
    """Name of the folders' column: ``shard``, with underscores behind it if records have such a column."""
    name = "shard"
    while name in {c.lower() for c in records}:
        name += "_"
    return name


def write_shards(shuffled: DataFrame, path: str) -> None:
    """Write each shard's records in slot order below ``path/shard=K`` (see ``_folder``), one file for each bucket's run of it.

    Files follow each other by the numbers of their tasks, which are those of the buckets.
    """
    records = shuffled.schema["record"].dataType.names
    folder = _folder(records)
    placed = shuffled.sortWithinPartitions("shard", "slot")
    with setting(shuffled.sparkSession, CLEAN_SHUFFLES, "true"):
        placed.select(*[F.col("record")[c].alias(c) for c in records], F.col("shard").alias(folder)).write.partitionBy(folder).option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, records: StructType) -> DataFrame:
    """``record``, ``shard`` and ``slot`` of what ``write_shards`` wrote: a shard's files follow each other by number, and slots count their rows."""
    folder = _folder(records.names)
    rows = spark.read.schema(StructType([*records.fields, StructField(folder, IntegerType())])).parquet(path)
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in records.names]).alias("record"), F.col(folder).alias("shard"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    files = materialise(rows.groupBy("shard", "file").agg(F.count(F.lit(1)).alias("n")), "files")
    number = [F.regexp_extract("file", pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"\.c(\d+)\.")]
    before = W.partitionBy("shard").orderBy(*number).rowsBetween(W.unboundedPreceding, -1)
    starts = files.select("shard", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # A row per file: broadcast where they are few, joined by sorting beyond.
    return rows.join(F.broadcast(starts) if files.count() <= FILES else starts, ["shard", "file"]).select("record", "shard", (F.col("start") + F.col("at")).alias("slot"))


def op7_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = scratch(spark, "op7")
    write_shards(external_shuffle(docs), path)
    text = F.col("record.text")
    return read_shards(spark, path, docs.schema).select(
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text.cast("string")), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
