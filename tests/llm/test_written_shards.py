"""The external shuffle writes whole records, and its digests are of what was written."""

import glob
import random
import zlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gleanery.llm import sharding

from .helpers import SCHEMA, awkward_rows

SMALL = "/root/testdata/sf0.001"


def test_query_writes_whole_records(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(sharding, "scratch", lambda session, name, make=sharding.scratch: paths.append(make(session, name)) or paths[-1])
    got = sharding.op7_external_shuffle(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    back = spark.read.parquet(paths[-1])
    assert set(back.columns) == {*docs.columns, "shard"}
    rows = sorted(map(repr, docs.collect()))
    assert sorted(map(repr, back.select(*docs.columns).collect())) == rows
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    for shard in range(sharding.SHARDS):
        own = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own)))
        files = sorted(glob.glob(f"{paths[-1].removeprefix('file://')}/shard={shard}/*.parquet"))  # by number, as there are fewer than 10^5
        assert [i for _, i in own] == [i for f in files for i in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]


def test_read_shards_gives_slots_back(spark, tmp_path):
    rows = spark.createDataFrame(awkward_rows(), SCHEMA)
    done = sharding.external_shuffle(rows, 4, least_buckets=5, bucket_bytes=1000)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")  # several files a shard
    try:
        sharding.write_shards(done, str(tmp_path / "s"))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    back = sharding.read_shards(spark, str(tmp_path / "s"), rows.schema)
    want = done.select(*back.columns).collect()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, want))
    nothing = rows.where(F.lit(False))
    sharding.write_shards(sharding.external_shuffle(nothing, 4), str(tmp_path / "e"))
    assert sharding.read_shards(spark, str(tmp_path / "e"), rows.schema).count() == 0


def test_one_row_very_often_is_spread(spark):
    """Copies of a row, with null and other ids, lie in all buckets; every row comes out once."""
    often = spark.range(30_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text"), F.when(F.col("id") % 3 == 0, "x").alias("lang"))
    docs = often.unionByName(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang")))
    done = sharding.external_shuffle(docs, 4, least_buckets=64)
    parts = [r["n"] for r in done.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(parts) == 64 and max(parts) < 3 * 32_000 / 64
    got = done.select("record.*", "shard", "slot").toPandas()
    assert sorted(got.groupby("shard")["slot"].apply(sorted).apply(lambda s: s == list(range(8000)))) == [True] * 4
    assert got["doc_id"].isna().sum() == 30_000 and (got["lang"] == "x").sum() == 10_000 and got["doc_id"].dropna().nunique() == 2000


def test_records_are_shuffled_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = sharding.external_shuffle(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") <= 2 and "Join" not in plan.split("Union")[0]


def replay(rows, buckets_of, shards):
    """The two passes by hand: buckets laid end to end, cut at equal counts. Orders inside buckets are given."""
    line = [r for b in sorted(buckets_of) for r in buckets_of[b]]
    each, more = divmod(len(line), shards)
    sizes = [each + (s < more) for s in range(shards)]
    out, at = {}, 0
    for s, n in enumerate(sizes):
        for slot in range(n):
            out[line[at]] = (s, slot)
            at += 1
    return out


def test_shards_are_the_buckets_end_to_end(spark):
    """Against a replay by hand: rows of a bucket keep together, buckets follow each other, and each bucket is permuted."""
    rows = [(i, f"text {random.Random(i).random()}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    done = sharding.external_shuffle(docs, 7, least_buckets=16)
    got = done.select(F.spark_partition_id().alias("bucket"), "record.doc_id", "shard", "slot").collect()
    buckets = {}
    for r in sorted(got, key=lambda r: (r["shard"], r["slot"])):
        buckets.setdefault(r["bucket"], []).append(r["doc_id"])
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in got} == replay(rows, buckets, 7)
    assert all(ids != sorted(ids) for ids in buckets.values())
    sent = docs.select("doc_id", F.pmod(F.xxhash64(F.lit(42), F.col("doc_id").cast("string"), F.crc32(F.col("text").cast("binary")), F.octet_length("text").cast("long") + 1), F.lit(16)).alias("bucket"))
    assert {r["doc_id"]: r["bucket"] for r in sent.collect()} == {i: b for b, ids in buckets.items() for i in ids}
