"""Shards of the mix: quotas hold, and over shards the words are those of the mix."""

from collections import Counter

from pyspark.sql import functions as F

from gleanery.llm import mixing, queries

from .helpers import SCHEMA, awkward_rows

SMALL = "/root/testdata/sf0.001"


def totals(rows):
    out = Counter()
    for r in rows:
        out[r["doc_id"], r["size"]] += r["taken"]
    return +out


def test_shards_sum_to_the_mix(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = queries.QUERIES["op10_source_mix_shards"](spark, SMALL).collect()
    assert totals(got) == totals(mixing.mix(docs).collect())
    assert {r["shard"] for r in got} == set(range(mixing.SHARDS)) and all(r["taken"] > 0 for r in got)
    odd = spark.createDataFrame(awkward_rows(), SCHEMA)
    assert totals(mixing.mix_shards(odd, shards=3).collect()) == totals(mixing.mix(odd).collect())
    assert mixing.mix_shards(odd.where(F.lit(False))).count() == 0


def test_blocks_per_source_and_shard_meet_their_quota(spark):
    """Documents of one word and blocks of one word: words of a source in a shard are its blocks there."""
    sizes = {"a": 40, "b": 333, "c": 7, "d": 120}
    rows = [(n, "w", s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {n: s for n, _, s in rows}
    got = Counter()
    for r in mixing.mix_shards(docs, blocks=10_000, shards=5).collect():
        got["0" + source[r["doc_id"]], r["shard"]] += r["taken"]
    plan = mixing.apportion(mixing.source_targets(docs.select(F.concat(F.lit("0"), "source").alias("skey"), F.lit(1).cast("long").alias("size"))), 10_000)
    assert plan.first()["block"] == 1
    want = {(r["skey"], r["shard"]): r["quota"] for r in mixing.shard_quotas(plan, 5).collect()}
    assert got == Counter({k: v for k, v in want.items() if v})
