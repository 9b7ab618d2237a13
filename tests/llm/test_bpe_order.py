"""Encoding is right whatever order rows come in, also when a task is run again."""

import hashlib

from pyspark.sql import functions as F

from gleanery.llm import bpe, queries

from .test_operators import SMALL, reference_ids, vocabulary  # noqa: F401


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_rows_in_another_order_at_each_scan(spark, vocabulary):  # noqa: F811
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = {r["doc_id"]: digest(reference_ids(vocabulary, r["text"])) for r in docs.collect()}
    # Each scan sees the rows of a partition in an order of its own.
    shaken = docs.repartition(2).sortWithinPartitions(F.rand())
    got = bpe.encode_digests(shaken, *vocabulary)
    for _ in range(2):
        assert {r["doc_id"]: r["ids_sha256"] for r in got.collect()} == want


def test_query_gives_the_ids_and_texts_of_the_library(spark, vocabulary):  # noqa: F811
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.QUERIES["op2_bpe_round_trip"](spark, SMALL).collect()}
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = reference_ids(vocabulary, r["text"])
        want[r["doc_id"]] = len(ids), digest(ids), hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert got == want


def test_runs_of_several_blocks(vocabulary):  # noqa: F811
    """Blocks of a run are told apart: split, encoded and put together without a session."""
    import pyarrow as pa
    import regex

    tokens, pattern = vocabulary
    texts = [f"word{i} " * (i % 5) + "same words in every one" for i in range(40)] + [None, "", "é" * 300]
    found, rows = regex.compile(pattern).findall, []
    for n in range(4):
        block = bpe._Block()
        for i, t in list(enumerate(texts))[n::4]:
            block.add(i, t, found)
        rows.append(block.row(n, 3))
    blocks = pa.Table.from_batches(rows)

    class Held:
        value = tokens

    lists = [{"run": 0, "block": b["block"], **own} for b in blocks.to_pylist() for own in b["lists"]]
    groups = [pa.Table.from_pylist([r for r in lists if r["part"] == p]) for p in range(3)]
    coded = pa.concat_tables([bpe._encode_words(Held, pattern)(g) for g in groups if g.num_rows])
    got = {i: ids.tolist() for i, ids in bpe._reassembled(blocks, coded)}
    assert got == {i: reference_ids(vocabulary, t) for i, t in enumerate(texts)}
