"""The mix keeps to the targets of sources of any size, and takes rows, not ids."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.llm import mixing

from .test_operators import filled_targets

SCHEMA = "doc_id long, text string, source string, lang string"


def taken_by_source(rows, got):
    source = {i: s for i, _, s, *_ in rows}
    out = Counter()
    for r in got:
        out[source[r["doc_id"]]] += r["taken"]
    return out


@pytest.mark.parametrize("large, small", [(200_000, 3), (50_000, 1), (1000, 700)])
def test_small_sources_get_their_words(spark, large, small):
    """A large source and four small ones: every source is within 1 % of its target, or a word of it."""
    rows = [(n, "w " * (large // 100), "a", "x") for n in range(100)] + [(1000 + n, "v " * small, f"s{n}", "x") for n in range(4)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    want = filled_targets({"a": large, **{f"s{n}": small for n in range(4)}})
    taken = taken_by_source(rows, got)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(1, 0.01 * t), (s, taken[s], t)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)


def test_many_sources(spark):
    rows = [(n, "w " * (n % 37), f"s{n % 500}", "x") for n in range(6000)]
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(t.split())
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    taken, want = taken_by_source(rows, got), filled_targets(dict(sizes))
    assert max(abs(taken[s] - t) for s, t in want.items()) < 2
    assert sum(taken.values()) == pytest.approx(sum(sizes.values()), abs=2)


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    rows = [(1, "one", "a", "x"), (1, "w " * 100, "a", "x"), (None, "z z", "a", "x"), (None, "y " * 7, "b", "x"), (2, "q " * 9, "b", "x"), (2, "q " * 9, "b", "y"), (2, "q " * 9, "b", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    runs = [sorted(map(tuple, mixing.mix(docs.repartition(n)).collect()), key=repr) for n in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    mixed = Counter(tuple(r) for r in mixing.mixed_rows(docs).collect())
    assert set(mixed) <= set(rows)
    # Every row at most three times, and as many words as the mix takes but for the chance of one document each.
    assert all(n <= 3 * rows.count(row) for row, n in mixed.items())
    taken = Counter()
    for i, size, _, _, words in runs[0]:
        taken[i, size] += words
    for (i, size), words in taken.items():
        own = [r for r in rows if r[0] == i and len(r[1].split()) == size]
        times = sum(mixed[r] for r in set(own))
        assert words // size - len(own) <= times <= words // size + len(own)
    assert mixing.mixed_rows(docs.limit(0)).count() == 0


def test_one_row_very_often(spark):
    """Equal rows are one row with a count: no window holds them."""
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    docs = docs.unionByName(spark.range(50).select((F.col("id") + 100).alias("doc_id"), F.lit("d e").alias("text"), F.lit("t").alias("source")))
    got = mixing.mix(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken")).where("doc_id = 7").first()
    want = filled_targets({"s": 300_000, "t": 100})
    assert got["n"] == 100_000 and abs(got["taken"] - want["s"]) < 2
    assert abs(mixing.mixed_rows(docs).where("doc_id = 7").count() - want["s"] / 3) < 0.01 * want["s"]
