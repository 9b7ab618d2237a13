"""The shingle join keeps sets apart by their texts, whatever their ids, and counts links of large families exactly."""

import itertools
import random

import numpy as np
import pytest

from gleanery.llm import jaccard_join

from .helpers import components, shingle_sets

T = " ".join(f"t{i}" for i in range(60))
U = " ".join(f"u{i}" for i in range(40))


def found(spark, rows, parts=3, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(df, **options).collect()), key=repr)


def test_an_id_with_several_texts(spark):
    rows = [(1, T), (9, T + " word"), (9, U), (9, U), (12, U + " more"), (9, None), (None, T), (3, ""), (3, T + " word word2")]
    assert found(spark, rows) == components(rows)
    assert found(spark, rows, parts=1, family_entries=50) == components(rows)


def test_rows_that_stay(spark):
    docs = spark.createDataFrame(
        [(1, T, "a"), (9, T + " word", "b"), (9, U, "c"), (9, U, "c"), (None, T, "d"), (None, None, "e"), (3, "", "f"), (4, "", "g"), (5, U + " more", "h")],
        "doc_id long, text string, group string",
    ).repartition(4)
    left = sorted(((r["doc_id"], r["text"], r["group"]) for r in jaccard_join.without_near_copies(docs).collect()), key=repr)
    assert left == sorted([(1, T, "a"), (None, T, "d"), (None, None, "e"), (3, "", "f"), (4, "", "g"), (5, U + " more", "h")], key=repr)
    twice = spark.createDataFrame([(1, T, "a"), (1, T, "a"), (2, T + " x", "b"), (1, U, "c")], "doc_id long, text string, group string").repartition(3)
    assert sorted(r["text"] for r in jaccard_join.without_near_copies(twice).collect()) == sorted([T, U])
    assert jaccard_join.without_near_copies(docs.limit(0)).count() == 0


def family(rng, size, edits, words=60):
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(words)] = f"n{rng.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("options", [{}, {"family_entries": 1500}, {"short": 4, "family_entries": 700}])
def test_components_and_links_of_families(spark, options):
    """Tight and loose families, in one task and in blocks, against all pairs."""
    rng = random.Random(11)
    texts = [t for size, edits in ((120, 3), (80, 7), (40, 2), (3, 2)) for t in family(rng, size, edits)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    sets = [frozenset(s) for s in shingle_sets(rows)]
    distinct = list(set(sets))
    links = dict.fromkeys(distinct, 0)
    for a, b in itertools.combinations(distinct, 2):
        if 100 * len(a & b) >= 75 * len(a | b):
            links[a] += 1
            links[b] += 1
    got = jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()
    assert {r["doc_id"]: r["n_links"] for r in got} == {i: links[s] for (i, _), s in zip(rows, sets, strict=True)}
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == components(rows)


def test_members_of_a_ball_link():
    rng = np.random.default_rng(5)
    for _ in range(200):
        base = set(range(int(rng.integers(4, 60))))
        near = []
        while len(near) < 2:
            own = {x for x in base if rng.random() > 0.07} | {int(x) for x in rng.integers(1000, 2000, rng.integers(0, 5))}
            if jaccard_join.in_ball(len(own & base), len(own), len(base), 75):
                near.append(own)
        a, b = near
        assert 100 * len(a & b) >= 75 * len(a | b)


def test_blocks_and_rows_hold_the_same_sets(spark, monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(3)
    made = jaccard_join._Block.__new__(jaccard_join._Block)
    made.number, made.rows, made.entries = 5 << jaccard_join.BLOCK_BITS, ([], [], [], []), 0
    monkeypatch.setattr(jaccard_join, "BLOCK_ENTRIES", 40)
    sets = [np.sort(rng.integers(0, 2**63, int(rng.integers(1, 60)), dtype=np.uint64)).tobytes() for _ in range(50)]
    blocks = [b for i, s in enumerate(sets) if (b := made.add(i, b"%d" % i, s))] + [made.close()]
    rows = pa.Table.from_batches(list(jaccard_join._apart(iter(blocks)))).to_pylist()
    assert [(r["id"], r["key"], r["n"], r["shingles"]) for r in rows] == [(i, b"%d" % i, len(s) // 8, s) for i, s in enumerate(sets)]
    assert len(blocks) > 20 and len({r["name"] for r in rows}) == 50


def test_counted_shingles_travel_whole():
    rng = np.random.default_rng(4)
    lead = np.unique(rng.integers(0, 2**48, 3000, dtype=np.uint64))
    assert (jaccard_join._unpacked(jaccard_join._packed(lead), len(lead)) == lead).all()
    assert jaccard_join._unpacked(jaccard_join._packed(lead[:1]), 1).tolist() == lead[:1].tolist()


def test_sets_are_grouped_where_they_lie(spark):
    """The bucketed sets get their marks without a shuffle of their own."""
    from gleanery.llm.common import bucketed, forget

    sets = bucketed(spark.createDataFrame([(i, i, [1], [b"k"], [1], b"x" * 8) for i in range(20)], jaccard_join.SETS), "sets", "run", 4)
    marks = spark.createDataFrame([(1, 1, 1, b"", b"")], jaccard_join.MARKS)
    joined = sets.groupBy("run").cogroup(marks.groupBy("run")).applyInArrow(lambda key, a, b: a.select(["run"]), "run long")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert joined.count() == 20
    forget(sets)
