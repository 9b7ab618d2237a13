"""Nearest neighbours on doubles, sparse ids, cells and queries of their own, against all distances."""

import numpy as np
import pytest

from gleanery.llm import ann

from .test_operators import exact_neighbours


def found(df, **options):
    out = {}
    for r in ann.nearest(df, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def recall(got, ids, x, k=10):
    want = {int(q): exact_neighbours(ids, x, q, k) for q in got}
    for q, own in got.items():
        true = {int(i): float(np.sqrt(((v - x[ids == q][0]) ** 2).sum())) for i, v in zip(ids, x, strict=True)}
        assert all(score == pytest.approx(true[i], rel=1e-12) for i, score in own)
        assert own == sorted(own, key=lambda r: (r[1], r[0])) and len(own) == min(k, len(ids) - 1)
    return np.mean([len({i for i, _ in want[q]} & {i for i, _ in own}) / len(want[q]) for q, own in got.items()])


def test_doubles_keep_their_precision(spark):
    rng = np.random.default_rng(1)
    ids, x = np.arange(300) * 20, 1000 + 1e-5 * rng.normal(size=(300, 8))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = found(df)
    assert len(got) == 60 and recall(got, ids, x) >= 0.99 and min(s for own in got.values() for _, s in own) > 0


def test_doubles_beyond_floats(spark):
    rows = [(100 * i, [1e200 * i, 1.0]) for i in range(1, 6)] + [(700, [1e-200, 0.0]), (800, [2e-200, 0.0]), (900, [1e308, -1e308])]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3)
    assert set(got) == {i for i, _ in rows}
    assert got[100][:1] == [(200, 1e200)] and got[700][0] == (800, pytest.approx(1e-200))
    assert [i for i, _ in got[300][:2]] == [200, 400] and got[300][2][1] == pytest.approx(2e200)


def test_sparse_ids_are_one_search(spark):
    """Ids far apart are no reason for more scans or smaller blocks."""
    rng = np.random.default_rng(2)
    ids, x = np.arange(60) * 10**10, rng.normal(size=(60, 6))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    search = ann.nearest(df)
    plan = search._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and "Union" not in plan
    got = found(df)
    assert len(got) == 60 and recall(got, ids, x) == 1.0


def test_cells_hold_the_neighbours(spark):
    """Clustered vectors in many cells: few are probed; with goal 1 all are, and with share 1 the search is exact."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 8
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(np.float32)
    ids = np.arange(4000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(3)
    coder = ann.fitted(x, 4000, cell_rows=100)
    assert len(coder.cells) == 40 and coder.probes <= 8
    assert recall(found(df, cell_rows=100), ids, x.astype(float)) >= 0.95
    assert recall(found(df, cell_rows=100, goal=1, share=1.0), ids, x.astype(float)) == 1.0


def test_queries_of_their_own_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (1, [5.0, 5.0]), (2, [0.0, 2.0]), (2, [0.0, 2.0]), (3, [9.0, 9.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(2, [0.0, 2.0], "x"), (2, [0.0, 3.0], "x"), (77, [9.0, 8.0], "x"), (None, [1.0, 1.0], "x"), (5, None, "x")], "vec_id long, embedding array<double>, score string")
    got = found(df, queries=asked)
    assert got == {2: [(1, 1.0), (1, pytest.approx(34**0.5)), (3, pytest.approx(130**0.5))], 77: [(3, 1.0), (1, 5.0), (2, pytest.approx(117**0.5)), (2, pytest.approx(117**0.5)), (1, pytest.approx(130**0.5))]}


def test_most_rows_in_one_vector(spark):
    """A third of all rows equal: neighbours of others aren't crowded out, ties go to small ids."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 8))
    x[::3] = x[0]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = found(df, cell_rows=500)
    assert got[0] == [(3 * i, 0.0) for i in range(1, 11)]
    assert recall({q: got[q] for q in got if q % 3}, np.arange(3000), x) >= 0.95


@pytest.mark.parametrize("kind", ["clusters finer than the codes", "norms of all sizes", "queries unlike the rest"])
def test_every_true_neighbour_on_other_rows(spark, kind):
    """Rows that the codes tell badly apart: the scan alone misses many, the search has all."""
    rng = np.random.default_rng(5)
    x, ids = rng.normal(size=(6000, 32)), np.arange(6000)
    if kind == "clusters finer than the codes":
        x = rng.normal(size=(6, 32))[rng.integers(0, 6, 6000)] + 1e-3 * x
    elif kind == "norms of all sizes":
        x *= np.exp(1.5 * rng.normal(size=(6000, 1)))
    else:
        x[::100] += 20 * rng.normal(size=32)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    assert recall(found(df, cell_rows=1000), ids, x) == 1.0
    assert kind.startswith("queries") or recall(found(df, cell_rows=1000, rerank=60, exact=False), ids, x) < 0.9
