"""Failure state without expiry: the rows of a stream's batches, and no Python per group."""

from gleanery.streaming import attempts

ROWS = [
    (1, "a", False, "late", 5), (1, "a", False, "later", 9), (1, "b", False, "x", 3), (1, "b", True, None, 4), (2, "a", True, None, 1),
    (3, "a", False, "p", 1), (3, "a", False, "q", 2), (3, "a", False, "r", 3), (4, "a", True, None, 2), (4, "a", False, "z", 7), (5, "a", False, "old", -5),
]


def test_state_of_each_page(spark):
    df = spark.createDataFrame(ROWS, "run_id long, url string, ok boolean, reason string, ts_ms long")
    state = attempts.failure_state(df)
    assert "Pandas" not in state._jdf.queryExecution().executedPlan().toString()
    got = {(r["run_id"], r["url"]): (r["attempts"], r["failures"], r["reason"], r["resolved"], r["retry_at_ms"]) for r in state.collect()}
    assert got == {
        (1, "a"): (2, 2, "later", False, 2009), (1, "b"): (2, 1, "x", True, None), (2, "a"): (1, 0, None, False, None),
        (3, "a"): (3, 3, "r", False, None), (4, "a"): (2, 1, "z", False, 2007), (5, "a"): (1, 1, "old", False, 995),
    }
