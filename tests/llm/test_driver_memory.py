"""What the driver's Python holds at most while the toxicity machine is fitted."""

import random
import tracemalloc

import numpy as np

from gleanery.llm import toxicity


def peak(call, *args):
    tracemalloc.start()
    try:
        out = call(*args)
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def words(count, sizes=(6, 24)):
    rng = random.Random(5)
    return list(dict.fromkeys("".join(rng.choices("abcdefghijklmnop", k=rng.randint(*sizes))) for _ in range(count)))


def test_kernel_holds_its_result_and_little_else(monkeypatch):
    some = words(2000, (1, 40))
    values, mb = peak(toxicity.gram, some, some[:240])
    assert mb < 60
    monkeypatch.setattr(toxicity, "PAIRS", 11)  # where the pairs are cut makes no difference
    assert np.allclose(toxicity.gram(some[:100], some[:240]), values[:100], atol=1e-6)
    assert toxicity.gram([], some[:3]).shape == (0, 3) and not toxicity.gram(["", "zz"], some[:3])[0].any()


def test_fit_holds_features_once(spark):
    own = words(24_000)
    rows = [(i, " ".join(own[i * 40 : i * 40 + 40]) + (" zorkwit" if i % 4 == 0 else "") + ".", int(i % 4 == 0)) for i in range(600)]
    training = spark.createDataFrame(rows, "doc_id long, text string, label int")
    machine, mb = peak(toxicity.fit, training)
    assert mb < 100
    got = toxicity.score_texts(training, machine).join(training.select("doc_id", "label"), "doc_id").collect()
    assert min(r["score"] for r in got if r["label"]) > max(r["score"] for r in got if not r["label"])


def test_fit_without_any_example(spark):
    """Clean documents without words, and toxic ones in which nothing tells."""
    rows = [(i, f"w{i} x{i}" if i % 2 else " ", i % 2) for i in range(40)]
    training = spark.createDataFrame(rows, "doc_id long, text string, label int")
    scores = [r["score"] for r in toxicity.score_texts(training, toxicity.fit(training)).collect()]
    assert len(scores) == 40 and all(0 <= s <= 1 for s in scores)
