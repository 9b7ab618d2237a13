"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

score = logistic(w0 + sum w_i x_i + sum over factors of ((sum v_i x_i)^2 - sum (v_i x_i)^2) / 2): all pairwise
interactions at low rank, in time linear in the number of non-zero features. Features reach the driver for
fitting on a bounded, reproducible sample only; scoring streams Arrow batches with the model broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import held_out, read, training_rows

BINS, FACTORS = 1 << 14, 8
POSITIVES, NEGATIVES = 4000, 4000
EPOCHS = 12
CACHE = 400_000
STATS = (
    "chars", "words", "word_length", "longest_word", "upper", "lower", "digits", "spaces", "newlines", "marks",
    "symbols", "wide", "distinct_words", "repeated_lines", "line_length", "stop_marks", "metadata_chars",
)

_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[32] = 4
_CLASS[10] = 5
_CLASS[[ord(c) for c in ".,;:!?'\"-()"]] = 6
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_CLASS[128:] = 8


class Featuriser:
    """Hashed words (presence, unit length) followed by structure statistics; one per worker, with a bounded cache."""

    def __init__(self):
        self.bins: dict[str, int] = {}

    def _bin(self, word: str) -> int:
        got = self.bins.get(word)
        if got is None:
            if len(self.bins) >= CACHE:
                self.bins.clear()
            got = self.bins[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BINS
        return got

    def __call__(self, text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        words, lines = text.split(), text.split("\n")
        distinct = set(words)
        hashed = np.unique(np.fromiter(map(self._bin, distinct), np.int64, len(distinct)))
        raw = text.encode("utf-8", "surrogatepass")
        kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9) if raw else np.zeros(9)
        n, w, size = max(1, len(raw)), max(1, len(words)), np.log1p(len(text))
        stats = [
            size / 10, np.log1p(len(words)) / 8, min(len(text) / w, 40) / 10, min(max(map(len, words), default=0), 100) / 50,
            *(kinds[[1, 2, 3, 4, 5, 6, 7, 8]] / n * np.array([3, 1, 5, 3, 10, 5, 5, 2])),
            len(distinct) / w, 1 - len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)) / 8,
            sum(x[-1] in ".!?" for x in lines if x) / len(lines), np.log1p(len(text) if n_chars is None or n_chars < 0 else n_chars) / 10,
        ]
        at = np.concatenate([hashed, np.arange(BINS, BINS + len(stats))])
        return at, np.concatenate([np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed)))), stats])


class FactorisationMachine:
    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[at] * x[:, None]
        return float(self.bias + self.linear[at] @ x + ((v.sum(0) ** 2).sum() - (v**2).sum()) / 2)

    def probability(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(at, x), -30, 30))))

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
        """Adagrad on logistic loss, one document at a time in seeded order, labels weighted to balance."""
        size = BINS + len(STATS)
        chance = np.random.default_rng(seed)
        made = cls(0.0, np.zeros(size), chance.normal(0, 0.05, (size, FACTORS)))
        weight = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
        seen_b, seen_w, seen_v = 1.0, np.full(size, 1.0), np.full((size, FACTORS), 1.0)
        for _ in range(epochs):
            for i in chance.permutation(len(rows)):
                at, x = rows[i]
                v = made.factors[at]
                vx = v * x[:, None]
                total = vx.sum(0)
                g = weight[i] * (1 / (1 + np.exp(-np.clip(made.bias + made.linear[at] @ x + ((total**2).sum() - (vx**2).sum()) / 2, -30, 30))) - y[i])
                gw = g * x + decay * made.linear[at]
                gv = g * x[:, None] * (total - vx) + decay * v
                seen_b += g * g
                seen_w[at] += gw**2
                seen_v[at] += gv**2
                made.bias -= rate * g / np.sqrt(seen_b)
                made.linear[at] -= rate * gw / np.sqrt(seen_w[at])
                made.factors[at] -= rate * gv / np.sqrt(seen_v[at])
        return made


def fit(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> FactorisationMachine:
    """Fit on at most so many documents of each label. Without both labels: the share of label 1 (0.5 of none)."""

    def featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Featuriser()
        for b in batches:
            got = [make(t, n) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.list_(pa.int32())), pa.array([x for _, x in got], pa.list_(pa.float32())), b.column(2)], ["at", "x", "label"])

    sample = training_rows(docs, labels, "quality", positives, negatives, ("n_chars",) if "n_chars" in docs.columns else ())
    if "n_chars" not in sample.columns:
        sample = sample.withColumn("n_chars", F.lit(None).cast("long"))
    got = sample.select("text", F.col("n_chars").cast("long").alias("n_chars"), "label").mapInArrow(featurised, "at array<int>, x array<float>, label int").toPandas()
    y = got["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        p = min(max(y.mean(), 0.01), 0.99) if len(y) else 0.5
        size = BINS + len(STATS)
        return FactorisationMachine(float(np.log(p / (1 - p))), np.zeros(size), np.zeros((size, 1)))
    rows = [(np.asarray(a, np.int64), np.asarray(x, np.float64)) for a, x in zip(got["at"], got["x"], strict=True)]
    return FactorisationMachine.fit(rows, y)


def score_texts(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of each row's whole text; null counts as empty, an absent or null ``n_chars`` as the length."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, make = held.value, Featuriser()
        for b in batches:
            score = [own.probability(*make(t or "", n)) for t, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), n_chars.alias("n_chars")).mapInArrow(run, "doc_id long, score double")


THRESHOLD = 0.5


def op4_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir)
    scored = score_texts(docs, fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
