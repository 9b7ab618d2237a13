"""Toxicity by a support vector machine over a gapped-subsequence string kernel with Nyström landmarks.

A sentence is seen through windows (units): its words, long ones cut into overlapping windows, runs of single letters joined. The kernel of two
windows is the inner product of their subsequences of three and four characters, each occurrence weighted by decay to the
power of its span, so letters inserted into a word or left out of it cost little. Training rows are windows of labelled
sentences, and the machine itself says which: a sentence's score is that of its highest window, so of a toxic document those sentences'
highest windows are positive that the machine scores positive (or comes near to), and of clean documents every sentence's highest window within
the margin is negative, besides frequent ones. A squared-hinge machine over Nyström features is fitted, windows are chosen anew by its scores, and so
on for some rounds. For the first round, and for choosing landmarks, windows are weighed by how far the share of toxic
sentences that hold their runs of characters exceeds that of all sentences.

As the kernel is an explicit inner product, the machine folds into one vector of weights over hashed
subsequences; a unit's score is a sum over its own subsequences, in time linear in its length. A document's
score is a logistic function of its highest unit scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import few_rows, materialise, shuffle_partitions
from .labelled import held_out, read, training_rows

SPAN, DECAY, BITS = 6, 0.7, 20
LONG, WINDOW = 40, 24
POSITIVES, NEGATIVES, UNITS = 3000, 5000, 60_000
LANDMARKS = 240
PENALTY = 1.0
NEAR = -0.5  # score that a toxic document's best window needs to speak for it
ROUNDS = 2  # of choosing the windows that speak for sentences by the machine itself
PRIOR, TELLING, ALIKE = 1.0, 1.5, 0.8  # smoothing of evidence, least evidence of a toxic unit, kernel of too similar landmarks
CACHE = 300_000
ROWS, WORDS = 512, 4096  # documents and words handled at a time by a worker
PAIRS = 1 << 17  # pairs of occurrences that meet at a time

_TRIM = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~«»„“”‘’…–—¡¿"
_SPACED = re.compile(r"(?<!\S)\S(?: \S){2,}(?!\S)")
_SENTENCE = re.compile(r"[.!?]\s|\n")
# Offsets of the characters of a subsequence after its first, for spans up to SPAN.
_STEPS = [(0, *c) for n in (3, 4) for c in combinations(range(1, SPAN), n - 1)]
_WHOLE = [(0, 1, 2), (0, 1, 2, 3)]  # without gaps


def units(text: str) -> set[str]:
    """Distinct units of a text; a unit is trimmed when it is scored."""
    low = text.lower()
    found = set(low.split())
    for run in _SPACED.findall(low):
        found.add(run.replace(" ", ""))
    for word in [w for w in found if len(w) > LONG]:
        found.discard(word)
        found.update(word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2))
    return found


def subsequences(words: list[str], steps: list[tuple[int, ...]] = _STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed bin and weight of every subsequence occurrence; weights of a row have unit length."""
    rows, bins, weights = [], [], []
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w), []).append(i)
    for size, own in by_size.items():
        text = "".join("\x02" + words[i] + "\x03" for i in own)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), size + 2).astype(np.uint64)
        got_bins, got_weights = [], []
        for step in steps:
            count = size + 2 - step[-1]
            if count < 1:
                continue
            h = np.full((len(own), count), len(step), np.uint64)
            for at in step:
                h = (h ^ chars[:, at : at + count]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            got_bins.append((h >> np.uint64(64 - BITS)).astype(np.int64))
            got_weights.append(np.full(count, DECAY ** (step[-1] + 1 - len(step))))
        if got_bins:
            b, w = np.concatenate(got_bins, 1), np.concatenate(got_weights)
            rows.append(np.repeat(np.asarray(own), b.shape[1]))
            bins.append(b.ravel())
            weights.append(np.tile(w / np.sqrt((w**2).sum()), len(own)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(bins), np.concatenate(weights)


def gram(a: list[str], b: list[str]) -> np.ndarray:
    """Kernel values of two lists of units.

    Occurrences meet by bin, at most about ``PAIRS`` pairs at a time, so besides the result memory is bounded.
    """
    rb, hb, wb = subsequences(b)
    order = np.argsort(hb, kind="stable")
    rb, wb = rb[order], wb[order]
    ends = np.cumsum(np.bincount(hb, minlength=1 << BITS), dtype=np.int32)
    out = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(a), WORDS // 16):
        some = a[at : at + WORDS // 16]
        r, h, w = subsequences(some)
        first = np.where(h, ends[h - 1], 0)
        count = ends[h] - first
        hit = count > 0
        r, w, first, count = r[hit], w[hit], first[hit], count[hit]
        upto = np.cumsum(count)
        cuts = [0, *np.unique(np.searchsorted(upto, np.arange(PAIRS, upto[-1] if len(upto) else 0, PAIRS))), len(upto)]
        sums = np.zeros(len(some) * len(b))
        for x, y in zip(cuts, cuts[1:]):
            n = count[x:y]
            place = np.arange(n.sum()) + np.repeat(first[x:y] - (np.cumsum(n) - n), n)
            sums += np.bincount(np.repeat(r[x:y], n) * len(b) + rb[place], np.repeat(w[x:y], n) * wb[place], len(sums))
        out[at : at + len(some)] = sums.reshape(len(some), len(b))
    return out


class SubsequenceMachine:
    """Folded weights over hashed subsequences, a bias, and the logistic function of a document."""

    def __init__(self, weights: np.ndarray, bias: float, link: np.ndarray):
        self.weights, self.bias, self.link = weights, bias, link

    def score_units(self, words: list[str]) -> np.ndarray:
        trimmed = [w.strip(_TRIM) or w for w in words]
        out = np.empty(len(words))
        for at in range(0, len(words), WORDS):
            some = trimmed[at : at + WORDS]
            r, h, w = subsequences(some)
            out[at : at + WORDS] = np.bincount(r, w * self.weights[h], len(some)) + self.bias
        return out

    @staticmethod
    def features(scores: np.ndarray) -> np.ndarray:
        """Of a document's unit scores: the highest, the second, and how many are positive (logarithm)."""
        top = np.full(2, -1.5)
        best = np.sort(scores)[::-1][:2] if len(scores) < 64 else np.sort(np.partition(scores, -2)[-2:])[::-1]
        top[: len(best)] = np.clip(best, -1.5, 1.5)
        return np.array([1.0, *top, np.log1p((scores > 0).sum())])

    def probability(self, scores: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(scores) @ self.link, -30, 30))))


def _squared_hinge(blocks: list[np.ndarray], positive: np.ndarray, negative: np.ndarray, penalty: float, start: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Newton's method on weighted squared hinge losses of both labels; only rows within the margin enter a step. Rows come in blocks, which are never joined."""
    size, ends = blocks[0].shape[1], np.cumsum([len(x) for x in blocks])
    w = np.zeros(size) if start is None else start.copy()
    eye = penalty * np.eye(size)
    eye[-1, -1] = 1e-6
    for _ in range(rounds):
        grad, curve = eye @ w, eye.copy()
        for x, end in zip(blocks, ends, strict=True):
            f = x @ w.astype(np.float32)
            up, down = positive[end - len(x) : end] * (f < 1), negative[end - len(x) : end] * (f > -1)
            near = np.flatnonzero(up + down)
            pull, weight = (up * (f - 1) + down * (f + 1))[near], (up + down)[near]
            some = x[near].astype(float)
            grad += some.T @ pull
            curve += some.T @ (some * weight[:, None])
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-4 * max(1.0, np.abs(w).max()):
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (p - y) + 0.05 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _garbled(word: str, i: int) -> str:
    """A word with one character put between its letters, for the machine to learn gaps from."""
    mark = ".-_*x"[i % 5]
    if i % 2:
        return mark.join(word)
    at = 1 + i // 2 % max(1, len(word) - 1)
    return word[:at] + mark + word[at:]


def _evidence(table: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratio of toxic to clean sentences for every hashed run of three or four characters, over all units of the sample, and
    the ratio of all toxic to all clean ones.

    Tasks emit sums over the fixed number of bins, so the driver gets arrays of bounded size from few tasks.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << BITS), np.float32)
        for b in (whole.slice(at, WORDS) for whole in batches for at in range(0, whole.num_rows, WORDS)):
            r, h, _ = subsequences(b.column(0).to_pylist(), _WHOLE)
            for k in (0, 1):
                np.add.at(sums[k], h, b.column(k + 1).to_numpy()[r].astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([pa.compress(sums.tobytes(), "zstd", asbytes=True)], pa.binary())], ["sums"])

    total = np.zeros((2, 1 << BITS), np.float32)
    for (packed,) in table.coalesce(4).mapInArrow(summed, "sums binary").toLocalIterator():
        total += np.frombuffer(pa.decompress(bytes(packed), total.nbytes, "zstd", asbytes=True), np.float32).reshape(2, -1)
    share = float(total[0].sum() / max(total[1].sum(), 1e-9))
    return np.log((total[0] + PRIOR) / (10 * share * total[1] + PRIOR)).astype(np.float32), share


def _witnesses(training: DataFrame, machine: SubsequenceMachine, bound: int) -> pd.DataFrame:
    """Windows that decide about labelled sentences: ``unit, bad, good``, in how many toxic and clean documents, at most ``bound`` of each.

    Of a toxic document's sentences each one with a positive window speaks for it, without any the one that comes nearest, if it comes
    near; of clean documents every sentence whose highest window comes within the margin.
    """
    held = training.sparkSession.sparkContext.broadcast(machine)

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memo = held.value, {}
        for b in few_rows(batches, ROWS):
            if len(memo) > CACHE:
                memo.clear()
            out: tuple[list, list] = ([], [])
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sentences = [[w.strip(_TRIM) or w for w in units(x)] for x in _SENTENCE.split(text)]
                flat = [w for x in sentences for w in x]
                if not flat:
                    continue
                new = list(set(flat) - memo.keys())
                memo.update(zip(new, own.score_units(new).tolist(), strict=True))
                score = np.fromiter(map(memo.__getitem__, flat), float, len(flat))
                ends = np.cumsum([len(x) for x in sentences])
                best = [a + int(np.argmax(score[a:b])) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True) if a < b]
                least = max(NEAR, min(0.0, float(score.max()))) if label else -1.0
                for word in {flat[i] for i in best if score[i] >= least}:
                    out[0].append(word)
                    out[1].append(label)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], ["unit", "label"])

    seen = training.select("text", "label").mapInArrow(spoken, "unit string, label int")
    counts = seen.groupBy("unit").agg(F.sum("label").cast("double").alias("bad"), F.sum(1 - F.col("label")).cast("double").alias("good"))
    counts = materialise(counts, "witnesses")
    # Arrow: the executors sort and cut, and the driver gets what is left as it is.
    return pa.concat_tables([counts.orderBy(F.desc(c), "unit").limit(bound).toArrow() for c in ("bad", "good")]).to_pandas().drop_duplicates("unit")


def fit(training: DataFrame, landmarks: int = LANDMARKS, max_units: int = UNITS, rounds: int = ROUNDS) -> SubsequenceMachine:
    """Fit on a bounded set of labelled texts (``text, label``).

    Which windows of toxic sentences are toxic is not labelled. The first round takes those whose runs of characters occur in toxic
    sentences far beyond their share, counted over the whole sample; ``rounds`` more take those that the machine scores highest. ``max_units`` bounds
    the windows that reach the driver: the telling ones first, then the rest in hash order. Without rows of both labels, every document gets the share of label 1 (0.5 of none).
    """
    # The sample is bounded and read several times: written once, spread over tasks.
    training = materialise(training.select("doc_id", "text", "label").repartition(shuffle_partitions(training.sparkSession)), "training")
    counts = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    if len(counts) < 2:
        p = 0.5 if not counts else min(max(float(next(iter(counts))), 0.01), 0.99)
        return SubsequenceMachine(np.zeros(1 << BITS), -1.0, np.array([np.log(p / (1 - p)), 0, 0, 0]))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, label = [], []
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for sentence in _SENTENCE.split(text):
                    own = [w.strip(_TRIM) or w for w in units(sentence)]
                    words += own
                    label += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(label, pa.int32())], ["unit", "label"])

    table = training.select("text", "label").mapInArrow(seen, "unit string, label int").groupBy("unit").agg(F.sum("label").cast("double").alias("bad"), F.sum(1 - F.col("label")).cast("double").alias("good"))
    table = materialise(table, "units")
    evidence = _evidence(table)
    held = table.sparkSession.sparkContext.broadcast(evidence)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, share = held.value
        for b in (whole.slice(at, WORDS) for whole in batches for at in range(0, whole.num_rows, WORDS)):
            r, h, _ = subsequences(b.column(0).to_pylist(), _WHOLE)
            own = ratios[h]
            order = np.lexsort((-own, r))
            r, own = r[order], own[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            family = np.bincount(r[place < 3], own[place < 3], b.num_rows) / 3
            bad, good = b.column(1).to_numpy(), b.column(2).to_numpy()
            alone = np.log((bad + PRIOR) / (10 * share * good + PRIOR))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.maximum(family, alone), pa.float64())], ["unit", "bad", "good", "evidence"])

    known = table.mapInArrow(weighed, "unit string, bad double, good double, evidence double")
    # Units that tell most, and of the rest as many as the bound allows, in hash order.
    telling = (F.col("evidence") >= TELLING) & (F.col("bad") > F.col("good"))
    rows = known.orderBy(F.when(telling, F.col("evidence")).otherwise(0.0).desc(), F.xxhash64("unit"), "unit").limit(max_units).toArrow().to_pandas()
    words, bad, good = rows["unit"].tolist(), rows["bad"].to_numpy(float), rows["good"].to_numpy(float)
    tells = ((rows["evidence"] >= TELLING) & (rows["bad"] > rows["good"])).to_numpy()
    bad = np.where(tells, bad, 0.0)  # the other units of toxic sentences are no examples of anything
    evidence = rows["evidence"].to_numpy()
    del rows

    # Landmarks: what tells most, unlike each other; a quarter are the most frequent neutral units.
    order = [i for i in np.lexsort((np.arange(len(words)), -(evidence * np.log1p(bad)))) if tells[i]]
    chosen, near = [], np.zeros(len(order[: 8 * landmarks]))
    r, h, w = subsequences([words[i] for i in order[: 8 * landmarks]])
    dense = np.zeros(1 << BITS, np.float32)
    for i in range(len(near)):
        if len(chosen) < landmarks * 3 // 4 and near[i] < ALIKE:
            chosen.append(i)
            dense[:] = 0
            np.add.at(dense, h[r == i], w[r == i])
            near = np.maximum(near, np.bincount(r, w * dense[h], len(near)))
    chosen = [words[order[i]] for i in chosen]
    neutral = np.lexsort((np.arange(len(words)), -good))
    chosen += [words[i] for i in neutral[: max(landmarks // 4, landmarks - len(chosen))]]
    chosen = list(dict.fromkeys(chosen))
    value, vector = np.linalg.eigh(gram(chosen, chosen).astype(float))
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])

    # What is no example needs no features, unless it speaks for a sentence later.
    example = (bad > 0) | (good > 0)
    moved = np.cumsum(example) - 1
    garbled = [(moved[i], _garbled(words[i], n)) for n, i in enumerate(order[:4000])]
    words = [word for word, kept in zip(words, example, strict=True) if kept] + [word for _, word in garbled]
    bad, good = bad[example], good[example]
    bad, good = (np.concatenate([x, [x[i] for i, _ in garbled]]) for x in (bad, good))
    del evidence, order, neutral, r, h, w, dense

    def features(some: list[str]) -> list[np.ndarray]:
        parts = (some[at : at + WORDS] for at in range(0, max(1, len(some)), WORDS))
        return [np.concatenate([gram(part, chosen) @ whiten.astype(np.float32), np.ones((len(part), 1), np.float32)], 1) for part in parts]

    def folded(w: np.ndarray) -> SubsequenceMachine:
        sums = np.zeros(1 << BITS)
        for word, a in zip(chosen, whiten @ w[:-1], strict=True):
            _, h, v = subsequences([word])
            np.add.at(sums, h, a * v)
        return SubsequenceMachine(sums.astype(np.float32), float(w[-1]), np.array([0.0, 1, 0, 0]))

    x = features(words)
    w = _squared_hinge(x, bad, good, PENALTY)
    machine = folded(w)
    for _ in range(rounds):
        # The windows that speak for a sentence are those that the machine itself scores highest.
        spoke = _witnesses(training, machine, max_units // 4)
        at = {word: i for i, word in enumerate(words)}
        fresh = [word for word in spoke["unit"] if word not in at]
        at.update((word, len(words) + i) for i, word in enumerate(fresh))
        words += fresh
        good = np.concatenate([good, np.zeros(len(fresh))])
        bad = np.zeros(len(words))
        place = [at[word] for word in spoke["unit"]]
        np.add.at(bad, place, spoke["bad"].to_numpy(float))
        good[place] = np.maximum(good[place], spoke["good"].to_numpy(float))
        for i, word in garbled:
            bad[at[word]] = max(bad[at[word]], bad[i])
        x += features(fresh)
        w = _squared_hinge(x, bad, good, PENALTY, w)
        machine = folded(w)
    found = score_texts(training.select("doc_id", "text", "label"), machine, features=True, keep=("label",)).toArrow().to_pandas()
    machine.link = _logistic(np.stack(found["features"].map(np.asarray)), found["label"].to_numpy(float))
    return machine


class _Scorer:
    """Unit scores of texts, with a bounded cache of units; one per worker."""

    def __init__(self, machine: SubsequenceMachine):
        self.machine, self.memo = machine, {}

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        found = [units(t) if t else set() for t in texts]
        fresh = list(set().union(*found) - self.memo.keys())
        if len(self.memo) + len(fresh) > CACHE:
            self.memo.clear()
            fresh = list(set().union(*found))
        self.memo.update(zip(fresh, self.machine.score_units(fresh).tolist(), strict=True))
        return [np.fromiter(map(self.memo.__getitem__, u), np.float64, len(u)) for u in found]


def score_texts(docs: DataFrame, machine: SubsequenceMachine, id_col: str = "doc_id", text_col: str = "text", features: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, score`` (or ``features``) of each row's whole text; null and empty texts score as texts without units."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        score = _Scorer(own)
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            scores = score(b.column(1).to_pylist())
            if features:
                out = pa.array([own.features(s) for s in scores], pa.list_(pa.float64()))
            else:
                out = pa.array([own.probability(s) for s in scores], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), out, *b.columns[2:]], [id_col, "features" if features else "score", *keep])

    kinds = "".join(f", {c} int" for c in keep)
    picked = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"), *[F.col(c).cast("int").alias(c) for c in keep])
    return picked.mapInArrow(run, f"{id_col} long, {'features array<double>' if features else 'score double'}{kinds}")


def with_scores(rows: DataFrame, machine: SubsequenceMachine, text_col: str = "text") -> DataFrame:
    """All columns of ``rows`` and, last, ``score``, in one pass and without a join. If ``rows`` has such a column, underscores follow the name."""
    held = rows.sparkSession.sparkContext.broadcast(machine)
    name = "score"
    while name in {c.lower() for c in rows.columns}:
        name += "_"
    at_text, names = rows.columns.index(text_col), [*rows.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _Scorer(held.value)
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            found = pa.array([held.value.probability(s) for s in score(b.column(at_text).to_pylist())], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> SubsequenceMachine:
    return fit(training_rows(docs, labels, "toxic", positives, negatives))


THRESHOLD = 0.7


def op3_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir)
    scored = score_texts(docs, toxicity(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
