"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features are its own and those of the lines beside it, and neighbouring states are linked by
transition weights. Forward-backward gives each line's probability of being good, and their mean weighted by length, through a
fitted logistic curve, is the document's quality.

Only documents are labelled. A line starts with its document's label; lines of bad documents that a first, line-by-line fit finds
clearly good are then called good (a bad document keeps its worst line), and the chain is trained on that. Training takes a bounded sample
(SAMPLE labelled rows of the smallest hashes, and of these, in that order, whole documents up to LINES lines) and only the lines' numbers go to the driver; scoring is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.common import bound_batches, fold
from granary.llm.toxicity import training_sample

#: Labelled rows that are learnt from, at most.
SAMPLE = 4000
#: Lines that are learnt from, at most: what bounds the driver's memory, 27 numbers a line.
LINES = 400_000
UPPER, LOWER, DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
SYMBOLS = b"#$%&*|<>{}[]=@^~\\/_+"
OWN = 14  # features of a line by itself
BESIDE = (1, 2, 3, 4, 8)  # those that neighbours lend
WIDTH = 1 + OWN + 2 * (1 + len(BESIDE))


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x WIDTH) and lengths in bytes of a text's lines. Text without any line has one, empty."""
    lines = text.encode().split(b"\n")
    rows, seen = [], set()
    for line in lines:
        n, words = len(line), line.split()
        k = len(words)
        if not k:
            rows.append((0.0,) * 12 + (1.0, 0.0))
            continue
        upper, lower = n - len(line.translate(None, UPPER)), n - len(line.translate(None, LOWER))
        symbols = n - len(line.translate(None, SYMBOLS))
        rows.append((
            min(n, 4000) ** 0.5 / 30,
            upper / (upper + lower + 1),
            min(symbols / k, 4.0),
            min(line.count(b"|") / k, 1.0),
            1 - len(set(words)) / k,
            min((n - k) / k, 30) / 10,
            (n - len(line.translate(None, DIGITS))) / n,
            float(k == 1),
            min(line.count(b"!") / k, 3.0),
            float(line[-1:] in b".!?\"'"),
            min(line.count(b",") / k, 1.0),
            float(k < 4),
            0.0,
            float(line in seen),
        ))
        seen.add(line)
    own = np.array(rows)
    out = np.zeros((len(rows), WIDTH))
    out[:, 0] = 1
    out[:, 1 : 1 + OWN] = own
    lent = own[:, BESIDE]
    at = 1 + OWN
    out[0, at] = 1  # no line before
    out[1:, at + 1 : at + 1 + len(BESIDE)] = lent[:-1]
    at += 1 + len(BESIDE)
    out[-1, at] = 1  # no line after
    out[:-1, at + 1 :] = lent[1:]
    return out, np.array([len(line) + 1 for line in lines], float)


class Chain:
    """Two states, bad 0 and good 1: a line's score of being good, and transition scores from state to state."""

    def __init__(self, emission: np.ndarray, transition: np.ndarray):
        self.emission, self.transition = emission, transition

    def marginals(self, features: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of good for each line; expected transitions of all chains together. Chains of alike lengths go together."""
        score = features @ self.emission
        good, expected = np.zeros(len(score)), np.zeros((2, 2))
        move = np.exp(self.transition)
        group = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            size, n = lengths[own], int(lengths[own].max())
            at = starts[own][:, None] + np.minimum(np.arange(n)[None, :], size[:, None] - 1)
            inside = np.arange(n)[None, :] < size[:, None]
            p = 1 / (1 + np.exp(-np.clip(score[at], -30, 30)))
            emit = np.stack([1 - p, p], axis=2)
            forward = np.zeros((len(own), n, 2))
            forward[:, 0] = emit[:, 0] / emit[:, 0].sum(axis=1, keepdims=True)
            for t in range(1, n):
                f = forward[:, t - 1] @ move * emit[:, t]
                forward[:, t] = f / f.sum(axis=1, keepdims=True)
            backward = np.ones((len(own), 2))
            for t in range(n - 1, -1, -1):
                here = forward[:, t] * backward
                here /= here.sum(axis=1, keepdims=True)
                live = inside[:, t]
                good[at[live, t]] = here[live, 1]
                if t:
                    right = emit[:, t] * backward
                    both = forward[:, t - 1, :, None] * move[None] * right[:, None, :]
                    both /= both.sum(axis=(1, 2), keepdims=True)
                    expected += both[live].sum(axis=0)
                    b = right @ move.T
                    backward = np.where(live[:, None], b / b.sum(axis=1, keepdims=True), backward)
        return good, expected

    @classmethod
    def train(cls, features: np.ndarray, starts: np.ndarray, lengths: np.ndarray, states: np.ndarray, rounds: int = 120, strength: float = 1e-3) -> Chain:
        """Maximum likelihood with a quadratic penalty, by Adam on all chains at once."""
        chain = cls(np.zeros(features.shape[1]), np.zeros((2, 2)))
        within = np.ones(len(states), bool)
        within[starts] = False
        after = np.flatnonzero(within)
        seen = np.zeros((2, 2))
        np.add.at(seen, (states[after - 1], states[after]), 1)
        w, m, v = np.zeros(features.shape[1] + 4), 0.0, 0.0
        for i in range(1, rounds + 1):
            good, expected = chain.marginals(features, starts, lengths)
            slope = np.append(features.T @ (good - states), (expected - seen).reshape(-1)) / len(states) + strength * w
            m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
            w = w - 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
            chain = cls(w[:-4], w[-4:].reshape(2, 2))
        return chain


def pooled(good: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean of the lines' probabilities by length, for each document."""
    return np.add.reduceat(good * weights, starts) / np.add.reduceat(weights, starts)


def curve(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Intercept and slope of a logistic curve by Newton's method, with a weak penalty."""
    design, w = np.stack([np.ones(len(x)), x], axis=1), np.array([-3.0, 6.0])
    prior = w.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), design.T @ (p - y) + 0.1 * (w - prior))
        w = w - np.clip(step, -2, 2)
    return w


def fit(features: list[np.ndarray], weights: list[np.ndarray], labels: np.ndarray) -> tuple[Chain, np.ndarray]:
    if not len(labels) or labels.min() == labels.max():  # one kind alone teaches nothing: every document is as that kind, or even
        only = 0.5 if not len(labels) else float(labels[0])
        return Chain(np.zeros(WIDTH), np.zeros((2, 2))), np.array([6 * (only - 0.5), 0.0])
    lengths = np.array([len(f) for f in features])
    starts = np.cumsum(lengths) - lengths
    x, w = np.concatenate(features), np.concatenate(weights)
    states = np.repeat(labels, lengths).astype(np.int64)
    alone = Chain.train(x, np.arange(len(x)), np.ones(len(x), np.int64), states)
    good, _ = alone.marginals(x, np.arange(len(x)), np.ones(len(x), np.int64))
    worst = np.minimum.reduceat(good, starts)
    states = np.where((states == 0) & (good > 0.8) & (good > np.repeat(worst, lengths)), 1, states)
    chain = Chain.train(x, starts, lengths, states)
    good, _ = chain.marginals(x, starts, lengths)
    return chain, curve(pooled(good, w, starts), labels.astype(float))


def train(docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str, sample: int, lines: int = LINES) -> tuple[Chain, np.ndarray]:
    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), *(pa.array([x[k].astype(np.float32).tobytes() for x in found], pa.binary()) for k in (0, 1))], names=["y", "features", "weights"])

    chosen = training_sample(docs, labels, label, text, doc_id, sample).select("text", "y", F.xxhash64("text", "y").alias("h"), F.regexp_count("text", F.lit("\n")).alias("n"))
    chosen = chosen.where(F.col("n") < lines // 20)  # a document of so many lines would be most of what is learnt
    sizes = sorted((r.h, r.n + 1) for r in chosen.select("h", "n").collect())  # at most `sample` rows
    total, last = 0, None
    for h, n in sizes:
        if total + n > lines:
            break
        total, last = total + n, h
    if last is None:
        return fit([], [], np.zeros(0))
    rows = chosen.where(F.col("h") <= last).select("text", "y").mapInArrow(numbers, "y int, features binary, weights binary").collect()  # at most `lines` lines
    rows.sort(key=lambda r: (r.y, bytes(r.features)))
    return fit([np.frombuffer(r.features, np.float32).reshape(-1, WIDTH).astype(float) for r in rows], [np.frombuffer(r.weights, np.float32).astype(float) for r in rows], np.array([r.y for r in rows]))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, repeated ones too.

    Only the text is judged; null counts as empty, which is one empty line. Labels are taken from rows whose crc32(doc_id) mod 3 is not 1; null
    labels are left out; labels of one kind alone give that kind's score to all. No rows give no rows; other columns are left out.
    """
    bound_batches(docs.sparkSession)
    chain, line = train(docs, labels, label, text, doc_id, sample)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for i in range(0, batch.num_rows, 200):
                found = [line_features(t.as_py()) for t in batch.column(1).slice(i, 200)]
                lengths = np.array([len(f) for f, _ in found])
                starts = np.cumsum(lengths) - lengths
                good, _ = chain.marginals(np.concatenate([f for f, _ in found]), starts, lengths)
                mean = pooled(good, np.concatenate([w for _, w in found]), starts)
                scores.append(1 / (1 + np.exp(-(line[0] + line[1] * mean))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    found = slim.mapInArrow(scored, T.StructType([slim.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
