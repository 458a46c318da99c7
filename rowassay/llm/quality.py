"""Naive Bayes support vectors: n-gram indicators scaled by log-count ratios, under a linear hinge-loss model."""

from __future__ import annotations

from dataclasses import dataclass
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowassay.llm.common import map_texts

#: Hash space of the indicators, and the sizes of n-grams of bytes.
BITS = 17
ORDERS = (1, 2, 3, 4)
#: Further indicators: some word comes this often in a row.
IN_A_ROW = (2, 3, 5, 9)
SIZE = (1 << BITS) + len(IN_A_ROW)
#: Labelled rows that the model is fitted on at most: those with the smallest hash of their id.
SAMPLE = 4_000


def indicators(raw: bytes) -> np.ndarray:
    """The hashed n-grams that a whole text has, ascending; each once."""
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    seen = np.zeros(1 << BITS, bool)
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(data) < n:
            break
        code = (code[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :] if n > 1 else data.copy()
        if n in ORDERS:
            h = (code ^ np.uint32(n * 0x27D4EB2F)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            seen[h >> np.uint32(32 - BITS)] = True
    return np.flatnonzero(np.concatenate([seen, _longest_run(raw.split()) >= np.array(IN_A_ROW)]))


def _longest_run(words: list[bytes]) -> int:
    changes = np.flatnonzero(np.fromiter(map(ne, words, words[1:]), bool, max(0, len(words) - 1)))
    return int(np.diff(np.concatenate([[-1], changes, [len(words) - 1]])).max()) if words else 0


@dataclass
class Model:
    """``weights`` already hold the log-count ratios; ``slope`` and ``shift`` turn margins into probabilities."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray) -> float:
        margin = self.weights[found].sum() + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40))))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, rounds: int = 30, seed: int = 7) -> Model:
    """Log-count ratios of the classes, then dual coordinate descent on the hinge loss; probabilities by Platt's sigmoid on
    margins that three folds give to rows they have not seen. With one class only, every score is that class."""
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(SIZE), 0.0, 0.0, 40.0 if len(labels) and labels[0] else -40.0 if len(labels) else 0.0)
    fold = np.arange(len(rows)) % 3
    margins = np.zeros(len(rows))
    for k in range(3):
        own, rest = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        if len(set(labels[rest].tolist())) == 2:
            w, b = _descend([rows[i] for i in rest], labels[rest], cost, rounds, seed)
            margins[own] = [w[rows[i]].sum() + b for i in own]
    slope, shift = _platt(margins, labels)
    w, b = _descend(rows, labels, cost, rounds, seed)
    return Model(w, b, slope, shift)


def _descend(rows, labels, cost, rounds, seed):
    good = labels == 1
    counts = [np.ones(SIZE), np.ones(SIZE)]
    for r, g in zip(rows, good):
        counts[int(g)][r] += 1
    ratio = np.log(counts[1] / (good.sum() + 2)) - np.log(counts[0] / ((~good).sum() + 2))
    # rows of unit length, so that long texts weigh no more than short ones; the score uses the same scale
    sign = np.where(good, 1.0, -1.0)
    scaled = [ratio[r].astype(np.float32) for r in rows]
    square = np.array([float(x @ x) for x in scaled]) + 1.0
    bound = np.where(good, 1.0, good.sum() / max(1, (~good).sum())) * cost / max(1.0, np.median(square))
    alpha, w, b = np.zeros(len(rows)), np.zeros(SIZE), 0.0
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in order.permutation(len(rows)):
            gradient = sign[i] * (scaled[i] @ w[rows[i]] + b) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), bound[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                most = max(most, abs(gradient))
                w[rows[i]] += step * scaled[i]
                b += step
                alpha[i] = new
        if most < 0.05:
            break
    return w * ratio, b


def _platt(margins, labels, steps: int = 100):
    """A sigmoid's slope and shift, by Newton's method with smoothed targets."""
    good, bad = (labels == 1).sum(), (labels != 1).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        change = np.linalg.solve(hessian, x.T @ (target - p))
        theta = theta + np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-8:
            break
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on the labelled ids with the smallest hashes, at most ``sample`` of them, and the texts they have in ``docs``.

    Labels other than 0 and 1 are passed over; of several labels of an id the largest counts. Only indicators come to the
    driver, not texts.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    taken = known.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(sample)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(taken), "_id")

    def begin():
        return lambda texts: [pa.array([indicators(t.encode()).astype(np.int32).tobytes() for t in texts.to_pylist()], pa.binary())]

    rows = map_texts(texts, ["_h", "_label"], "_text", "found binary", begin).collect()
    rows = sorted((r["_h"], r["_label"], bytes(r["found"])) for r in rows)
    return fit([np.frombuffer(f, np.int32) for _, _, f in rows], np.array([y for _, y, _ in rows], int))


def score(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), into: str = "score") -> DataFrame:
    """The columns of ``keep`` and ``into`` (0 to 1, higher: label 1 likelier) for every whole text, in one pass.

    Null is the empty text, which has no indicator and gets the score of the bias. Repeated rows are kept; other columns
    are not read. ``into`` must not be one of ``keep``.
    """

    def begin():
        return lambda texts: [pa.array([model.score(indicators(t.encode())) for t in texts.to_pylist()], pa.float64())]

    return map_texts(df, list(keep), text_col, f"{into} double", begin)
