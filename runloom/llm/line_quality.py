"""Quality by a linear-chain conditional random field over lines.

Every line is good or bad; its evidence is its own shape and that of the lines beside it, and
transitions tie neighbours together. Forward-backward gives each line's probability of being good, and
the average weighted by line length is the document's quality, which a logistic curve fitted across
folds calibrates. Lines learn from their document's label.

The field is fitted on a bounded sample of labelled rows; every text is then scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.common import by_size, extend, texts
from runloom.llm.toxicity import fit_logistic, probability, sample_of

#: Labelled documents of each class that the field is fitted on: the bound of what the driver sees.
SAMPLE = 2_000
#: Documents scored together.
GROUP = 200
LOWER, UPPER, DIGIT, SPACE, STOP, SHOUT, BAR, SYMBOL, WIDE = range(9)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, SYMBOL, np.int64)
    kind[128:] = WIDE
    for chars, k in ((range(97, 123), LOWER), (range(65, 91), UPPER), (range(48, 58), DIGIT), (b" \t\r\n\v\f", SPACE), (b".,;:'\"-()?", STOP), (b"!", SHOUT), (b"|", BAR)):
        kind[list(chars)] = k
    return kind


CLASSES = _byte_classes()
OWN = 15
WIDTH = 3 * OWN + 2


def line_features(rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text, the lines' bytes, and each text's number of lines (one at least)."""
    lines = [t.split("\n") for t in rows]
    sizes = np.array([len(x) for x in lines])
    flat = [line for x in lines for line in x]
    raw = [line.encode("utf-8", "surrogatepass") for line in flat]
    length = np.array([len(r) for r in raw])
    kinds = CLASSES[np.frombuffer(b"".join(raw), np.uint8)]
    count = np.bincount(np.repeat(np.arange(len(raw)), length) * 9 + kinds, minlength=9 * len(raw)).reshape(-1, 9).astype(float)
    words = np.zeros((len(flat), 4))
    for i, line in enumerate(flat):
        parts = line.split()
        words[i] = len(parts), len(set(parts)), sum(map(eq, parts, parts[1:])), line[-1:] in ".!?" and line != ""
    again = np.concatenate([_seen_before(x) for x in lines])
    n, total = np.maximum(words[:, 0], 1), np.maximum(length, 1)
    share = count / total[:, None]
    own = np.column_stack([
        np.log1p(length) / 10, count[:, UPPER] / (count[:, UPPER] + count[:, LOWER] + 1), share[:, DIGIT], share[:, STOP], share[:, SHOUT], share[:, BAR], share[:, SYMBOL], share[:, WIDE],
        share[:, SPACE], np.minimum(length / n / 20, 2), words[:, 1] / n, words[:, 2] / n, np.log1p(words[:, 0]) / 10, words[:, 3], again,
    ])
    first = np.zeros(len(flat), bool)
    first[np.cumsum(sizes) - sizes] = True
    last = np.roll(first, -1)
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, first, last]), length, sizes


def _seen_before(lines: list[str]) -> np.ndarray:
    seen, out = set(), np.zeros(len(lines))
    for i, line in enumerate(lines):
        out[i] = line in seen and line != ""
        seen.add(line)
    return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    """Over the last axis."""
    top = x.max(-1)
    return top + np.log(np.exp(x - top[..., None]).sum(-1))


def forward_backward(unary: np.ndarray, move: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of good of every line, log partition of every text, and expected moves of every text.

    ``unary``: each line's score of good less bad. ``move``: scores of label pairs. Texts step together,
    the longest first, so the work is that of all lines.
    """
    start = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    start, size = start[order], sizes[order]
    score = np.column_stack([np.zeros(len(unary)), unary])
    alpha, beta = score.copy(), np.zeros_like(score)
    live = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]) if len(size) else 0)]  # texts with more than t lines
    for t in range(1, len(live)):
        at = start[: live[t]] + t
        alpha[at] += _log_sum(alpha[at - 1][:, None, :] + move.T[None])
    for t in range(len(live) - 1, 0, -1):
        at = start[: live[t]] + t
        beta[at - 1] = _log_sum((score[at] + beta[at])[:, None, :] + move[None])
    z = np.zeros(len(sizes))
    z[order] = _log_sum(alpha[start + size - 1]) if len(size) else []
    text = np.repeat(np.arange(len(sizes)), sizes)
    good = np.exp(alpha[:, 1] + beta[:, 1] - z[text])
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(sizes) - sizes] = False
    at = np.flatnonzero(inner)
    pair = np.exp(alpha[at - 1][:, :, None] + move[None] + (score[at] + beta[at])[:, None, :] - z[text[at]][:, None, None])
    moves = np.zeros((len(sizes), 2, 2))
    np.add.at(moves, text[at], pair)
    return good, z, moves


@dataclass(frozen=True)
class Field:
    middle: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    move: np.ndarray

    def lines(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        unary = np.c_[(x - self.middle) / self.spread, np.ones(len(x))] @ self.weights
        return forward_backward(unary, self.move, sizes)[0]


def fit_field(x: np.ndarray, sizes: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 100, rate: float = 0.05, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood, each text counting the same whatever its lines (Adam on the full sample)."""
    middle, spread = x.mean(0), x.std(0) + 1e-6
    z = np.c_[(x - middle) / spread, np.ones(len(x))]
    line_label, share = np.repeat(label, sizes).astype(float), weight / sizes / weight.sum()
    per_line = np.repeat(share, sizes)
    told = np.zeros((2, 2))
    for k in (0, 1):
        told[k, k] = (share * (sizes - 1))[label == k].sum()
    w, move = np.zeros(z.shape[1]), np.zeros((2, 2))
    m1 = m2 = (0.0, 0.0)
    for step in range(1, rounds + 1):
        good, _, moves = forward_backward(z @ w, move, sizes)
        gradients = (z.T @ (per_line * (line_label - good)) - ridge * w, told - (share[:, None, None] * moves).sum(0) - ridge * move)
        m1 = tuple(0.9 * a + 0.1 * g for a, g in zip(m1, gradients))
        m2 = tuple(0.999 * a + 0.001 * g * g for a, g in zip(m2, gradients))
        w, move = (p + rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8) for p, a, b in zip((w, move), m1, m2))
    return Field(middle, spread, w, move)


def aggregate(good: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length-weighted share of good in each text, with its log odds."""
    if not len(sizes):
        return np.zeros((0, 2))
    start = np.cumsum(sizes) - sizes
    weight = length + 1e-6  # a text without letters counts its lines alike
    q = np.add.reduceat(good * weight, start) / np.add.reduceat(weight, start)
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.column_stack([q, np.log(q / (1 - q))])


@dataclass(frozen=True)
class Classifier:
    field: Field
    curve: tuple[np.ndarray, np.ndarray, np.ndarray]


SHAPES = T.StructType([
    T.StructField("features", T.BinaryType()), T.StructField("bytes", T.BinaryType()), T.StructField("label", T.IntegerType()),
    T.StructField("fold", T.IntegerType()), T.StructField("weight", T.DoubleType()),
])


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, held_out: int = 2, sample: int = SAMPLE) -> Classifier | None:
    """The field and the curve from ``labels`` (doc_id, quality); None without both classes.

    The driver gets the line features of the sampled texts, not the texts.
    """
    chosen = sample_of(docs, labels, "quality", parts, held_out, sample)

    def shapes(batches):
        for batch in batches:
            rows = texts(batch.column(0))
            made = [line_features([t]) for t in rows]
            yield pa.RecordBatch.from_arrays([pa.array([m[0].astype(np.float32).tobytes() for m in made], pa.binary()), pa.array([m[1].astype(np.int32).tobytes() for m in made], pa.binary()), *batch.columns[1:]], names=SHAPES.names)

    got = chosen.mapInArrow(shapes, SHAPES).toPandas()
    if got["label"].nunique() < 2:
        return None
    x = [np.frombuffer(b, np.float32).reshape(-1, WIDTH).astype(float) for b in got["features"]]
    length = [np.frombuffer(b, np.int32) for b in got["bytes"]]
    label, fold, weight = (got[c].to_numpy() for c in ("label", "fold", "weight"))

    def of(mask: np.ndarray):
        at = np.flatnonzero(mask)
        return np.concatenate([x[i] for i in at]), np.concatenate([length[i] for i in at]), np.array([len(x[i]) for i in at]), label[at], weight[at]

    features, y, w = [], [], []
    for k in (0, 1):
        if not (fold == k).any() or len(set(label[fold != k])) < 2:
            continue
        lines, _, sizes, own, _ = of(fold != k)
        field = fit_field(lines, sizes, own, _balanced(own))
        lines, bytes_, sizes, own, weights = of(fold == k)
        features.append(aggregate(field.lines(lines, sizes), bytes_, sizes))
        y.append(own)
        w.append(weights)
    lines, bytes_, sizes, own, weights = of(np.ones(len(x), bool))
    field = fit_field(lines, sizes, own, _balanced(own))
    if not features or len(set(np.concatenate(y))) < 2:
        features, y, w = [aggregate(field.lines(lines, sizes), bytes_, sizes)], [own], [weights]
    return Classifier(field, fit_logistic(np.concatenate(features), np.concatenate(y).astype(float), np.concatenate(w)))


def _balanced(label: np.ndarray) -> np.ndarray:
    return np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))


def line_marginals(text: str, classifier: Classifier) -> list[float]:
    """Each line's probability of being good."""
    x, _, sizes = line_features([text])
    return classifier.field.lines(x, sizes).tolist()


def score(docs: DataFrame, classifier: Classifier | None, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality in ``into``; without a classifier it is 1. A null text is empty, an empty text one empty line.

    Every row is scored by itself, so repeated rows get equal scores, and an empty table stays empty. A column named as ``into``
    is replaced, all others are kept. A task holds the features of at most ``GROUP`` texts and four million letters, or of one text.
    """
    if classifier is None:
        return docs.withColumn(into, F.lit(1.0))
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def compute(column):
        rows, out = texts(column), [np.zeros(0)]
        for part in by_size(rows, GROUP):
            x, length, sizes = line_features(part)
            out.append(probability(aggregate(shared.value.field.lines(x, sizes), length, sizes), shared.value.curve))
        return [pa.array(np.concatenate(out), pa.float64())]

    return extend(docs, [text], [T.StructField(into, T.DoubleType())], compute)
