"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features describe its bytes and those of the line
before and after it; a chain of two labels ties neighbouring lines together. A
document's lines take its label when the field is trained. A document's score is
the mean of its lines' forward-backward marginals, weighted by their length, put
through a logistic curve fitted on the same sample.

Training reads at most `SAMPLE_DOCS` labelled documents, chosen by a hash of
their id, and of their lines at most `SAMPLE_CHAINS` chains of `CHAIN` lines.
Scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import text as tx

SAMPLE_DOCS = 6000
SAMPLE_CHAINS = 12000
CHAIN = 64
#: A score from here on means a good document.
ACCEPT = 0.3
STEPS = 250

_KINDS = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "wide": [*range(128, 256)],
    "stop": [ord(c) for c in ".,;:'\"-()"], "shout": [ord(c) for c in "!?"], "symbol": [ord(c) for c in "#$%&*@^~|<>{}[]=+\\/_`"],
}
OWN = len(_KINDS) + 6
FEATURES = 3 * OWN + 1


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features for every line, the lines' weights (bytes and one), and the number of lines of each text."""
    n = len(data)
    starts = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1) if n else offsets[:-1].copy()
    # An empty text is one empty line; a break at the end of a text begins no line.
    size = np.diff(offsets)
    starts = np.unique(starts[starts < n]) if n else starts[:0]
    ends = np.r_[starts[1:], n] if len(starts) else starts
    of_text = np.searchsorted(offsets, starts, "right") - 1
    counts = np.bincount(of_text, minlength=len(size))[: len(size)] if len(starts) else np.zeros(len(size), np.int64)

    sums = []
    for kind in _KINDS.values():
        table = np.zeros(256, np.int32)
        table[kind] = 1
        sums.append(np.add.reduceat(table[data], starts) if len(starts) else np.zeros(0, np.int32))
    length = np.maximum(ends - starts, 1)
    shares = [s / length for s in sums]

    lower = tx.LOWER[data]
    ws, we, per_text = tx.words(lower, offsets, tx.BLANK_SEPARATED)
    names = tx.Names(lower).of(ws, we) if len(ws) else np.empty(0, np.uint64)
    line = np.searchsorted(starts, ws, "right") - 1
    in_line = np.bincount(line, minlength=len(starts))[: len(starts)] if len(ws) else np.zeros(len(starts))
    same = np.zeros(len(ws))
    if len(ws) > 1:
        same[1:] = (names[1:] == names[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((names, line))
    new = np.ones(len(ws), bool)
    if len(ws) > 1:
        new[1:] = (names[order][1:] != names[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], weights=new, minlength=len(starts))[: len(starts)] if len(ws) else in_line
    repeats = np.bincount(line, weights=same, minlength=len(starts))[: len(starts)] if len(ws) else in_line
    some = np.maximum(in_line, 1)
    own = np.stack(
        [
            *shares, repeats / some, 1 - distinct / some, np.log1p(in_line), np.minimum(length / some, 40) / 10,
            np.log1p(length) / 4, (in_line < 3).astype(float),
        ], 1,
    ) if len(starts) else np.zeros((0, OWN))

    total = counts + (counts == 0)
    at = np.cumsum(total) - total
    out = np.zeros((total.sum(), OWN))
    weight = np.ones(total.sum())
    full = np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    out[full] = own
    weight[full] = ends - starts + 1
    before, after = np.zeros_like(out), np.zeros_like(out)
    before[1:], after[:-1] = out[:-1], out[1:]
    before[at], after[at + total - 1] = 0, 0
    return np.concatenate([out, before, after, np.ones((len(out), 1))], 1), weight, total


@dataclass
class Field:
    """Weights for label 1 against 0, what two equal neighbouring labels add, and the curve of the score."""

    weights: np.ndarray
    stay: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return _chain(x @ self.weights, self.stay, counts)[0]

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, weight, counts = line_features(data, offsets)
        good = self.marginals(x, counts)
        row = np.repeat(np.arange(len(counts)), counts)
        mean = np.bincount(row, good * weight, len(counts)) / np.bincount(row, weight, len(counts))
        return 1 / (1 + np.exp(-(self.slope * mean + self.shift)))


def _chain(unary: np.ndarray, stay: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all chains at once.

    The marginals of label 1, and for neighbours the expected counts of both 0 and both 1 in every chain.
    """
    order = np.argsort(-counts, kind="stable")
    begin = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    n = len(unary)
    emit = np.stack([np.zeros(n), unary], 1)
    emit = np.exp(emit - emit.max(axis=1, keepdims=True))
    step = np.exp(np.array([[stay[0], 0.0], [0.0, stay[1]]]))
    forward, back = np.empty((n, 2)), np.ones((n, 2))
    longest = int(size[0]) if len(size) else 0
    alive = [int(np.searchsorted(-size, -t, "left")) for t in range(longest)]  # chains longer than t
    for t in range(longest):
        i = begin[: alive[t]] + t
        now = emit[i] if t == 0 else (forward[i - 1] @ step) * emit[i]
        forward[i] = now / now.sum(axis=1, keepdims=True)
    for t in range(longest - 1, 0, -1):
        i = begin[: alive[t]] + t
        now = (back[i] * emit[i]) @ step.T
        back[i - 1] = now / now.sum(axis=1, keepdims=True)
    both = forward * back
    marginal = both[:, 1] / both.sum(axis=1)
    later = np.ones(n, bool)
    later[begin] = False
    i = np.flatnonzero(later)
    pair = forward[i - 1][:, :, None] * step[None] * (emit[i] * back[i])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return marginal, pair[:, 0, 0], pair[:, 1, 1]


def train(x: np.ndarray, weight: np.ndarray, counts: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Field:
    """Gradient ascent on the log-likelihood of the labelled chains, both labels weighing the same in all."""
    if not len(counts) or label.min() == label.max():
        prior = float(label.mean()) if len(label) else 0.5
        return Field(np.zeros(FEATURES), np.zeros(2), 0.0, float(np.clip(np.log((prior + 1e-3) / (1 - prior + 1e-3)), -5, 5)))
    scale = x.std(axis=0) + 1e-3
    middle = x.mean(axis=0) * (np.arange(FEATURES) < FEATURES - 1)
    scale[-1] = 1
    z = (x - middle) / scale
    y = np.repeat(label, counts).astype(float)
    share = np.array([0.5 / max(1e-9, (label == k).mean()) for k in (0, 1)])
    each = np.repeat(share[label] / counts, counts)  # every document counts the same
    later = np.ones(len(y), bool)
    later[np.cumsum(counts) - counts] = False
    each_pair = each[later]
    y_pair = y[later]
    w, stay = np.zeros(FEATURES), np.zeros(2)
    m, v = np.zeros(FEATURES + 2), np.zeros(FEATURES + 2)
    for k in range(1, steps + 1):
        marginal, none, both = _chain(z @ w, stay, counts)
        grad = np.r_[
            z.T @ ((y - marginal) * each), ((1 - y_pair - none) * each_pair).sum(), ((y_pair - both) * each_pair).sum()
        ] / len(counts) - 1e-3 * np.r_[w, stay]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, stay = w + move[:-2], np.clip(stay + move[-2:], 0, 3)
    weights = w / scale
    weights[-1] -= (w * middle / scale).sum()
    field = Field(weights, stay)
    row = np.repeat(np.arange(len(counts)), counts)
    mean = np.bincount(row, field.marginals(x, counts) * weight) / np.bincount(row, weight)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one number
        p = 1 / (1 + np.exp(-(a * mean + b)))
        g = np.array([((label - p) * mean).sum() - 1e-2 * a, (label - p).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * mean * mean).sum() + 1e-2, (h * mean).sum()], [(h * mean).sum(), h.sum() + 1e-6]])
        a, b = np.array([a, b]) + np.linalg.solve(hess, g)
    field.slope, field.shift = float(a), float(b)
    return field


def _labelled_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False)
        for i, _, data, offsets in tx.texts(batch, "t"):
            x, weight, counts = line_features(data, offsets)
            ends = np.cumsum(counts)
            rows = []
            for k, (b, e) in enumerate(zip(ends - counts, ends, strict=True)):
                for s in range(b, e, CHAIN):
                    part = slice(s, min(e, s + CHAIN))
                    rows.append((int(label[i + k]), x[part].ravel().astype("f4"), weight[part].astype("f4")))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                 pa.array([r[2] for r in rows], pa.list_(pa.float32()))], ["label", "x", "weight"],
            )


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Field:
    """A field from the labelled documents for which `allowed`, a condition on `labels`, holds.

    Labels other than 0 and 1 and null ids are left out; without both labels every text gets the same score.
    Collects the bounded sample of features.
    """
    known = labels.where(allowed & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    some = known.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("label"))
    some = some.groupBy("k").agg(F.max("label").alias("label")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_DOCS)
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    rows = texts.join(F.broadcast(some), "k").select("t", "label")
    chains = rows.mapInArrow(_labelled_chains, "label int, x array<float>, weight array<float>")
    chains = chains.orderBy(F.xxhash64("x", "label")).limit(SAMPLE_CHAINS).toPandas()
    counts = np.array([len(w) for w in chains["weight"]], np.int64)
    x = np.concatenate([*chains["x"]]).reshape(-1, FEATURES).astype(float) if len(chains) else np.zeros((0, FEATURES))
    weight = np.concatenate([*chains["weight"]]).astype(float) if len(chains) else np.zeros(0)
    return train(x, weight, counts, chains["label"].to_numpy(np.int64))


def score(docs: DataFrame, field: Field, text_col: str = "text", name: str = "score") -> DataFrame:
    """All rows and columns of `docs` and the score of their whole text, 0 to 1; a null text is empty.

    A column of that name is replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = [c for c in docs.columns if c != name]
    rows = docs.select(*kept)
    schema = _with_score(rows, name)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [field.score(data, offsets) for _, _, data, offsets in tx.texts(batch, text_col)]
            scores = pa.array(np.concatenate(parts) if parts else np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], schema=pa.schema([*batch.schema, arrow.field(name)]))

    return rows.mapInArrow(run, schema)


def _with_score(rows: DataFrame, name: str):
    from pyspark.sql import types as T

    return T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])
