"""Operator 4: quality classifier - naive Bayes support vectors.

A text's features are indicators of hashed n-grams of whole texts: token
uni- and bigrams, and uni-, bi- and trigrams of token shapes (kind of token,
case, length class, whether a word repeats the word before it), which carry
over to words never seen.  ``fit`` scales each indicator by the log-count
ratio of the two classes and trains a linear model with hinge loss by dual
coordinate descent on most of a sample of labelled rows; the rest of the
sample turns margins into probabilities (a logistic fit).

The fit uses at most ``TRAIN_ROWS`` labelled rows (a documented bound, chosen
by hash of the id); scoring is one pass over all documents without a shuffle.

Defined results: a null or empty text has no features and scores what an
empty text scores by the model's bias.  Labels other than 0 and 1 are
ignored; without rows of both classes the score is the share of label 1 in
the sample (0.5 without rows).  Repeated rows score alike.  Empty tables give
empty results.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlens.llm.arrays import first_occurrences, labelled_sample, parts, text_bytes
from cohortlens.llm.common import id_remainder, python_workers
from cohortlens.llm.shingles import U, _powers, mix

TRAIN_ROWS = 6000
BITS = 18
SUB_BATCH = 32
THRESHOLD = 0.7


# --- features ----------------------------------------------------------------

def _byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, lower = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    case = np.zeros(256, np.uint8)   # bits: 1 lower, 2 upper, 4 digit, 8 other letter byte
    for b in range(256):
        if b >= 0x80 or chr(b).isalnum():
            kind[b] = 1
            case[b] = 8 if b >= 0x80 else 4 if chr(b).isdigit() else 2 if chr(b).isupper() else 1
            lower[b] = b + 32 if case[b] == 2 else b
        elif b > 0x20 and b != 0x7F:
            kind[b] = 2
    return kind, lower, case


KIND, LOWER, CASE = _byte_tables()


def _tokens(raw: np.ndarray, ends: np.ndarray):
    """(row, hash, shape) of each token: a run of word bytes or of marks."""
    kind = np.append(KIND[raw], 0)
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[ends[ends < len(raw)]] = True
    begin = np.flatnonzero(change)
    token = np.flatnonzero(kind[begin] > 0)
    at, stop = begin[token], begin[np.minimum(token + 1, len(begin) - 1)]
    low = LOWER[raw]
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((low.astype(U) + U(1)) * up[:len(raw)], out=total[1:])
    value = mix((total[stop] - total[at]) * down[at] + (stop - at).astype(U))
    row = np.repeat(np.arange(len(ends)), np.diff(np.searchsorted(at, ends), prepend=0))
    case = CASE[raw]
    has = np.bitwise_or.reduceat(case, at) if len(at) else case[:0]   # blanks after a token add no bit
    word = kind[at] == 1
    first_upper = (case[at] == 2).astype(np.uint64)
    length = np.minimum(np.log2(np.maximum(stop - at, 1)).astype(np.int64), 7)
    shape = (word.astype(U) | (has.astype(U) << U(1)) | (first_upper << U(6)) | (length.astype(U) << U(8)))
    shape = np.where(word, shape, mix(value | U(1)))   # a mark is its own shape
    words = np.flatnonzero(word)
    if len(words) > 1:
        again = (value[words[1:]] == value[words[:-1]]) & (row[words[1:]] == row[words[:-1]])
        shape[words[1:]] |= again.astype(U) << U(12)
    return row, value, mix(shape)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every indicator that is set, each once."""
    raw, ends = text_bytes(texts)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, value, shape = _tokens(raw, ends)
    rows, codes = [row, row], [value, shape + U(1)]
    two = np.flatnonzero(row[1:] == row[:-1]) if len(row) > 1 else np.zeros(0, np.int64)
    three = two[:-1][np.diff(two) == 1] if len(two) > 1 else np.zeros(0, np.int64)
    rows += [row[two], row[two], row[three]]
    codes += [mix(value[two] * U(3) + value[two + 1]), mix(shape[two] * U(5) + shape[two + 1]),
              mix(shape[three] * U(7) + shape[three + 1] * U(11) + shape[three + 2])]
    rows, codes = np.concatenate(rows), np.concatenate(codes)
    cells = (rows << BITS) | (codes >> U(64 - BITS)).astype(np.int64)
    cells = cells[first_occurrences(cells, len(texts) << BITS)]
    return cells >> BITS, cells & ((1 << BITS) - 1)


# --- model -------------------------------------------------------------------

@dataclass(frozen=True)
class Model:
    weights: np.ndarray     # per feature: log-count ratio times trained weight
    bias: float
    slope: float            # of the logistic map from margin to probability
    offset: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = []
        for some in parts(texts, SUB_BATCH):
            row, feature = features(some)
            n = np.bincount(row, minlength=len(some))
            total = np.bincount(row, self.weights[feature], minlength=len(some))
            out.append(total / np.sqrt(np.maximum(n, 1)) + self.bias)
        return np.concatenate(out) if out else np.zeros(0)

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    count = {c: alpha + np.bincount(np.concatenate([r for r, k in zip(rows, y) if k == c]), minlength=1 << BITS)
             for c in (0, 1)}
    return np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray,
                            epochs: int = 40, tolerance: float = 1e-2, seed: int = 7) -> tuple[np.ndarray, float]:
    """Hinge loss with L2 penalty: min 1/2|w|^2 + sum cost_i max(0, 1 - y_i w.x_i).
    A row that stays at a bound of its dual variable sits out until the rest
    has converged; then all rows are gone through again."""
    w, b = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([np.dot(v, v) + 1 for v in values])
    rng = np.random.default_rng(seed)
    active, whole = np.arange(len(rows)), True
    for _ in range(epochs):
        worst, stay = 0.0, []
        for i in rng.permutation(active):
            at, x = rows[i], values[i]
            slope = y[i] * (np.dot(w[at], x) + b) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            change = abs(new - alpha[i]) * square[i]
            if change:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                b += step
                alpha[i] = new
                worst = max(worst, change)
            if change or 0 < new < cost[i]:
                stay.append(i)
        if worst < tolerance:
            if whole:
                break
            active, whole = np.arange(len(rows)), True
        else:
            active, whole = np.array(stay), False
    return w, b


def logistic_map(margins: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of P(y = 1 | margin), by Newton steps on smoothed targets."""
    ones = y.sum()
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([(p - target) @ margins, (p - target).sum()]) + 1e-3 * np.array([a - 1, b])
        s = p * (1 - p)
        h = np.array([[s @ margins ** 2, s @ margins], [s @ margins, s.sum()]]) + 1e-3 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(a), float(b)


def fit_rows(rows: list[np.ndarray], y: np.ndarray, penalty: float = 1.0) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2 or min(np.bincount(y)) < 2:
        logit = np.log((share + 1e-6) / (1 - share + 1e-6))
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(logit))
    calibrate = np.zeros(len(y), bool)
    for c in (0, 1):
        calibrate[np.flatnonzero(y == c)[::4]] = True   # every 4th row of a class; rows come in hash order
    train = np.flatnonzero(~calibrate)
    rows = [r.astype(np.intp) for r in rows]
    ratio = log_count_ratios([rows[i] for i in train], y[train])
    scaled = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    sign = 2 * y[train] - 1
    weight = len(train) / (2 * np.bincount(y[train], minlength=2))   # classes weigh alike
    w, b = dual_coordinate_descent([rows[i] for i in train], [scaled[i] for i in train], sign,
                                   penalty * weight[y[train]])
    margins = np.array([w[r] @ v + b for r, v in zip(rows, scaled)])
    slope, offset = logistic_map(margins[calibrate], y[calibrate])
    return Model((w * ratio).astype(np.float32), float(b), slope, offset)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held_out: int = 2,
        rows: int = TRAIN_ROWS) -> Model:
    """The model of a sample of at most ``rows`` labelled documents."""
    python_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SUB_BATCH):
                some = batch.slice(at, SUB_BATCH)
                row, feature = features(some.column(1))
                order = np.argsort(row, kind="stable")
                cuts = np.searchsorted(row[order], np.arange(1, some.num_rows))
                yield pa.RecordBatch.from_arrays([
                    some.column(0), some.column(2),
                    pa.array([f.astype(np.int32).tobytes() for f in np.split(feature[order], cuts)], pa.binary()),
                ], names=["doc_id", "y", "features"])

    sample = labelled_sample(docs, labels, label, rows, modulus, held_out).mapInArrow(
        run, "doc_id bigint, y int, features binary")
    got = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "features").limit(rows).collect()
    return fit_rows([np.frombuffer(r.features, np.int32) for r in got], np.array([r.y for r in got], int))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, score: str = "score",
          predicted: str = "predicted") -> DataFrame:
    """``docs`` (all its other columns) with the columns ``score`` (double)
    and ``predicted`` (int)."""
    spark = docs.sparkSession
    python_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in (score, predicted)]
    at = keep.index("text")
    schema = T.StructType([docs.schema[c] for c in keep]
                          + [T.StructField(score, T.DoubleType()), T.StructField(predicted, T.IntegerType())])

    def run(batches):
        for batch in batches:
            p = shared.value.probabilities(shared.value.margins(batch.column(at)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())],
                names=[*batch.schema.names, score, predicted])

    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns of the query."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        "doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
