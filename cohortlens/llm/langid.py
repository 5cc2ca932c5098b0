"""Operator 8: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of lower-cased character 1-, 2- and 3-grams of
whole texts, hashed into 2^14 cells: (1 + log tf) * idf, scaled to unit
length.  Document frequencies come from every training document.  The weights
are trained with follow-the-regularised-leader (per-coordinate rates, an L1
penalty that makes them sparse and an L2 penalty) on a sample of about
``PER_LANGUAGE`` training documents a language, ``MOST_ROWS`` in all at most,
chosen by hash of the id; a fifth of the sample sets the temperature of the
softmax.  The sample is balanced: every language has the same quota, so a rare
one is not crowded out.

Only text and non-null lang of documents whose crc32 remainder is not
``held_out`` are learned from; an id, a source or a language is never an
input of a prediction.

Scale: document frequencies are added up inside each task before one small
shuffle of (cell, count); prediction is one pass without a shuffle.

Defined results: ``und`` with score 0 where the text is null or has no letter,
or where nothing could be learned.  With one language learned, every text
with letters gets it.  Repeated rows score alike; empty tables give empty
results; only the named columns are read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlens.llm.common import id_remainder, python_workers, stored
from cohortlens.llm.shingles import U

BITS = 14
CELLS = 1 << BITS
GRAMS = 3
PER_LANGUAGE = 1500
MOST_ROWS = 20_000
MOST_LANGUAGES = 1000    # the most frequent ones are learned: a weight for each cell and language
SUB_BATCH = 32
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, times) of the hashed character n-grams of each text."""
    lowered = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) for t in lowered], dtype=np.int64)
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    row = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=np.int64(0)))
    counts = np.zeros(len(texts) * CELLS, np.int64)
    code = np.zeros(len(chars), np.uint64)
    for n in range(GRAMS):
        if len(chars) <= n:
            break
        code = code[:len(chars) - n] * U(0x110001) + chars[n:] + U(1)
        whole = row[:len(row) - n] == row[n:] if n else slice(None)
        h = code * U(0x9E3779B97F4A7C15)
        cells = ((h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9) >> U(64 - BITS)).astype(np.int64) + (row[:len(row) - n] << BITS)
        counts += np.bincount(cells[whole], minlength=len(counts))
    at = np.flatnonzero(counts)
    return at >> BITS, at & (CELLS - 1), counts[at]


def vectors(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, value): TF-IDF vectors of unit length."""
    row, cell, times = gram_counts(texts)
    value = (1 + np.log(times)) * idf[cell]
    length = np.sqrt(np.bincount(row, value * value, minlength=len(texts)))
    return row, cell, value / np.maximum(length, 1e-12)[row]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray      # [CELLS, languages]
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, scores = [], []
        for at in range(0, len(texts), SUB_BATCH):
            some = texts[at:at + SUB_BATCH]
            known = np.array([has_letter(t) for t in some]) & bool(self.languages)
            if not self.languages:
                found += [UNKNOWN] * len(some)
                scores += [0.0] * len(some)
                continue
            row, cell, value = vectors(some, self.idf)
            logits = np.stack([np.bincount(row, value * self.weights[cell, k], minlength=len(some))
                               for k in range(len(self.languages))], axis=1) + self.bias
            p = softmax(logits / self.temperature)
            best = p.argmax(axis=1)
            found += [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            scores += np.where(known, p.max(axis=1), 0.0).tolist()
        return found, np.array(scores)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(cells: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, classes: int, rate: float = 0.5,
         beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 5, seed: int = 7):
    """Weights [CELLS + 1, classes] of a softmax model (the last row is the
    bias, unpenalised): each coordinate follows the regularised leader."""
    z = np.zeros((CELLS + 1, classes))
    n = np.zeros((CELLS + 1, classes))
    penalty = np.full((CELLS + 1, 1), l1)
    penalty[CELLS] = 0

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= penalty[at], 0,
                        (np.sign(zs) * penalty[at] - zs) / ((beta + np.sqrt(n[at])) / rate + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at = np.append(cells[i], CELLS)
            x = np.append(values[i], 1.0)
            w = weights(at)
            slope = softmax(x @ w)
            slope[y[i]] -= 1
            g = x[:, None] * slope
            squared = n[at] + g * g
            z[at] += g - (np.sqrt(squared) - np.sqrt(n[at])) / rate * w
            n[at] = squared
    return weights(np.arange(CELLS + 1))


def temperature_of(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, on a grid of powers."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(10), 200))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _training(docs: DataFrame, modulus: int, held_out: int) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), modulus) != held_out)) \
        .select("doc_id", "text", "lang")


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(per cell the documents that have it, number of documents)."""
    def run(batches):
        total = np.zeros(CELLS + 1, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            total[CELLS] += len(texts)
            for at in range(0, len(texts), SUB_BATCH):
                total[:CELLS] += np.bincount(gram_counts(texts[at:at + SUB_BATCH])[1], minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    frequency = np.zeros(CELLS + 1, np.int64)
    for r in (docs.select("text").mapInArrow(run, "cell bigint, n bigint")
              .groupBy("cell").agg(F.sum("n").alias("n")).collect()):   # at most CELLS + 1 rows
        frequency[r.cell] = r.n
    return frequency[:CELLS], int(frequency[CELLS])


def balanced_sample(training: DataFrame, per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, lang, text): about as many documents of every language - the
    quota, at most ``per_language`` and at most its share of ``most_rows`` - by
    hash of the id, each id once (of its texts the smallest).  Rows meet their
    language's size by broadcast: no shuffle by language."""
    sizes = (training.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
             .orderBy(F.desc("_n"), "lang").limit(MOST_LANGUAGES))
    sizes = stored(sizes, "langid-sizes")
    quota = min(per_language, 0.9 * most_rows / max(1, sizes.count()))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    chosen = (training.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(place * F.col("_n") < quota)
              .select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
              .orderBy(F.xxhash64("_id"), "_id", "_lang").limit(most_rows))
    return (training.join(F.broadcast(chosen), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
            .groupBy("doc_id", "lang").agg(F.min("text").alias("text")))     # at most most_rows groups


def fit(docs: DataFrame, modulus: int = 5, held_out: int = 0, per_language: int = PER_LANGUAGE) -> Model:
    python_workers(docs.sparkSession)
    training = _training(docs, modulus, held_out)
    frequency, n = document_frequencies(training)
    idf = np.log((1 + n) / (1 + frequency)) + 1
    sample = balanced_sample(training, per_language)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SUB_BATCH):
                some = batch.slice(at, SUB_BATCH)
                row, cell, value = vectors(some.column("text").to_pylist(), idf)
                cuts = np.searchsorted(row, np.arange(1, some.num_rows))
                yield pa.RecordBatch.from_arrays([
                    some.column("doc_id"), some.column("lang"),
                    pa.array([c.astype(np.int32).tobytes() for c in np.split(cell, cuts)], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for v in np.split(value, cuts)], pa.binary()),
                ], names=["doc_id", "lang", "cells", "values"])

    got = sample.mapInArrow(run, "doc_id bigint, lang string, cells binary, values binary").collect()
    got.sort(key=lambda r: (unicodedata.normalize("NFC", r.lang), r.lang, r.doc_id is None, r.doc_id or 0, r.cells))
    languages = sorted({r.lang for r in got})
    if not languages:
        return Model([], np.zeros((CELLS, 0)), np.zeros(0), idf, 1.0)
    y = np.array([languages.index(r.lang) for r in got])
    cells = [np.frombuffer(r.cells, np.int32).astype(np.intp) for r in got]
    values = [np.frombuffer(r.values, np.float32).astype(float) for r in got]
    tune = np.arange(len(got)) % 5 == 0
    train = np.flatnonzero(~tune) if (~tune).any() else np.arange(len(got))
    w = ftrl([cells[i] for i in train], [values[i] for i in train], y[train], len(languages))
    logits = np.array([values[i] @ w[cells[i]] + w[CELLS] for i in np.flatnonzero(tune)]).reshape(-1, len(languages))
    return Model(languages, w[:CELLS].astype(np.float32), w[CELLS], idf, temperature_of(logits, y[tune]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (its other columns too) with lang_pred and score; ``text`` goes."""
    python_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in keep]
                          + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            found, score = shared.value.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.string()), pa.array(score, pa.float64())],
                names=[*keep, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], "text").mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the query."""
    return predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang"))).select(
        "doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")
