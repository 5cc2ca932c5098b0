"""Operator 3: toxicity by the nearest labelled examples.

Texts are TF-IDF vectors over all their words and word beginnings (of 4, 5 and
6 bytes, so that unseen inflections meet known ones); two and three occurrences
in a text are terms of their own.  No term is left out: inverse document
frequencies count all documents, and a vector's length is that of the whole
text.  A term's weight is its TF-IDF times ``BASE`` plus what its log-odds
between the labels are beyond ``SURE`` standard errors (0 for most terms; the
odds are taken within each label, so the balance of the labels doesn't count).
The nearest ``NEIGHBOURS`` examples by exact cosine come from a block-max
inverted index: examples lie in blocks of ``BLOCK``, alike ones together, and the
largest weights of a block bound its cosines; blocks that cannot beat the nearest
found aren't read.  Neighbours vote with weight 1 / (distance + 0.05), against a prior of
the sample's label shares; a logistic fit on labelled rows outside the index
turns votes into probabilities.  The neighbours are the evidence.

The sample has at most ``TRAIN_ROWS`` labelled rows, the index at most
``EXAMPLES`` of them (documented bounds, chosen by hash of the id), so the
index is broadcast, with the terms of the sample.  Document frequencies of
these are one pass over all documents, scoring another.  Terms outside the
sample meet no example and count in a text's length only: scoring writes them
beside the neighbours, and a join with their document frequencies (over the
scored documents) completes the length.  No text is shuffled.

Defined results: a text without words (null and empty ones too), or without a
term of any example, has no neighbour and scores the calibrated prior.  Equal cosines: the smaller
example id is nearer.  Labels other than 0 and 1 are ignored; without both
classes every score is the share of label 1 (0.5 without labels).  Repeated
rows score alike; empty tables give empty results; only the named columns are
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlens.llm.arrays import labelled_sample, parts
from cohortlens.llm.common import id_remainder, python_workers, stored
from cohortlens.llm.nbsvm import logistic_map
from cohortlens.llm.shingles import U, mix, word_spans

TRAIN_ROWS = 12_000
EXAMPLES = 4096
BASE = 0.1
SURE = 3.0
BLOCK = 64
GROUP = 16          # blocks that have their common terms in common
DENSE = 2048        # the most common terms of a group, kept as a matrix
DENSE_LEAST = 24
AXIS_TERMS, AXIS_STEPS = 1024, 6
NEIGHBOURS = 16
PREFIXES = (4, 5, 6)
REPEATS = 3
NEAR = 0.05
PRIOR = 2.0
SUB_BATCH = 64
THRESHOLD = 0.7
_LOW = U(255)       # bits of a hash that give way to a row or a repeat number


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and word beginning, in no order."""
    row, begin, size, spans = word_spans(texts)
    found = [(row, mix(spans(begin, begin + size) + size.astype(U)))]
    for k in PREFIXES:
        longer = size > k
        found.append((row[longer], mix(spans(begin[longer], begin[longer] + k) ^ U(0xA5A5 + k))))
    return np.concatenate([r for r, _ in found]), np.concatenate([h for _, h in found])


class Vocabulary:
    """Terms (hash, k): a hash that occurs at least k times in a text."""

    def __init__(self, hashes: np.ndarray, least: np.ndarray):
        self.size = len(hashes)
        hashes = hashes.astype(U) & ~_LOW
        self.hashes = np.unique(hashes)
        self.term = np.full((len(self.hashes), REPEATS), -1, np.int32)   # number of (hash, k), or -1
        self.term[np.searchsorted(self.hashes, hashes), least - 1] = np.arange(self.size)

    def _found(self, texts: pa.Array):
        """Of the different (row, hash) of at most 256 texts: row, hash, times, and
        for each k that times reaches which of them they are (None: all) and their terms, or -1."""
        row, value = terms(texts)
        both = np.sort((value & ~_LOW) | row.astype(U))
        edges = np.flatnonzero(np.diff(both, prepend=~both[:1]) != 0)
        times = np.diff(np.append(edges, len(both)))
        both = both[edges]
        row, value = (both & _LOW).astype(np.uint8), both & ~_LOW
        at, known = np.zeros(len(value), np.int64), np.zeros(len(value), bool)
        if self.size and len(value):
            at = np.minimum(np.searchsorted(self.hashes, value), len(self.hashes) - 1)
            known = self.hashes[at] == value
        reach = []
        for k in range(REPEATS):
            which = None if k == 0 else np.flatnonzero(times > k)
            some = slice(None) if which is None else which
            number = np.where(known[some], self.term[at[some], k], -1) if self.size else np.full(len(at[some]), -1)
            reach.append((which, number))
        return row, value, times, reach

    def split(self, texts: pa.Array):
        """(row, term, times), ordered by row, and (row, hash and k, times) of
        the terms outside the vocabulary; at most 256 texts."""
        row, value, times, reach = self._found(texts)
        inside, outside = [], []
        for k, (which, number) in enumerate(reach):
            for here, keep in ((inside, number >= 0), (outside, number < 0)):
                at = np.flatnonzero(keep)
                origin = at if which is None else which[at]
                here.append((row[origin], number[at].astype(np.int64) if here is inside else value[origin] | U(k + 1), times[origin]))
        known, others = (tuple(np.concatenate(c) for c in zip(*parts)) for parts in (inside, outside))
        order = np.argsort(known[0], kind="stable")          # of bytes: counted, not compared
        return (known[0][order].astype(np.int64), known[1][order], known[2][order]), others

    def held(self, texts: pa.Array) -> list[np.ndarray]:
        """The terms that texts hold, each once per text."""
        return [number[number >= 0] for _, number in self._found(texts)[3]]

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, times), ordered by row."""
        return self.split(texts)[0]


def repeated_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, k) for every k up to REPEATS that the hash's count reaches."""
    row, value = terms(texts)
    order = np.lexsort((row, value))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    times = np.minimum(np.diff(np.append(at, len(row))), REPEATS)
    which = np.repeat(at, times)
    return row[which], value[which], np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + 1


# --- block-max inverted index --------------------------------------------------

def alike_together(rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int) -> np.ndarray:
    """An order of the examples (term, weight) in which alike ones are neighbours:
    they are halved again and again along their main axis, down to blocks.  It
    decides how many blocks a search can leave out, never what it finds."""
    size = len(rows)
    if size <= BLOCK:
        return np.arange(size)
    term = np.concatenate([t for t, _ in rows])
    example = np.repeat(np.arange(size), [len(t) for t, _ in rows])
    common = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:AXIS_TERMS]
    column = np.full(n_terms, -1)
    column[common] = np.arange(len(common))
    seen = column[term] >= 0
    matrix = np.zeros((size, len(common)), np.float32)
    matrix[example[seen], column[term[seen]]] = np.concatenate([w for _, w in rows])[seen]
    out, todo = [], [np.arange(size)]
    while todo:
        part = todo.pop()
        if len(part) <= BLOCK:
            out.append(part)
            continue
        centred = matrix[part]
        centred -= centred.mean(axis=0)
        axis = np.cos(np.arange(len(common), dtype=np.float32))
        for _ in range(AXIS_STEPS):
            axis = (centred @ axis) @ centred
            axis /= max(float(np.linalg.norm(axis)), 1e-20)
        part = part[np.argsort(centred @ axis, kind="stable")]
        del centred
        half = -(-len(part) // (2 * BLOCK)) * BLOCK
        todo += [part[half:], part[:half]]
    return np.concatenate(out)


class BlockGroup:
    """Blocks of examples alike: the weights of their common terms as a matrix
    with each block's largest weights, the others as postings."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.blocks = -(-len(rows) // BLOCK)
        term = np.concatenate([t for t, _ in rows])
        weight = np.concatenate([w for _, w in rows])
        example = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t, _ in rows])
        n = np.bincount(term, minlength=n_terms)
        common = np.argsort(-n, kind="stable")[:DENSE]
        column = np.full(n_terms, -1, np.int32)
        common = common[n[common] >= DENSE_LEAST]
        column[common] = np.arange(len(common))
        dense = column[term] >= 0
        self.cells = column[term[dense]], example[dense], weight[dense]
        self.width = len(common)
        order = np.lexsort((example[~dense], term[~dense]))
        self.example, self.weight = example[~dense][order].astype(np.int16), weight[~dense][order]
        self.common = common.astype(np.int32)                       # the terms of the columns
        self.terms = np.flatnonzero((column < 0) & (n > 0)).astype(np.int32)   # those with postings,
        self.counts = n[self.terms].astype(np.int16)                # and how many
        self.matrix = self.bound = None

    def __getstate__(self):
        return self.__dict__ | {"matrix": None, "bound": None}   # made again where it is used

    def places(self, n_terms: int) -> np.ndarray:
        """Where each term is: column of the matrix or -1, begin and number of its postings."""
        out = np.zeros((n_terms, 3), np.int32)
        out[:, 0] = -1
        out[self.common, 0] = np.arange(self.width)
        out[self.terms, 1] = np.cumsum(self.counts, dtype=np.int64) - self.counts
        out[self.terms, 2] = self.counts
        return out

    def fill(self) -> None:
        if self.matrix is None:
            self.matrix = np.zeros((self.blocks * BLOCK, self.width))
            self.matrix[self.cells[1], self.cells[0]] = self.cells[2]
            self.bound = self.matrix.reshape(self.blocks, BLOCK, self.width).max(axis=1)

    def begin(self, n: int, row: np.ndarray, place: np.ndarray, weight: np.ndarray):
        """(queries over the common terms, cosines by the other terms alone, and
        what each block's cosines are at most) of n vectors, whose terms' places
        are given."""
        self.fill()
        column = place[:, 0]
        dense = np.flatnonzero(column >= 0)
        query = np.zeros((n, self.width))
        query[row[dense], column[dense]] = weight[dense]
        held = np.flatnonzero(place[:, 2])
        begin, many, row, weight = place[held, 1], place[held, 2], row[held], weight[held]
        total = np.cumsum(many, dtype=np.int64)
        at = np.arange(total[-1] if len(total) else 0) + np.repeat(begin - total + many, many)
        places = self.blocks * BLOCK
        score = np.bincount(np.repeat(row * places, many) + self.example[at],
                            np.repeat(weight, many) * self.weight[at], n * places).astype(float).reshape(n, self.blocks, BLOCK)
        return query, score, query @ self.bound.T + score.max(axis=2)


class BlockMaxIndex:
    """Unit vectors of examples, alike ones in a block, blocks in groups."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.size = len(rows)
        self.blocks = -(-self.size // BLOCK)
        self.number = alike_together(rows, n_terms)     # the example at each place
        at = [self.number[i:i + GROUP * BLOCK] for i in range(0, self.size, GROUP * BLOCK)]
        self.groups = [BlockGroup([rows[i] for i in part], n_terms) for part in at]
        self.n_terms, self.places = n_terms, None

    def __getstate__(self):
        return self.__dict__ | {"places": None}   # made again where it is used

    def nearest_many(self, vectors, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per vector (term, weight): (example, cosine) of the k highest
        positive cosines, ties to the smaller example: exact, though blocks
        whose bound cannot reach the k-th are left out."""
        n = len(vectors)
        if not n or not self.size:
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        row = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        term = np.concatenate([t for t, _ in vectors]).astype(np.int64)
        weight = np.concatenate([w for _, w in vectors])
        if self.places is None:    # of a term, those of all groups beside each other
            self.places = np.stack([g.places(self.n_terms) for g in self.groups], axis=1)
        place = self.places[term]
        begun = [group.begin(n, row, place[:, g], weight) for g, group in enumerate(self.groups)]
        score = np.concatenate([s for _, s, _ in begun], axis=1)
        bounds = np.concatenate([b for *_, b in begun], axis=1)
        read = np.zeros((n, self.blocks), bool)
        best = np.zeros((n, k))               # the k highest so far, the k-th first
        for b in np.argsort(-bounds.sum(axis=0), kind="stable"):
            some = np.flatnonzero((bounds[:, b] > 0) & (bounds[:, b] >= best[:, 0] - 1e-9))   # ties may be of smaller id
            if len(some):
                g, at = divmod(int(b), GROUP)
                found = begun[g][0][some] @ self.groups[g].matrix[at * BLOCK:(at + 1) * BLOCK].T
                found += score[some, b]
                score[some, b] = found
                read[some, b] = True
                best[some] = np.partition(np.concatenate([best[some], found], axis=1), BLOCK, axis=1)[:, BLOCK:]
        out = []
        for s, f, seen in zip(score, best[:, 0], read):
            blocks = np.flatnonzero(seen)
            s = s[blocks]
            hit = np.flatnonzero((s > 0) & (s >= f - 1e-11))
            cos, hit = np.round(s.ravel()[hit], 12), self.number[blocks[hit // BLOCK] * BLOCK + hit % BLOCK]
            order = np.lexsort((hit, -cos))[:k]
            order = order[cos[order] > 0]
            out.append((hit[order], cos[order]))
        return out

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.nearest_many([(term, weight)], k)[0]


@dataclass
class Model:
    vocabulary: Vocabulary
    idf: np.ndarray          # times the term's emphasis
    index: BlockMaxIndex
    ids: np.ndarray          # of the examples
    labels: np.ndarray
    share: float             # of label 1 in the sample
    documents: int = 0
    slope: float = 0.0
    offset: float = 0.0
    shared: object = None    # the broadcast of index and vocabulary, once made

    def parts_of(self, texts: pa.Array):
        """Vectors over the vocabulary scaled to length 1, their lengths before,
        and (row, hash and k, times) of the other terms."""
        (row, term, times), others = self.vocabulary.split(texts)
        weight = (1 + np.log(np.maximum(times, 1))) * self.idf[term] if len(term) else np.zeros(0)
        length = np.sqrt(np.bincount(row, weight * weight, minlength=len(texts)))
        weight = weight / np.maximum(length, 1e-12)[row] if len(row) else weight
        cuts = np.searchsorted(row, np.arange(1, len(texts)))
        return list(zip(np.split(term, cuts), np.split(weight, cuts))), length, others

    def vote(self, at: np.ndarray, cos: np.ndarray) -> float:
        vote = 1 / (1 - np.minimum(cos, 1) + NEAR)
        ones = vote[self.labels[at] == 1].sum() + PRIOR * self.share
        zeros = vote[self.labels[at] == 0].sum() + PRIOR * (1 - self.share)
        return float(np.log(max(ones, 1e-6) / max(zeros, 1e-6)))

    def votes(self, vectors) -> np.ndarray:
        return np.array([self.vote(*near) for i in range(0, len(vectors), SUB_BATCH)
                         for near in self.index.nearest_many(vectors[i:i + SUB_BATCH], NEIGHBOURS)])

    def probabilities(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * votes + self.offset, -500, 500)))


# --- on Spark ------------------------------------------------------------------

def emphasis(n: np.ndarray, ones: np.ndarray, size: int, size_ones: int) -> np.ndarray:
    """Per term, held by n sample rows, ones of them of label 1: BASE plus its
    absolute log-odds between the labels as far as they exceed SURE errors."""
    if not 0 < size_ones < size:
        return np.full(len(n), BASE)
    a, b = ones + 0.5, n - ones + 0.5
    odds = np.log(a / (size_ones + 1 - a)) - np.log(b / (size - size_ones + 1 - b))
    error = np.sqrt(1 / a + 1 / b + 1 / (size_ones + 1 - a) + 1 / (size - size_ones + 1 - b))
    return BASE + np.maximum(0, np.abs(odds) - SURE * error)


def sample_terms(sample: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """All terms of the sample, whose rows are bounded, and their emphasis."""
    def run(batches):
        for batch in batches:
            y = np.array(batch.column("y").to_pylist(), np.int64)
            row, value, least = repeated_terms(batch.column("text"))
            cells, which = np.unique((value & ~_LOW) | least.astype(U), return_inverse=True)
            n = len(cells)
            yield pa.RecordBatch.from_arrays([
                pa.array(cells.view(np.int64)), pa.array(np.bincount(which, minlength=n).astype(np.int64)),
                pa.array(np.bincount(which, y[row], minlength=n).astype(np.int64))], names=["cell", "n", "ones"])

    size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("ones")).first()
    got = (sample.select("text", "y").mapInArrow(run, "cell bigint, n bigint, ones bigint")
           .groupBy("cell").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).toArrow())
    cell, n, ones = (got.column(c).to_numpy() for c in ("cell", "n", "ones"))
    order = np.argsort(cell)
    cell = cell[order].view(U)
    return (Vocabulary(cell & ~_LOW, (cell & _LOW).astype(np.int64)),
            emphasis(n[order], ones[order], size.n, size.ones))


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, int]:
    """Documents per vocabulary term, over all documents, and their number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    size = vocabulary.size

    def run(batches):
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            total[size] += batch.num_rows
            held = [n for some in parts(batch.column(0), SUB_BATCH) for n in shared.value.held(some)]
            if held:
                total[:size] += np.bincount(np.concatenate(held), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    frequency = np.zeros(size + 1, np.int64)
    got = (docs.select("text").mapInArrow(run, "term bigint, n bigint")
           .groupBy("term").agg(F.sum("n").alias("n")).toArrow())   # at most a row for each term, and one
    frequency[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return frequency[:size], int(frequency[size])


def places(rows: list[tuple[int, int, bool]], examples: int = EXAMPLES) -> tuple[list[int], list[int]]:
    """rows: (number, label, has words), in hash order.  Numbers of the rows in
    the index, three of four as far as it has room, rows of label 1 first, and
    of the others, which set the map from votes to probabilities."""
    rows = sorted(rows, key=lambda r: -r[1])   # stable: keeps hash order within a label
    kept = [r for i, r in enumerate(rows) if i % 4 and r[2]]
    ones, zeros = [r[0] for r in kept if r[1] == 1], [r[0] for r in kept if r[1] == 0]
    half = max(examples // 2, examples - len(zeros))
    inside = ones[:half] + zeros[:examples - min(half, len(ones))]
    return inside, [r[0] for i, r in enumerate(rows) if i % 4 == 0]


def _only(batch: pa.RecordBatch, numbers: np.ndarray) -> pa.RecordBatch:
    return batch.filter(pa.array(np.isin(batch.column("_row").to_numpy(), numbers)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 3, held_out: int = 1,
        rows: int = TRAIN_ROWS) -> Model:
    python_workers(docs.sparkSession)
    share_out = docs.sparkSession.sparkContext.broadcast
    sample = stored(labelled_sample(docs, labels, label, rows, modulus, held_out)
                    .withColumn("_row", F.monotonically_increasing_id()), "toxicity-sample")
    vocabulary, emphases = sample_terms(sample)
    frequency, n = document_frequencies(docs, vocabulary)
    idf = (np.log((1 + n) / (1 + frequency)) + 1) * emphases
    has_words = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]"), F.lit(False))
    keys = (sample.select("_row", "y", has_words.alias("words"), "doc_id", F.xxhash64("text").alias("_text"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "y", "_text").limit(rows).collect())   # bounded by rows
    inside, outside = (np.array(x, np.int64) for x in places([(r._row, r.y, r.words) for r in keys]))
    share = float(np.mean([r.y for r in keys])) if keys else 0.5
    none = np.zeros(0, np.int64)
    model = Model(vocabulary, idf, BlockMaxIndex([], vocabulary.size), none, none, share, n)
    blank = share_out(model)

    def vectors(batches):
        for batch in batches:
            batch = _only(batch, inside)
            made = [v for some in parts(batch.column("text"), SUB_BATCH) for v in blank.value.parts_of(some)[0]]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("y"),
                pa.array([t.astype(np.int32).tobytes() for t, _ in made], pa.binary()),
                pa.array([w.astype(np.float64).tobytes() for _, w in made], pa.binary())],
                names=["doc_id", "y", "term", "weight"])

    got = (sample.mapInArrow(vectors, "doc_id bigint, y int, term binary, weight binary")
           .toArrow().sort_by([("doc_id", "ascending"), ("y", "descending"), ("term", "ascending")]))   # EXAMPLES rows
    made = [(np.frombuffer(t.as_buffer(), np.int32), np.frombuffer(w.as_buffer(), np.float64))
            for t, w in zip(got.column("term"), got.column("weight"))]
    model = Model(vocabulary, idf, BlockMaxIndex(made, vocabulary.size), got.column("doc_id").to_numpy(),
                  got.column("y").to_numpy().astype(np.int64), share, n)
    del got, made
    blank.unpersist()
    model.shared = shared = share_out(model)

    def votes(batches):
        for batch in batches:
            batch = _only(batch, outside)
            made = [v for some in parts(batch.column("text"), SUB_BATCH) for v in shared.value.parts_of(some)[0]]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("y"),
                                              pa.array(shared.value.votes(made), pa.float64())], names=["_row", "y", "vote"])

    seen = sample.mapInArrow(votes, "_row bigint, y int, vote double").toArrow().sort_by("_row")
    y = seen.column("y").to_numpy().astype(np.int64)
    if len(set(y.tolist())) == 2:
        model.slope, model.offset = logistic_map(seen.column("vote").to_numpy(), y)
    else:
        model.offset = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    return model


def _neighbours(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: its number, the nearest examples with the cosines that the
    vocabulary alone gives, that part's length, and the other terms."""
    shared = model.shared or docs.sparkSession.sparkContext.broadcast(model)
    pair = pa.list_(pa.struct([("term", pa.int64()), ("tf", pa.float64())]))

    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 33
        m = shared.value
        for batch in batches:
            at, cos, lengths, others = [], [], [], []
            for some in parts(batch.column(1), SUB_BATCH):
                vectors, length, (row, term, times) = m.parts_of(some)
                for a, c in m.index.nearest_many(vectors, NEIGHBOURS):
                    at.append(a.astype(np.int32))
                    cos.append(c)
                lengths.append(length)
                order = np.argsort(row, kind="stable")    # of bytes, like the rows of split
                tf = 1 + np.log(np.maximum(times, 1))
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(some)))]).astype(np.int32)
                others.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
                    [pa.array(term[order].view(np.int64)), pa.array(tf[order])], names=["term", "tf"])).cast(pair))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(number + np.arange(batch.num_rows)), pa.array(at, pa.list_(pa.int32())),
                pa.array(cos, pa.list_(pa.float64())), pa.array(np.concatenate([np.zeros(0), *lengths])),
                pa.concat_arrays(others) if others else pa.array([], pair)],
                names=["doc_id", "_row", "_at", "_cos", "_length", "_others"])
            number += batch.num_rows

    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("_row", T.LongType()), T.StructField("_at", T.ArrayType(T.IntegerType())),
        T.StructField("_cos", T.ArrayType(T.DoubleType())), T.StructField("_length", T.DoubleType()),
        T.StructField("_others", T.ArrayType(T.StructType([
            T.StructField("term", T.LongType()), T.StructField("tf", T.DoubleType())])))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, score, predicted and the evidence: (example, label, cosine)
    of the nearest labelled examples."""
    spark = docs.sparkSession
    python_workers(spark)
    found = stored(_neighbours(docs, model), "toxicity-neighbours")
    others = found.where(F.size("_at") > 0).select("_row", F.explode("_others").alias("_o")).select("_row", "_o.*")
    every = found.select(F.explode("_others.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    weight = F.col("tf") * BASE * (F.log((1.0 + F.greatest(F.lit(model.documents), F.col("n"))) / (1.0 + F.col("n"))) + 1)
    lengths = (others.join(every, "term").groupBy("_row")
               .agg(F.round(F.sum(weight * weight), 9).alias("_rest")))
    whole = (found.drop("_others").join(lengths, "_row", "left")
             .select("doc_id", "_at", "_cos", "_length", F.coalesce("_rest", F.lit(0.0)).alias("_rest")))
    small = Model(Vocabulary(np.zeros(0, U), np.zeros(0, int)), np.zeros(0), BlockMaxIndex([], 0), model.ids,
                  model.labels, model.share, model.documents, model.slope, model.offset)
    shared = spark.sparkContext.broadcast(small)
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
        T.StructField("evidence", T.ArrayType(T.StructType([
            T.StructField("doc_id", T.LongType()), T.StructField("label", T.IntegerType()),
            T.StructField("cosine", T.DoubleType())])))])
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        m = shared.value
        for batch in batches:
            length, rest = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            part = length / np.sqrt(np.maximum(length * length + rest, 1e-24))
            near = [(np.array(a, np.int64), np.array(c) * p) for a, c, p in zip(
                batch.column(1).to_pylist(), batch.column(2).to_pylist(), part)]
            p = m.probabilities(np.array([m.vote(a, c) for a, c in near]))
            evidence = [[{"doc_id": int(m.ids[i]), "label": int(m.labels[i]), "cosine": float(x)}
                         for i, x in zip(a, c)] for a, c in near]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(evidence, kind)],
                names=["doc_id", "score", "predicted", "evidence"])

    return whole.mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns of the query."""
    return score(docs, fit(docs, labels)).select(
        "doc_id", (id_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
