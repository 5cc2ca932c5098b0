"""Operator 2: exact top-k by inner product over a bit-sliced index.

Vectors are quantised to integers, floor(scale * x).  The index is a stored table
of blocks of ``BLOCK`` rows: per component one bitmap for every bit of its value
above the block's minimum, made once.  For a query the slices are added with bitmap
arithmetic - each bit of the weights of a few components picks the sum of a subset
of these, made from their slices once, and adds its slices, shifted, into a
carry-save sum; the sign bit adds complements - which gives the slices of
every row's score at once, for ``QUERIES`` queries at a time.

The top rows are then selected from the most significant slice downward: rows
surely in, and rows still equal to the k-th; when the slices are used up, the
latter are the boundary rows, all of equal score, resolved exactly by smaller
id.  Their scores are computed again from the values.  Sums of slices have as
many slices as they need, so they are right for integers of any size.

Blocks and blocks of queries are dealt to stripes and columns; where a stripe
crosses a column they meet in one task, which reads the blocks first and then one
block of queries after another.  Nothing is joined, broadcast or sent to the
driver.  Each crossing gives at most k rows a query, of which a window keeps the
best k.  Nothing is skipped: every query meets every block.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do rows with a null id.  Only vectors of equal
length are compared.  A query row is never its own candidate, nor is any row
of the same id; several query rows of one id count as one (the smallest
vector).  Repeated candidate rows are candidates each.  Fewer candidates than
k give fewer rows; empty tables none.  A quantised component outside the long
range raises, and so does a score among the k that lies outside it; sums on the
way may.  Only the named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import python_workers, stored

SCALE = 1024
BLOCK = 4096
QUERIES = 64
TOP = 10
#: Pairs of a block and a query block in a cell at least; cells at least, where
#: the pairs are enough; blocks that a task holds at once at most; query blocks
#: that it searches them for at once.
PAIRS = 16
CELLS = 256
HELD = 8
ASKED = 4
#: Components whose subsets are summed beforehand; groups of them at a time.
TOGETHER = 6
TABLES = 16
WORD = np.uint64
LONG = 1 << 63


# --- slices --------------------------------------------------------------------

def bitmap(bits: np.ndarray) -> np.ndarray:
    """Booleans [..., n] as 64-bit words [..., ceil(n / 64)], lowest bit first."""
    pad = -bits.shape[-1] % 64
    if pad:
        bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), bits.dtype)], axis=-1)
    return np.packbits(bits.astype(np.uint8), axis=-1, bitorder="little").view(WORD)


def products(values: np.ndarray, weights: np.ndarray) -> list[int]:
    """Inner products of the rows of ``values`` with ``weights``, exactly."""
    most = np.abs(values.astype(float)) @ np.abs(weights.astype(float)) if len(values) else np.zeros(0)
    if not (most >= 2.0 ** 62).any():
        return (values @ weights).tolist()
    exact = [sum(a * b for a, b in zip(row, weights.tolist())) for row in values.tolist()]
    if any(not -LONG <= x < LONG for x in exact):
        raise ValueError("a score lies outside the long range")
    return exact


def subset_sums(groups: list[list[np.ndarray]]) -> np.ndarray:
    """Slices [place, group, subset, words] of the sum of every subset of a
    group's numbers, given by their slices; bit i of a subset stands for number i."""
    count, bits = max(map(len, groups)), max(len(x) for group in groups for x in group)
    words = groups[0][0].shape[-1]
    given = np.zeros((count, bits, len(groups), 1, words), WORD)
    for g, group in enumerate(groups):
        for i, slices in enumerate(group):
            given[i, :len(slices), g, 0] = slices
    out = np.zeros((bits + count.bit_length(), len(groups), 1 << count, words), WORD)
    for i in range(count):
        carry = WORD(0)
        for b, place in enumerate(out):
            old, new = place[:, :1 << i], place[:, 1 << i:2 << i]
            if b < bits:
                half = old ^ given[i, b]
                np.bitwise_xor(half, carry, out=new)
                carry = (old & given[i, b]) | (half & carry)
            else:
                np.bitwise_xor(old, carry, out=new)
                carry = old & carry
    return out


class SlicedBlock:
    """Slices of up to BLOCK rows of one length, rows in ascending id order.
    ``bits``: slices of each component; ``slices``: their words, one after another."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, bits: list[int], slices: np.ndarray):
        self.ids, self.values, self.bits = ids, values, bits
        self.rows = bitmap(np.ones(len(ids), np.uint8))
        words = slices.reshape(-1, len(self.rows))
        ends = np.cumsum(bits).tolist()
        self.slices = [words[end - n:end] for end, n in zip(ends, bits)]

    @classmethod
    def of(cls, ids: np.ndarray, values: np.ndarray) -> SlicedBlock:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order].astype(np.int64), np.ascontiguousarray(values[order].astype(np.int64))
        above = values.view(WORD) - values.min(axis=0).view(WORD)     # unsigned: right for any two longs
        bits = [int(x).bit_length() for x in above.max(axis=0)]
        made = [bitmap((above[:, j] >> WORD(b)) & WORD(1)) for j, n in enumerate(bits) for b in range(n)]
        return cls(ids, values, bits, np.concatenate(made) if made else np.zeros(0, WORD))

    def score_slices(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices [queries, words], lowest first, of sum_j w_j * u_j up to a
        constant of the query, where u is the value above the minimum.  Weights
        are taken bit by bit as two's complement: each bit picks, for each query,
        the sum of a subset of ``TOGETHER`` components, and the sign bit its
        complement."""
        shape = (len(weights), len(self.rows))
        columns: list[list[np.ndarray]] = []   # per weight of a bit: at most two summands

        def add(place: int, bits: np.ndarray) -> None:
            while True:
                while len(columns) <= place:
                    columns.append([])
                column = columns[place]
                column.append(bits)
                if len(column) < 3:
                    return
                a, b, c = column                                # their memory is used again
                half = a ^ b
                np.bitwise_and(a, b, out=a)
                np.bitwise_and(half, c, out=b)
                columns[place] = [np.bitwise_xor(half, c, out=c)]
                place, bits = place + 1, np.bitwise_or(a, b, out=a)     # the carry goes on

        order = np.argsort(self.bits, kind="stable")    # components of like width meet
        groups = [part for at in range(0, len(order), TOGETHER) if self.bits[(part := order[at:at + TOGETHER])[-1]]]
        for at in range(0, len(groups), TABLES):
            some = groups[at:at + TABLES]
            sums = subset_sums([[self.slices[j] for j in part] for part in some])
            for g, part in enumerate(some):
                picked = weights[:, part]
                signed = bool((picked < 0).any())
                width = int(np.where(picked < 0, ~picked, picked).max(initial=0)).bit_length()
                if not (width or signed):
                    continue
                most = sum((1 << self.bits[j]) - 1 for j in part).bit_length()
                for t in range(width + signed):
                    code = ((picked >> t) & 1) @ (1 << np.arange(len(part)))
                    for b in range(most):
                        bits = sums[b, g].take(code, axis=0)
                        add(t + b, np.invert(bits, out=bits) if t == width else bits)
        out, carry = [], np.zeros(shape, WORD)
        place = 0
        while place < len(columns) or carry.any():
            a, b = (*(columns[place] if place < len(columns) else []), np.zeros(shape, WORD), np.zeros(shape, WORD))[:2]
            half = a ^ b
            out.append(half ^ carry)
            carry = (a & b) | (carry & half)
            place += 1
        return out

    def top(self, weights: np.ndarray, query_ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (ids, scores) of its k best rows, ties to smaller ids."""
        sure = np.zeros((len(weights), len(self.rows)), WORD)
        own = bitmap(self.ids[None, :] == query_ids[:, None])
        equal = self.rows[None, :] & ~own
        need = np.full(len(weights), k)
        for bits in reversed(self.score_slices(weights)):
            ones = equal & bits
            n = np.bitwise_count(ones).sum(axis=1, dtype=np.int64)
            over = (n >= need)[:, None]
            sure = np.where(over, sure, sure | ones)
            need = np.where(over[:, 0], need, need - n)
            equal = np.where(over, ones, equal & ~bits)
        out = []
        for q in range(len(weights)):
            inside = np.flatnonzero(np.unpackbits(sure[q].view(np.uint8), bitorder="little"))
            boundary = np.flatnonzero(np.unpackbits(equal[q].view(np.uint8), bitorder="little"))[:need[q]]
            rows = np.concatenate([inside, boundary])
            score = products(self.values[rows], weights[q])
            best = sorted(range(len(rows)), key=lambda r: (-score[r], self.ids[rows[r]]))
            out.append((self.ids[rows][best], np.array([score[r] for r in best], np.int64)))
        return out


# --- on Spark ------------------------------------------------------------------

def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, values): floor(scale * x) of the vectors that take part."""
    def whole(v: Column) -> Column:
        y = v.cast("double") * float(scale)
        inside = (y >= -float(LONG)) & (y < float(LONG))
        return F.when(inside, F.floor(F.when(inside, y).otherwise(0.0))).otherwise(
            F.raise_error(F.lit("a component is too large to quantise")).cast("long"))

    x = F.transform(F.col(vector), whole)
    fine = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v.cast("double"))
                    & (F.abs(v.cast("double")) < float("inf")))
    return (vectors.where(F.col(vec_id).isNotNull() & (F.size(vector) > 0) & fine)
            .select(F.col(vec_id).cast("long").alias("vec_id"), F.size(vector).alias("dim"), x.alias("values")))


def packed(values: np.ndarray) -> bytes:
    """64-bit integers in the fewest of 2, 4 or 8 bytes each that hold them all."""
    low, high = values.min(initial=0), values.max(initial=0)
    fits = (kind for kind in ("<i2", "<i4", "<i8") if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max)
    return values.astype(next(fits)).tobytes()


def unpacked(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{len(data) // (rows * dim)}").reshape(rows, dim).astype(np.int64)


BLOCK_ROW = "block bigint, dim int, ids binary, values binary"


def _n_blocks(size: int, total: int) -> int:
    return max(1, -(-total // size))


def _in_blocks(rows: DataFrame, size: int, total: int) -> DataFrame:
    """(block, dim, ids, values): ``rows`` (about ``total``) dealt out evenly,
    by their row numbers, to blocks of about ``size`` rows; the rows of one
    length in a block are one record."""
    names = ["block", "dim", "ids", "values"]

    def run(batches):
        key, ids, values = None, [], []

        def record():
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()),
                pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                pa.array([packed(np.concatenate(values))], pa.binary())], names=names)

        for batch in batches:
            block, dim, vec = (batch.column(c).to_numpy() for c in ("block", "dim", "vec_id"))
            flat, ends = batch.column("values").flatten().to_numpy(), np.cumsum(dim, dtype=np.int64)
            new = np.flatnonzero((block[1:] != block[:-1]) | (dim[1:] != dim[:-1])) + 1
            for start, end in zip([0, *new], [*new, len(block)]) if len(block) else ():
                if (block[start], dim[start]) != key:
                    if ids:
                        yield record()
                    key, ids, values = (block[start], dim[start]), [], []
                ids.append(vec[start:end])
                values.append(flat[ends[start] - dim[start]:ends[end - 1]])
        if ids:
            yield record()

    return (rows.select(F.pmod("_row", F.lit(_n_blocks(size, total))).alias("block"), "dim", "vec_id", "values")
            .repartition("block").sortWithinPartitions("block", "dim", "vec_id")
            .mapInArrow(run, BLOCK_ROW))


def _sliced(blocks: DataFrame) -> DataFrame:
    """The index: blocks with the bitmaps of their slices."""
    def run(batches):
        for batch in batches:
            for block, dim, ids, values in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, np.int64)
                made = SlicedBlock.of(ids, unpacked(values, len(ids), dim))
                words = b"".join(part.tobytes() for part in made.slices)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block]), pa.array([dim], pa.int32()), pa.array([made.ids.tobytes()], pa.binary()),
                    pa.array([packed(made.values)], pa.binary()), pa.array([made.bits], pa.list_(pa.int32())),
                    pa.array([words], pa.binary())], names=["block", "dim", "ids", "values", "bits", "slices"])

    return blocks.mapInArrow(run, f"{BLOCK_ROW}, bits array<int>, slices binary")


def _cells(blocks: int, groups: int, block: int, queries: int, cores: int) -> tuple[int, int, int]:
    """(stripes, columns, tasks): the crossings, cells, have about as many pairs
    each, more of them the more there are in all, so that copies of blocks and of
    query blocks grow with the root of the pairs; a block is longer than a query
    block, so a cell has fewer of them."""
    cells = max(CELLS, 4 * cores)
    pairs = max(PAIRS, -(-blocks * groups // cells))
    held = min(HELD, blocks, max(1, math.isqrt(pairs * queries // block), pairs // groups))
    stripes, columns = -(-blocks // held), -(-groups // -(-pairs // held))
    return stripes, columns, min(stripes * columns, 2 * cells)


def _dealt(index: DataFrame, groups: DataFrame, stripes: int, columns: int, tasks: int) -> DataFrame:
    """(cell, dim, asks, ids, values, bits, slices): the blocks and the query
    blocks of each cell in one task, the blocks of a length before its queries."""
    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    held = index.select("*", F.pmod("block", F.lit(stripes)).alias("stripe"), each(columns).alias("column"),
                        F.lit(False).alias("asks"))
    asking = groups.select("*", F.lit(None).cast("array<int>").alias("bits"), F.lit(None).cast("binary").alias("slices"),
                           each(stripes).alias("stripe"), F.pmod("block", F.lit(columns)).alias("column"),
                           F.lit(True).alias("asks"))
    return (held.unionByName(asking)
            .select((F.col("stripe") * columns + F.col("column")).alias("cell"), "dim", "asks", "ids", "values", "bits", "slices")
            .repartition(tasks, "cell").sortWithinPartitions("cell", "dim", "asks"))


def top_k(vectors: DataFrame, is_query: Column, k: int = TOP, vec_id: str = "vec_id", vector: str = "embedding",
          block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): per query row its k highest inner
    products with all other rows, ties to the smaller id.  ``is_query`` is a
    condition on vec_id."""
    spark = vectors.sparkSession
    python_workers(spark)
    kept = stored(quantised(vectors, vec_id, vector).withColumn("_row", F.monotonically_increasing_id()),
                  "sliced-values")
    total = kept.count()
    index = stored(_sliced(_in_blocks(kept, block, total)), "sliced-index")
    asked = kept.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "values", "_row")).alias("_q")) \
        .select("vec_id", "_q.*")
    asked = stored(asked, "sliced-queries")
    n_asked = asked.count()
    cells = _cells(_n_blocks(block, total), _n_blocks(queries, n_asked), block, queries,
                   spark.sparkContext.defaultParallelism)
    meet = _dealt(index, _in_blocks(asked, queries, n_asked), *cells)

    def answers(held, waiting):
        ids, values = map(np.concatenate, zip(*waiting))
        best = []
        for found in zip(*(index.top(values, ids, k) for index in held)):
            vec, score = map(np.concatenate, zip(*found))
            first = np.lexsort((vec, ~score))[:k]       # ~ turns the order of all longs
            best.append((vec[first], score[first]))
        vec, score = map(np.concatenate, zip(*best))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x[0]) for x in best])), pa.array(vec), pa.array(score)],
                                          names=["query_id", "vec_id", "score"])

    def search(batches):
        key, held, waiting = None, [], []
        for batch in batches:
            for cell, dim, asks, ids, values, bits, slices in zip(*(c.to_pylist() for c in batch.columns)):
                if waiting and ((cell, dim) != key or len(waiting) == ASKED):
                    yield answers(held, waiting)
                    waiting = []
                if (cell, dim) != key:
                    key, held = (cell, dim), []
                ids = np.frombuffer(ids, np.int64)
                values = unpacked(values, len(ids), dim)
                if not asks:
                    held.append(SlicedBlock(ids, values, bits, np.frombuffer(slices, WORD)))
                elif held:
                    waiting.append((ids, values))
        if waiting:
            yield answers(held, waiting)

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (meet.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
            .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def digest(embeddings: DataFrame) -> DataFrame:
    """Contract columns of the query."""
    return top_k(embeddings.select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
