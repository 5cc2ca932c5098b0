"""Operator 2 against plain integer inner products."""
import math

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from cohortlens.llm import bitsliced
from .conftest import clashing

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])


def _expected(rows, modulus, k):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % modulus == 0}):
        w = min((len(v), v) for i, v in ok if i == q)[1]
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in ok if i != q and len(v) == len(w))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 150), st.integers(1, 5), st.integers(1, 12), st.sampled_from([1, 3, 40, 100_000, 2**30]), st.integers(0, 99))
def test_block(n, dim, k, spread, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(-spread, spread + 1, (n, dim))
    ids = rng.permutation(n) * 3
    queries = rng.integers(-spread, spread + 1, (4, dim))
    own = np.array([0, 3, 999, 6])
    got = bitsliced.SlicedBlock.of(ids, values).top(queries, own, k)
    for q, o, (g_ids, g_scores) in zip(queries, own, got):
        want = sorted((-int(v @ q), int(i)) for i, v in zip(ids, values) if i != o)[:k]
        assert [(-s, i) for i, s in zip(g_ids.tolist(), g_scores.tolist())] == want


def test_edges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, .3, 6)]) for i in range(300)]
    rows += [(400 + i, rows[7][1]) for i in range(50)]                    # ties
    rows += [(500, rows[3][1]), (500, rows[4][1]), (500, rows[3][1])]      # one id, several rows
    rows += [(600, None), (601, []), (602, [1.0, None, .1, .1, .1, .1]), (603, [float("nan")] * 6),
             (604, [float("inf")] * 6), (None, rows[1][1]), (700, [1.0, 2.0]), (701, [3.0, -4.0])]
    df = clashing(spark.createDataFrame(rows, VECTORS))
    got = bitsliced.top_k(df, F.col("vec_id") % 100 == 0, k=10, block=64, queries=3)
    assert sorted(map(tuple, got.collect())) == _expected(rows, 100, 10)
    assert bitsliced.digest(spark.createDataFrame([], VECTORS)).count() == 0
    few = bitsliced.digest(spark.createDataFrame(rows[:4], VECTORS))
    assert sorted(map(tuple, few.select("query_id", "rank", "vec_id", "score").collect())) == _expected(rows[:4], 100, 10)


def test_large_values_are_exact(spark):
    """Finite components far beyond 32 bits; sums on the way beyond 64."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 4e5, 4)]) for i in range(0, 130)]
    rows = rows + [(500, [2.5e6, 1e-3, 0.0, 1.0]), (501, [2.5e6, 2e-3, 0.0, -1.0])]
    got = bitsliced.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 100 == 0, k=5, block=32, queries=2)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    want = _expected(rows, 100, 5)
    assert all(abs(s) < 2**63 for *_, s in want) and any(abs(s) > 2**55 for *_, s in want)
    assert sorted(map(tuple, got.collect())) == want


def test_block_with_extreme_longs():
    top, low = 2**63 - 1, -2**63
    values = np.array([[top, 1], [low, 2], [0, 3], [5, 4]])
    block = bitsliced.SlicedBlock.of(np.arange(4), values)
    for weights in ([1, 0], [-1, 1], [0, low], [0, 1]):
        try:
            (ids, scores), = block.top(np.array([weights]), np.array([99]), 2)
        except ValueError as error:
            assert "long range" in str(error)
            exact = sorted((-(int(v[0]) * weights[0] + int(v[1]) * weights[1]) for v in values))[:2]
            assert any(not -2**63 <= -x < 2**63 for x in exact)
            continue
        want = sorted((-(int(v[0]) * weights[0] + int(v[1]) * weights[1]), i) for i, v in enumerate(values))[:2]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == want


def test_outside_the_long_range_raises(spark):
    with pytest.raises(Exception, match="too large"):
        bitsliced.digest(spark.createDataFrame([(0, [1e30]), (1, [1.0])], VECTORS)).collect()
    with pytest.raises(Exception, match="outside the long range"):
        bitsliced.digest(spark.createDataFrame([(0, [2e6] * 4), (1, [2e6] * 4), (2, [1.0] * 4)], VECTORS)).collect()


def test_the_index_holds_bitmaps(spark):
    rows = [(i, [i / 7, -i / 3]) for i in range(100)]
    kept = bitsliced.quantised(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding")
    blocks = bitsliced._in_blocks(kept.withColumn("_row", F.monotonically_increasing_id()), 40, 100)
    for r in bitsliced._sliced(blocks).collect():
        words = -(-(len(r.ids) // 8) // 64)
        assert len(r.slices) == 8 * words * sum(r.bits) and len(r.bits) == 2


def test_nothing_is_broadcast(spark):
    """Queries met blocks by a join that small estimates made a broadcast of every
    query's values once for each block: over 1500 MB in the driver for 615,384 rows."""
    rows = [(i, [i / 7, -i / 3]) for i in range(1, 301)]
    got = bitsliced.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, k=3, block=4, queries=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan and "Cartesian" not in plan
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, got.collect())) == _expected(rows, 10, 3)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 10**5), st.integers(1, 10**5), st.sampled_from([(4096, 64), (4, 2), (1, 1), (64, 4096)]), st.integers(1, 2000))
def test_cells_grow_with_the_pairs(blocks, groups, sizes, cores):
    stripes, columns, tasks = bitsliced._cells(blocks, groups, *sizes, cores)
    assert 1 <= stripes <= blocks and 1 <= columns <= groups
    assert 1 <= tasks <= min(stripes * columns, 2 * max(bitsliced.CELLS, 4 * cores))
    assert -(-blocks // stripes) <= bitsliced.HELD                          # what a task holds at once
    assert columns <= 2 * max(bitsliced.CELLS, 4 * cores)                   # copies of a block


def test_every_block_meets_every_query_block_once(spark):
    row = "block bigint, dim int, ids binary, values binary, bits array<int>, slices binary"
    index = spark.createDataFrame([(b, d, bytes([b]), b"", [], b"") for b in range(7) for d in (2, 3)], row)
    groups = spark.createDataFrame([(g, d, bytes([g]), b"") for g in range(5) for d in (2, 4)],
                                   "block bigint, dim int, ids binary, values binary")
    for stripes, columns, tasks in ((1, 1, 1), (3, 2, 4), (7, 5, 35)):
        met, part = [], []
        for rows in bitsliced._dealt(index, groups, stripes, columns, tasks).rdd.glom().collect():
            key, held = None, []
            for r in rows:
                if (r.cell, r.dim) != key:
                    assert (r.cell, r.dim) not in part
                    key, held = (r.cell, r.dim), []
                    part.append(key)
                if r.asks:
                    assert r.bits is None and r.slices is None
                    met += [(r.dim, b, r.ids[0]) for b in held]
                else:
                    held.append(r.ids[0])
        assert sorted(met) == [(2, b, g) for b in range(7) for g in range(5)]


@pytest.mark.parametrize("most", [1, 2**15 - 1, 2**15, 2**31 - 1, 2**31, 2**63 - 1])
def test_packed(most):
    values = np.array([[most, -1, 0], [-most - 1, 1, most]])
    data = bitsliced.packed(values)
    assert bitsliced.unpacked(data, 2, 3).tolist() == values.tolist()
    assert len(data) == 6 * (2 if most < 2**15 else 4 if most < 2**31 else 8)


def test_subset_sums():
    rng = np.random.default_rng(2)
    numbers = [[rng.integers(0, 2**bits, 70) for bits in group] for group in ((3, 0, 9), (62, 62), (1,))]
    slices = [[np.array([bitsliced.bitmap((x >> b) & 1) for b in range(int(x.max()).bit_length())], np.uint64).reshape(-1, 2)
               for x in group] for group in numbers]
    got = bitsliced.subset_sums(slices)
    for g, group in enumerate(numbers):
        for subset in range(1 << len(group)):
            bits = np.unpackbits(got[:, g, subset].view(np.uint8), axis=-1, bitorder="little")[:, :70]
            want = [sum(int(x[row]) for i, x in enumerate(group) if subset >> i & 1) for row in range(70)]
            assert [sum(int(bit) << place for place, bit in enumerate(column)) for column in bits.T] == want


def test_slices_sum_to_the_scores_up_to_a_constant():
    """Single query, several groups of components, some of them constant."""
    rng = np.random.default_rng(3)
    for dim, spread in ((1, 5), (13, 2**20), (200, 300), (7, 2**62)):
        values = rng.integers(-spread, spread, (70, dim))
        values[:, ::3] = 4
        block = bitsliced.SlicedBlock.of(np.arange(70), values)
        for weights in (rng.integers(-spread, spread, (1, dim)), -np.ones((1, dim), int), np.zeros((1, dim), int),
                        np.full((2, dim), 2**63 - 1), np.full((2, dim), -2**63)):
            slices = block.score_slices(weights)
            for q, w in enumerate(weights.tolist()):
                bits = [np.unpackbits(s[q].view(np.uint8), bitorder="little")[:70].tolist() for s in slices]
                got = [sum(bit[r] << place for place, bit in enumerate(bits)) for r in range(70)]
                want = [sum(a * b for a, b in zip(v, w)) for v in values.tolist()]
                assert len({a - b for a, b in zip(got, want)}) == 1


def test_rows_of_several_lengths_in_many_batches(spark):
    """Blocks of more rows than a batch, of lengths in turn, some of one row."""
    rows = [(i, [float(x + 1) / (i + 1) for x in range(1 + i % 3)]) for i in range(700)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows] + [(900, [1.0] * 5), (901, [2.0] * 6)]
    got = bitsliced.top_k(spark.createDataFrame(rows, VECTORS).coalesce(1), F.col("vec_id") % 100 == 0, k=4, block=1000, queries=2)
    assert sorted(map(tuple, got.collect())) == _expected(rows, 100, 4)
