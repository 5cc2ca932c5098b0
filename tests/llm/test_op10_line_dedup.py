"""Operator 10 against plain Python, its oracle, and insert / delete round trips."""
import hashlib
import random

import duckdb
import numpy as np
import pytest

from cohortlens.llm import linededup
from .conftest import clashing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "this line is long enough to count"


def _key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)


def _brute(docs):
    held = {}
    low = linededup.NO_ID
    for d, text in docs:
        for line in (text or "").split("\n"):
            held.setdefault(_key(line), set()).add(low if d is None else d)
    out = []
    for d, text in docs:
        lines = (text or "").split("\n")
        gone = [len(_key(x)) >= 20 and len(held[_key(x)]) >= 3 and max(held[_key(x)]) != (low if d is None else d) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((d, len(lines), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def _got(index, docs):
    rows = linededup.keep_lines(index, docs, names=("n1", "n2", "left")).collect()
    return sorted(((r.doc_id, r.n1, r.n2, hashlib.sha256(r.left.encode()).hexdigest()) for r in rows), key=str)


DOCS = [(1, f"{LONG}\nx\n  {LONG.upper()}\t"), (2, f"y\n{LONG}"), (3, LONG), (4, None), (5, ""), (6, "\n\n"),
        (7, "É" * 20 + "\nshort"), (8, "é" * 20), (9, "É" * 20), (10, "É" * 20 + " "), (11, "É" * 20), (12, f" {LONG}"),
        (13, "exactly twenty chars"), (14, "exactly twenty chars"), (15, "exactly twenty chars"), (16, "nineteen characters"),
        (17, "nineteen characters"), (18, "nineteen characters"), (20, "twice in here, twice\n" * 3), (21, "twice in here, twice"),
        (22, f"{LONG}\r"), (22, f"{LONG}\nother"), (22, f"{LONG}\nother"), (None, f"{LONG}\nno id"),
        (30, "\n".join(f"a very long document line {i}" for i in range(4000)) + "\n" + LONG)]


def test_edges(spark, docs_of):
    docs = clashing(docs_of(DOCS))
    assert _got(linededup.build(docs), docs) == _brute(DOCS)
    assert _got(linededup.build(docs_of([])), docs_of([])) == []


def test_without_filters_and_many_shards(spark, docs_of, monkeypatch):
    docs = docs_of(DOCS)
    assert _got(linededup.build(docs, keys_per_shard=1), docs) == _brute(DOCS)
    monkeypatch.setattr(linededup, "BROADCAST_BYTES", -1)
    assert _got(linededup.build(docs), docs) == _brute(DOCS)


def test_insert_and_delete_are_reversible(spark, docs_of):
    first, second = DOCS[:14], DOCS[14:]
    before = linededup.build(docs_of(first))
    both = linededup.insert(before, docs_of(second))
    assert _got(both, docs_of(DOCS)) == _brute(DOCS)
    ids = docs_of([r for r in second]).select("doc_id")
    after = linededup.delete(both, ids)
    assert _got(after, docs_of(first)) == _brute(first)
    state = lambda i: sorted(map(tuple, i.counts.collect()))
    assert state(after) == state(before)
    keeper = linededup.delete(both, docs_of([(30, "")]).select("doc_id"))   # the largest id goes: the next one keeps
    left = [r for r in DOCS if r[0] != 30]
    assert _got(keeper, docs_of(left)) == _brute(left)


def test_cuckoo_filter():
    rng = random.Random(1)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(3000)]
    table = linededup.CuckooFilter.sized(len(keys))
    assert all(table.insert(k) for k in keys)
    assert all(k in table for k in keys)
    others = [rng.getrandbits(64) - (1 << 63) for _ in range(20_000)]
    assert sum(k in table for k in others) < 40
    again = linededup.CuckooFilter.unpacked(table.packed())
    for k in keys[:1500]:
        assert again.remove(k)
    assert all(k in again for k in keys[1500:])
    small = linededup.CuckooFilter(np.zeros((16, 4), np.uint16))
    put = [k for k in keys[:200] if small.insert(k)]
    assert len(put) < 200 and all(k in small for k in put)     # a full filter loses nothing


def test_lookup_in_columns_equals_the_filter(spark):
    from pyspark.sql import functions as F
    rng = random.Random(2)
    keys = [rng.getrandbits(64) - (1 << 63) for _ in range(300)]
    tables = [linededup.CuckooFilter.sized(100), linededup.CuckooFilter.sized(400)]
    for i, k in enumerate(keys[:150]):
        assert tables[i % 2 if i < 100 else 1].insert(k)
    df = spark.createDataFrame([([t.packed() for t in tables], k) for k in keys], "tables array<array<bigint>>, h2 bigint")
    got = [r.known for r in df.select(linededup._maybe_known(F.col("tables"), F.col("h2")).alias("known")).collect()]
    assert got == [any(k in t for t in tables) for k in keys]


def test_oracle(spark, documents, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cols = "doc_id, n_lines, n_dropped, kept_sha256"
    want = con.execute(f"SELECT {cols} FROM ({linededup.ORACLE})").fetchall()
    assert sorted(map(tuple, linededup.digest(documents).select(*cols.split(", ")).collect())) == sorted(want)
    assert sorted(want, key=str) == _brute([(r.doc_id, r.text) for r in documents.collect()])
