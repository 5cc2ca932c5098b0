"""Operator 13 against plain Python and its oracle; splits, chains, insertion."""
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import extendible
from .conftest import clashing


def norm(text):
    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def brute(docs):
    groups = {}
    for d, text in docs:
        groups.setdefault(norm(text), []).append(d)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda d: (d is None, d or 0))
        out += [(d, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, d in enumerate(ids)]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()), key=str)


DOCS = [(5, "a  b"), (3, "a\tb"), (9, "a\n\x0b\x0c\r b"), (4, "a b "), (6, "a b"), (1, None), (2, ""), (7, " "), (8, "\n"),
        (10, "A b"), (11, "x"), (11, "x"), (11, " x"), (None, "x"), (None, "alone"), (None, "pair"), (None, "pair"),
        (12, "long words " * 50_000), (13, "long  words " * 50_000), (14, "é"), (15, "é")]


def test_edges(spark, docs_of):
    assert got(extendible.digest(clashing(docs_of(DOCS)))) == brute(DOCS)
    assert got(extendible.digest(docs_of([]))) == []


@pytest.mark.parametrize("key_bits", [64, 3, 0])
def test_splits_and_chains(spark, docs_of, key_bits):
    """Small buckets split; few key bits make chains and buckets that can't be split."""
    docs = DOCS + [(100 + i, f"text {i % 90}") for i in range(200)]
    index, rows = extendible.build(docs_of(docs), key_bits, capacity=4)
    assert got(extendible.members(index, rows)) == brute(docs)
    entries = extendible.entries_of(index).collect()
    assert len(entries) == len({norm(t) for _, t in docs})
    assert len({(e.key, e.link) for e in entries}) == len(entries)
    buckets = index.directory.collect()
    assert sum(2.0 ** -b.depth for b in buckets) == 1 and sum(b.n for b in buckets) == len(entries)
    if key_bits == 64:
        assert max(b.n for b in buckets) <= 4 and len(buckets) > 16


def test_hot_text(spark, docs_of, monkeypatch):
    monkeypatch.setattr(extendible, "HOT", 4)
    docs = [(i, "the hot text" if i % 3 else f"other {i}") for i in range(600)]
    assert got(extendible.digest(docs_of(docs).repartition(5))) == brute(docs)


@pytest.mark.parametrize("key_bits", [64, 2])
def test_insert(spark, docs_of, key_bits):
    old = [(i, f"text {i % 50}") for i in range(100, 180)]
    new = [(i, f"text  {i % 60}") for i in range(0, 90)] + [(500, "text 7"), (None, "text 8")]
    index, old_rows = extendible.build(docs_of(old), key_bits, capacity=4)
    grown, new_rows = extendible.insert(index, docs_of(new))
    assert got(extendible.members(grown, old_rows.unionByName(new_rows))) == brute(old + new)
    buckets = grown.directory.collect()
    assert sum(2.0 ** -b.depth for b in buckets) == 1 and sum(b.n for b in buckets) == 60
    again, more = extendible.insert(grown, docs_of([(1, "text 1"), (2, "quite new")]))
    assert got(extendible.members(again, old_rows.unionByName(new_rows).unionByName(more))) == \
        brute(old + new + [(1, "text 1"), (2, "quite new")])
    if key_bits == 64:   # buckets that got nothing keep their files
        assert again.directory.where(F.col("generation") < 2).count() > again.directory.where(F.col("generation") == 2).count()


def test_two_texts_of_one_digest_raise(spark, docs_of):
    rows = extendible.rows_of(docs_of([(1, "a"), (2, "a")]))
    groups = extendible._groups(rows)
    texts = extendible._texts(docs_of([(1, "a")]), 64)
    with pytest.raises(Exception, match="not the copies of one text"):
        extendible._chained(texts, groups).collect()
    with pytest.raises(Exception, match="two texts of one digest"):
        extendible._chained(texts.unionByName(texts), groups.unionByName(groups).limit(0)).collect()


def test_oracle(spark, documents, docs_of):
    for docs in (documents, docs_of([d for d in DOCS if d[0] is not None])):
        con = duckdb.connect()
        con.register("documents", docs.select("doc_id", "text").toPandas())
        want = con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({extendible.ORACLE})").fetchall()
        assert got(extendible.digest(docs)) == sorted(want, key=str)


def test_keep_one(spark, docs_of):
    assert sorted(r.doc_id for r in extendible.keep_one(docs_of([(3, "a"), (1, " a"), (2, "a"), (4, "")])).collect()) == [1, 2, 4]
