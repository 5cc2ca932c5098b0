"""Operator 7 against word windows compared one by one, and its oracle."""
import hashlib
import re

import duckdb
import pytest

from cohortlens.llm import decontam
from .conftest import clashing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def _brute(docs, items):
    windows = {}
    for item, text in items:
        w = _words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = _words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit.update(range(i, i + size))
                    found |= {str(x) for x in windows[tuple(w[i:i + size])] if x is not None}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (12, "Short ITEM here"), (2, None), (3, ""),
         (4, "..."), (5, "two three four five six seven eight nine ten eleven zzz"), (12, "Short ITEM here"),
         (None, "one two three four five six seven eight nine ten"), (6, "neverseenword " * 12), (7, "a a a a a a a a a a a")]
DOCS = [(1, "One, TWO three-four five six seven eight nine ten eleven twelve!"), (2, "short item here; short item here"),
        (3, "short item there"), (4, None), (5, ""), (6, "!!"), (7, "a " * 15), (7, "a " * 15), (7, "short item here"),
        (None, "x short item here"), (8, "two three four five six seven eight nine ten eleven"),
        (9, "filler " * 20_000 + "short item here"), (10, "ähnlich Éa short item here"), (11, "a " * 9)]


@pytest.mark.parametrize("block_rows", [decontam.BLOCK_ROWS, 3])
def test_edges(spark, docs_of, items_of, block_rows):
    got = decontam.decontaminate(clashing(docs_of(DOCS)), clashing(items_of(ITEMS)), block_rows=block_rows).collect()
    plain = sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]),
                     hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in got), key=str)
    assert plain == _brute(DOCS, ITEMS)


def test_digest_clean_and_empty_tables(spark, docs_of, items_of):
    got = decontam.digest(docs_of(DOCS), items_of(ITEMS))
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()),
                  key=str) == _brute(DOCS, ITEMS)
    kept = decontam.clean(docs_of(DOCS), items_of(ITEMS))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id for r in kept.collect())) == [3, 4, 5, 6, 11]
    assert decontam.digest(docs_of([]), items_of(ITEMS)).count() == 0
    assert not decontam.digest(docs_of(DOCS), items_of([])).where("contaminated").count()


def test_oracle_and_native_plan(spark, documents, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    got = decontam.digest(documents, items)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(f"SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM ({decontam.ORACLE})").fetchall()
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
