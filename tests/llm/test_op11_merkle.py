"""Operator 11 against a level-by-level tree in plain Python, and its oracle."""
import hashlib
import zlib

import duckdb
import pytest

from cohortlens.llm import merkle
from .conftest import DOCS, clashing


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _levels(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([h(*row[i:i + 2]) for i in range(0, len(row), 2)])
    return levels


def _way(levels, at):
    """(siblings, fold): of leaf ``at``."""
    found = []
    for row in levels[:-1]:
        if at ^ 1 < len(row):
            found.append(row[at ^ 1])
        at //= 2
    return found


def _fold(leaf, levels, at):
    for row in levels[:-1]:
        pair = [leaf] if at ^ 1 >= len(row) else [leaf, row[at ^ 1]] if at % 2 == 0 else [row[at ^ 1], leaf]
        leaf, at = h(*pair), at // 2
    return leaf


def _leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in
               (row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"])])


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row["lang"], []).append((row["doc_id"] is not None, row["doc_id"] or 0, _leaf(row), row))
    order = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    lower = {lang: _levels([m[2] for m in sorted(trees[lang], key=lambda m: m[:3])]) for lang in order}
    top = _levels([lower[lang][-1][0] for lang in order])
    out = []
    for t, lang in enumerate(order):
        for at, (_, _, leaf, row) in enumerate(sorted(trees[lang], key=lambda m: m[:3])):
            claim = leaf
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None:
                claim = _leaf({**row, "n_chars": row["n_chars"] + 1})
            folded = _fold(_fold(claim, lower[lang], at), top, t)
            out.append((row["doc_id"], leaf, lower[lang][-1][0], top[-1][0],
                        h(*_way(lower[lang], at), *_way(top, t)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def got(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def rows_of(n, langs=("en",)):
    return [dict(doc_id=i, text=f"text {i}", lang=langs[i % len(langs)], source="s", n_chars=6) for i in range(n)]


EDGES = [dict(doc_id=1, text=None, lang=None, source=None, n_chars=None), dict(doc_id=2, text="", lang="", source="", n_chars=0),
         dict(doc_id=None, text="no id", lang="en", source="s", n_chars=5), dict(doc_id=3, text="é\n", lang="en", source="s", n_chars=2),
         dict(doc_id=3, text="a", lang="en", source="s", n_chars=1), dict(doc_id=3, text="a", lang="en", source="s", n_chars=1),
         dict(doc_id=-7, text="minus", lang="-", source="s", n_chars=5), dict(doc_id=4, text="b", lang="Ω", source="s", n_chars=2**63 - 1),
         dict(doc_id=5, text="long " * 100_000, lang="=", source="s", n_chars=None)]


def _frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in DOCS.fields) for r in rows], DOCS)


@pytest.mark.parametrize("leaves", range(1, 40))
def test_positions_are_the_postorder(leaves):
    log = merkle.append_log([str(i).encode() for i in range(leaves)], merkle.height(leaves))
    levels = _levels([str(i) for i in range(leaves)])
    assert len(log) == sum(map(len, levels))
    for k, row in enumerate(levels):
        for j, node in enumerate(row):
            assert log[merkle.position(k, j, leaves)].decode() == node
    joined = b"".join(x.ljust(merkle.HEX) for x in log)
    for at in range(leaves):
        proof = merkle.siblings(joined, at, leaves, merkle.height(leaves))
        assert [proof[i:i + 64].strip().decode() for i in range(0, len(proof), 64)] == _way(levels, at)


def test_fold_detects_a_changed_leaf():
    levels = _levels([h(str(i)) for i in range(11)])
    proof = "".join(_way(levels, 10)).encode()
    assert merkle.fold(h("10").encode(), 10, 11, proof)[0].decode() == levels[-1][0]
    assert merkle.fold(h("x").encode(), 10, 11, proof)[0].decode() != levels[-1][0]


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_rounds_of_builders(spark, bits):
    rows = rows_of(45, ("en", "de", "en", None, "en")) + EDGES
    assert got(merkle.digest(_frame(spark, rows), bits)) == brute(rows)


def test_edges(spark):
    assert got(merkle.digest(clashing(_frame(spark, EDGES)))) == brute(EDGES)
    assert got(merkle.digest(_frame(spark, []))) == []
    assert got(merkle.digest(_frame(spark, EDGES[:1]))) == brute(EDGES[:1])


def test_repeated_rows(spark):
    rows = [dict(doc_id=9, text="same", lang="en", source="s", n_chars=4)] * 70 + rows_of(5)
    assert got(merkle.digest(_frame(spark, rows).repartition(7), 2)) == brute(rows)


def test_oracle(spark, documents):
    edges = _frame(spark, [{**r, "n_chars": None if r["n_chars"] is None else r["n_chars"] % 1000} for r in EDGES])
    for docs in (documents, edges):
        con = duckdb.connect()
        con.register("documents", docs.toPandas().astype({"n_chars": "Int64", "doc_id": "Int64"}))
        want = con.execute(merkle.ORACLE).fetchall()
        names = [d[0] for d in con.description]
        assert got(merkle.digest(docs)) == sorted((tuple(r[names.index(c)] for c in COLUMNS) for r in want), key=str)
