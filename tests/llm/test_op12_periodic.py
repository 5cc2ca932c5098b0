"""Operator 12: Lyndon arrays, runs and collapsed texts against brute force."""
import hashlib
import random
import zlib

import numpy as np
import pytest

from cohortlens.llm import periodic
from .conftest import clashing

SPACE = " \t\n\x0b\x0c\r"


def brute_lyndon(s):
    out = []
    for i in range(len(s)):
        j = i + 1
        while j < len(s) and s[j:] > s[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(s, min_length=12):
    """(start, length, period) by testing every period at every place."""
    found = []
    for q in range(1, len(s) // 2 + 1):
        a = 0
        while a + q < len(s):
            b = a
            while b + q < len(s) and s[b] == s[b + q]:
                b += 1
            if b > a and b + q - a >= max(min_length, 2 * q):
                if not any(all(s[x] == s[x + d] for x in range(a, b + q - d)) for d in range(1, q)):
                    found.append((a, b + q - a, q))
            a = max(b, a + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute(doc_id, text):
    w = words(text)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def _texts(seed, count):
    rng = random.Random(seed)
    for _ in range(count):
        k = rng.choice([1, 2, 2, 3, 6])
        s = [rng.randrange(k) for _ in range(rng.randint(0, 30))]
        unit = [rng.randrange(k + 1) for _ in range(rng.randint(1, 7))]
        at = rng.randint(0, len(s))
        yield s[:at] + unit * rng.randint(0, 6) + unit[:rng.randint(0, 3)] + s[at:]


def test_lyndon_arrays():
    for s in _texts(1, 400):
        ranks = np.unique(np.array(s, int), return_inverse=True)[1]
        assert periodic.lyndon_array(ranks).tolist() == brute_lyndon(s)


@pytest.mark.parametrize("least", [1, 5, 12])
def test_runs(least):
    for s in _texts(2, 400):
        got = [(a, b - a, q) for a, b, q in periodic.find_runs(np.array(s, int), 0, least).tolist()]
        assert got == brute_runs(s, least)


def test_runs_of_many_texts():
    texts = list(_texts(3, 200))
    ends = np.cumsum([len(t) for t in texts])
    found = periodic.runs_of(np.concatenate([np.array(t, int) for t in texts]), ends).tolist()
    want = [(a + e - len(t), a + n + e - len(t), q) for t, e in zip(texts, ends.tolist()) for a, n, q in brute_runs(t)]
    assert sorted(map(tuple, found)) == sorted(want)


def test_hash_sums_never_decide(monkeypatch):
    """With a hash that confuses all words, runs are still compared word by word."""
    monkeypatch.setattr(periodic, "_mixed", lambda codes: np.ones(len(codes), np.uint64))
    for s in _texts(4, 100):
        got = [(a, b - a, q) for a, b, q in periodic.find_runs(np.array(s, int), 0, 12).tolist()]
        assert set(got) <= set(brute_runs(s)) and all(q for *_, q in got)


def test_long_and_periodic():
    for s in ([0] * 30_000, [i % 37 for i in range(30_000)]):
        assert periodic.find_runs(np.array(s)).tolist() == [[0, 30_000, 1 if s[1] == 0 else 37]]
    a, b = [0], [1]
    while len(b) < 5_000:                                  # a Fibonacci word: as many runs as can be
        a, b = b, b + a
    got = [(x, y - x, q) for x, y, q in periodic.find_runs(np.array(b[:600])).tolist()]
    assert got == brute_runs(b[:600])


TEXTS = [None, "", " \t\n", "one", "a b " * 10, "x " * 12, "x " * 11, "a b c d e f g " * 2, "A a " * 9 + "é é " * 13,
         "\x0b\x0c" + "w1\rw2\tw3 " * 5 + "tail", " ".join(str(i % 500) for i in range(2_000)), "same same " * 10]


def test_digest(spark, docs_of, sf):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b " * 10), (7, "a b " * 10), (7, "a b " * 10)]
    rng = random.Random(6)
    docs += [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 120)))) for i in range(100, 300)]
    rows = periodic.digest(clashing(docs_of(docs))).collect()
    assert sorted(map(tuple, rows), key=str) == sorted((brute(*d) for d in docs), key=str)
    assert periodic.digest(docs_of([])).collect() == []


def test_query_against_brute_force(spark, documents):
    from cohortlens.llm.queries import QUERIES
    rows = documents.select("doc_id", "text").collect()
    got = QUERIES["op12_periodic"](spark, "/root/testdata/sf0.001").collect()
    small = {r.doc_id: r.text for r in rows if len(words(r.text)) <= 400}
    assert len(got) == len(rows) and len(small) > 100
    assert sorted(tuple(r) for r in got if r.doc_id in small) == sorted(brute(*d) for d in small.items())


def test_runs_and_collapse(spark, docs_of):
    docs = docs_of([(1, "go " + "a b c " * 5 + "end"), (2, "plain text"), (3, None)])
    assert [tuple(r) for r in periodic.runs(docs).collect()] == [(1, 1, 15, 3)]
    assert {r.doc_id: r.text for r in periodic.collapse(docs).collect()} == {1: "go a b c end", 2: "plain text", 3: ""}


def test_parts_of_a_batch(spark, docs_of, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(periodic, "PART_BYTES", 10)
    assert list(periodic._slices(pa.array(["a" * 30, "b", None, "c" * 9, "d"]))) == [(0, 1), (1, 3), (4, 1)]
