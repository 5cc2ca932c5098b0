"""Operator 3: exact neighbours against brute force, held-out accuracy, edges."""
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from cohortlens.llm import toxicity
from .conftest import clashing


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 300), st.integers(1, 30), st.integers(1, 20), st.integers(0, 10_000))
def test_block_max_search_is_exact(n, n_terms, k, seed):
    rng = np.random.default_rng(seed)

    def vector():
        term = np.sort(rng.choice(n_terms, rng.integers(0, min(6, n_terms) + 1), replace=False))
        w = rng.integers(1, 5, len(term)).astype(float)
        return term, w / max(1e-12, np.sqrt((w * w).sum()))

    rows = [vector() for _ in range(n)]
    index = toxicity.BlockMaxIndex(rows, n_terms)
    dense = np.zeros((n, n_terms))
    for i, (t, w) in enumerate(rows):
        dense[i, t] = w
    for _ in range(5):
        term, weight = vector()
        query = np.zeros(n_terms)
        query[term] = weight
        cos = np.round(dense @ query, 12)
        want = [i for i in np.lexsort((np.arange(n), -cos))[:k] if cos[i] > 0]
        got, scores = index.nearest(term, weight, k)
        assert got.tolist() == want and np.allclose(scores, cos[want])


def test_vocabulary_counts_words_beginnings_and_repeats():
    texts = pa.array(["Idiotic idiots, IDIOT idiot", None, "fine", "an idiot"])
    row, value, least = toxicity.repeated_terms(texts)
    word = [(r, k) for r, v, k in zip(row, value, least)
            if v == toxicity.terms(pa.array(["idiot"]))[1][0]]
    assert sorted(word) == [(0, 1), (0, 2), (3, 1)]
    vocabulary = toxicity.Vocabulary(np.repeat(toxicity.terms(pa.array(["idiot"]))[1][:1], 2), np.array([1, 2]))
    row, term, times = vocabulary.counts(texts)
    assert sorted(zip(row.tolist(), term.tolist(), times.tolist())) == [(0, 0, 2), (0, 1, 2), (3, 0, 1)]


@pytest.fixture(scope="module")
def made(docs_of, labels_of):
    """1200 documents; label 1 where an insult or one of its inflections stands."""
    rng = np.random.default_rng(3)
    common = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(1200):
        text = list(rng.choice(common, 60))
        bad = i % 6 == 0
        for _ in range(3 if bad else 0):
            text[int(rng.integers(0, 60))] = str(rng.choice(["moron", "scumbag", "scummy", "trashy", "idiot"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_held_out_accuracy_and_evidence(spark, docs_of, labels_of, made):
    rows, labels = made
    docs, marks = clashing(docs_of(rows)), labels_of(labels)
    got = {r.doc_id: r for r in toxicity.digest(docs, marks).collect()}
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [(r.predicted, truth[i]) for i, r in got.items() if r.held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    model = toxicity.fit(docs, marks)
    learned = set(model.ids.tolist())
    assert not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in learned)
    r = toxicity.score(docs_of([(9, "you scummiest moron")]), model).first()
    assert r.predicted == 1 and r.evidence and all(e.doc_id in learned and 0 < e.cosine <= 1 + 1e-9 for e in r.evidence)


def test_edges(spark, docs_of, labels_of, made):
    rows, labels = made
    odd = [(5000, None), (5001, ""), (5002, "!!"), (5003, "word1 " * 30_000), (5003, "moron"), (5003, "moron"), (None, "idiot scumbag")]
    marks = labels_of(labels + [(5003, None, None), (5000, 1, 0), (None, 1, 1), (0, 1, 1)])
    got = toxicity.digest(docs_of(rows[:600] + odd), marks).collect()
    assert len(got) == 607
    empty = {r.score for r in got if r.doc_id in (5000, 5001, 5002)}
    assert len(empty) == 1 and empty.pop() < 0.7
    assert sorted(r.predicted for r in got if r.doc_id == 5003) == [0, 1, 1]
    assert toxicity.digest(docs_of([]), labels_of([])).count() == 0
    none = toxicity.digest(docs_of(rows[:5]), labels_of([])).collect()
    assert [round(r.score, 6) for r in none] == [0.5] * 5
    one = toxicity.digest(docs_of(rows[:5]), labels_of([(i, 1, 1) for i in range(5)])).collect()
    assert all(r.score > 0.99 for r in one)


@pytest.fixture(scope="module")
def half():
    """500 documents, half of them toxic, and some with words of no example."""
    rng = np.random.default_rng(8)
    common = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(500):
        text = list(rng.choice(common, 30))
        if i % 2:
            text[3] = str(rng.choice(["moron", "scumbag", "idiot"]))
        rows.append((i, " ".join(text)))
    rows += [(1000, "word1 word2 elsewhere unheard"), (1001, "word1 word2"), (1002, "moron " + " ".join(common[:80]) + " unseen")]
    return rows, [(i, 1, i % 2) for i in range(500)]


def test_half_of_the_labels_toxic(docs_of, labels_of, half):
    rows, labels = half
    got = toxicity.digest(docs_of(rows), labels_of(labels)).collect()
    held = [(r.predicted, r.doc_id % 2) for r in got if r.doc_id < 500 and r.held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.9


def test_cosines_over_all_terms(docs_of, labels_of, half):
    """Neighbours of every text, with cosines by the definition, also of texts
    with words that no labelled row has."""
    rows, labels = half
    docs = docs_of(rows)
    model = toxicity.fit(docs, labels_of(labels))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(r.evidence for r in got.values())
    assert all(e.cosine < 0.999 for e in got[1002].evidence)
    numbers = {(int(h) >> 8, k + 1): int(t) for h, ts in zip(model.vocabulary.hashes, model.vocabulary.term)
               for k, t in enumerate(ts) if t >= 0}
    times, n = {}, {}
    for i, text in rows:
        all_of = (toxicity.terms(pa.array([text]))[1] >> np.uint64(8)).tolist()
        _, value, least = toxicity.repeated_terms(pa.array([text]))
        times[i] = {(int(v) >> 8, int(k)): all_of.count(int(v) >> 8) for v, k in zip(value, least)}
        for t in times[i]:
            n[t] = n.get(t, 0) + 1

    def vector(i):
        return {t: (1 + np.log(x)) * (model.idf[numbers[t]] if t in numbers else
                                      toxicity.BASE * (np.log((1 + len(rows)) / (1 + n[t])) + 1))
                for t, x in times[i].items()}

    for i in (1000, 1001, 1002, 7):
        q = vector(i)
        for e in got[i].evidence[:4]:
            x = vector(e.doc_id)
            want = sum(w * x.get(t, 0) for t, w in q.items()) / np.sqrt(
                sum(w * w for w in q.values()) * sum(w * w for w in x.values()))
            assert abs(e.cosine - want) < 1e-9
