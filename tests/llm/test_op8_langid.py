"""Operator 8: gradients, held-out accuracy, calibration, edges."""
import collections
import zlib

import numpy as np

from cohortlens.llm import langid
from .conftest import clashing


def test_gram_counts_against_plain_python():
    texts = ["Añ a", None, "", "xyzxyz", "日本"]
    row, cell, times = langid.gram_counts(texts)
    for i, t in enumerate(texts):
        t = (t or "").lower()
        grams = collections.Counter(t[j:j + n] for n in (1, 2, 3) for j in range(len(t) - n + 1))
        assert times[row == i].sum() == sum(grams.values())
        alone = langid.gram_counts([t])
        assert sorted(zip(cell[row == i], times[row == i])) == sorted(zip(alone[1], alone[2]))
    assert langid.gram_counts([]) [0].size == 0


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    y = np.arange(300) % 3
    cells = [np.append(rng.choice(np.arange(10, 500), 20, replace=False), k) for k in y]
    values = [np.full(21, 21 ** -0.5)] * 300
    w = langid.ftrl(cells, values, y, 3)
    assert (w == 0).mean() > 0.9
    logits = np.array([v @ w[c] + w[langid.CELLS] for c, v in zip(cells, values)])
    assert (logits.argmax(axis=1) == y).mean() > 0.98


def test_temperature_finds_the_least_loss():
    rng = np.random.default_rng(1)
    true = rng.normal(0, 1, (4000, 3))
    y = np.array([rng.choice(3, p=p) for p in langid.softmax(true)])
    assert abs(langid.temperature_of(true * 4, y) - 4) < 0.6
    assert langid.temperature_of(np.zeros((0, 2)), np.zeros(0, int)) == 1.0


def _rows():
    rng = np.random.default_rng(2)
    parts = {"aa": ["kor", "tel", "ven", "dis"], "bb": ["ña", "ción", "lle", "rra"], "cc": ["sch", "ung", "heit", "ör"]}
    return [(i, " ".join("".join(rng.choice(parts[k], 2)) for _ in range(20)), k)
            for i, k in enumerate(np.array(["aa", "bb", "cc"])[rng.integers(0, 3, 400)].tolist())]


def test_held_out_accuracy_and_edges(spark, docs_of):
    rows = _rows()
    odd = [(9000, None, "aa"), (9001, "", "bb"), (9002, "123 !!", None), (9003, "ción " * 20_000, None), (None, "schheit", "cc"),
           (9004, "1é", "bb"), (rows[0][0], rows[0][1], rows[0][2])]
    got = langid.digest(clashing(docs_of(rows + odd))).collect()
    assert len(got) == 407
    by = {r.doc_id: r for r in got}
    truth = {i: k for i, _, k in rows}
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    held = [by[i].lang_pred == k for i, k in truth.items() if by[i].held_out]
    assert len(held) > 40 and sum(held) / len(held) > 0.97
    assert [(by[i].lang_pred, by[i].score) for i in (9000, 9001, 9002)] == [("und", 0.0)] * 3
    assert by[9003].lang_pred == "bb" and by[9004].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_or_one_language_to_learn(spark, docs_of):
    assert langid.digest(docs_of([])).count() == 0
    none = langid.digest(docs_of([(1, "text", None), (2, "more", None)])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] * 2
    one = langid.digest(docs_of([(i, "text here", "xx") for i in range(30)])).collect()
    assert {r.lang_pred for r in one} == {"xx"}


def test_held_out_rows_teach_nothing(spark, docs_of):
    rows = _rows()
    held = [(i, t, "zz") for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    model = langid.fit(docs_of([r for r in rows if zlib.crc32(str(r[0]).encode()) % 5] + held))
    assert model.languages == ["aa", "bb", "cc"]


def _cell(gram):
    code = 0
    for c in gram:
        code = (code * 0x110001 + ord(c) + 1) % 2**64
    h = code * 0x9E3779B97F4A7C15 % 2**64
    return ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64) >> (64 - langid.BITS)


def _plain_vector(text, frequency, documents):
    text = (text or "").lower()
    times = collections.Counter(_cell(text[j:j + n]) for n in (1, 2, 3) for j in range(len(text) - n + 1))
    v = {c: (1 + np.log(k)) * (np.log((1 + documents) / (1 + frequency[c])) + 1) for c, k in times.items()}
    length = np.sqrt(sum(x * x for x in v.values())) or 1.0
    return {c: x / length for c, x in v.items()}


def _plain_ftrl(vectors, y, classes, rate=0.5, beta=1.0, l1=0.02, l2=0.5, epochs=5, seed=7):
    """Follow the regularised leader, coordinate by coordinate."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(c, k):
        penalty = 0.0 if c == langid.CELLS else l1
        if abs(z[c, k]) <= penalty:
            return 0.0
        return (np.sign(z[c, k]) * penalty - z[c, k]) / ((beta + np.sqrt(n[c, k])) / rate + l2)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            x = {**vectors[i], langid.CELLS: 1.0}
            w = {(c, k): weight(c, k) for c in x for k in range(classes)}
            logits = np.array([sum(x[c] * w[c, k] for c in x) for k in range(classes)])
            p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
            for k in range(classes):
                for c in x:
                    g = x[c] * (p[k] - (k == y[i]))
                    z[c, k] += g - (np.sqrt(n[c, k] + g * g) - np.sqrt(n[c, k])) / rate * w[c, k]
                    n[c, k] += g * g
    return weight


def test_query_scores_by_the_definition(spark, docs_of):
    """Document frequencies, vectors, training, calibration and scores of the
    whole query, recomputed with dictionaries."""
    rows = _rows()[:120]
    got = {r.doc_id: r for r in langid.digest(docs_of(rows)).collect()}
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    frequency = collections.Counter()
    for _, t, _ in learned:
        frequency.update({_cell(t[j:j + n]) for n in (1, 2, 3) for j in range(len(t) - n + 1)})
    learned.sort(key=lambda r: (r[2], r[0]))
    vectors = [_plain_vector(t, frequency, len(learned)) for _, t, _ in learned]
    y = np.array(["aa bb cc".split().index(k) for *_, k in learned])
    train = [i for i in range(len(learned)) if i % 5]
    weight = _plain_ftrl([vectors[i] for i in train], y[train], 3)
    logits = lambda v: np.array([sum(x * weight(c, k) for c, x in v.items()) + weight(langid.CELLS, k) for k in range(3)])
    tune = [i for i in range(len(learned)) if i % 5 == 0]
    temperature = langid.temperature_of(np.array([logits(vectors[i]) for i in tune]), y[tune])
    for i, t, _ in rows:
        s = logits(_plain_vector(t, frequency, len(learned))) / temperature
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert got[i].lang_pred == "aa bb cc".split()[p.argmax()] and abs(got[i].score - p.max()) < 1e-4


def test_sample_is_balanced(spark, docs_of):
    rows = [(i, f"text {i}", "big") for i in range(3000)] + [(5000 + i, f"rare {i}", "rare") for i in range(40)]
    rows += [(7, "again", "big")] * 300 + [(None, "no id", "rare")] * 3
    got = langid.balanced_sample(docs_of(rows).select("doc_id", "text", "lang"), per_language=100, most_rows=150).collect()
    n = collections.Counter(r.lang for r in got)
    assert n["rare"] >= 40 and n["big"] <= 110 and len(got) <= 150      # the rare language is not crowded out
    assert len({(r.doc_id, r.lang) for r in got}) == len(got)
    again = langid.balanced_sample(docs_of(rows).select("doc_id", "text", "lang").repartition(7), 100, 150).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
