"""Operator 6: signatures against the definition, classes against brute force."""
import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from cohortlens.llm import bagminhash
from cohortlens.llm.components import components
from cohortlens.llm.shingles import multisets, words
from .conftest import clashing

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _words(text):
    return WORD.findall((text or "").encode().translate(LOWER))


def _multiset(text):
    w = _words(text)
    if not w:
        return collections.Counter([("text", text or "")])
    return collections.Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def _similarity(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def _brute(rows):
    """Per row the smallest id of its component, over all pairs."""
    sets = [_multiset(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if _similarity(sets[i], sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    return sorted(((d, min((x for x in ids[root(i)] if x is not None), default=None), len(ids[root(i)]))
                   for i, (d, _) in enumerate(rows)), key=str)


def test_words_and_multisets_of_a_batch():
    texts = ["One two, TWOé 3x", None, "", "...", "a", "one two twoé 3x one two twoé 3x one", "é" * 3000, "b\x00c"]
    row, word = words(pa.array(texts))
    assert [int((row == i).sum()) for i in range(len(texts))] == [len(_words(t)) for t in texts]
    spelled = [w for t in texts for w in _words(t)]
    assert len(set(word.tolist())) == len(set(spelled))
    assert {(a, b) for a, b in zip(spelled, word.tolist())} == set(zip(spelled, word.tolist()))
    row, value, times = multisets(pa.array(texts).slice(3, 4), 5)
    want = [_multiset(t) if _words(t) else {} for t in texts[3:7]]
    assert [sorted(times[row == i].tolist()) for i in range(4)] == [sorted(dict(w).values()) for w in want]


def test_signature_is_unbiased_for_weighted_jaccard():
    rng = np.random.default_rng(5)
    off = []
    for seed in range(60):
        values = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
        row = np.concatenate([np.zeros(40, int), np.ones(40, int)])
        keep = np.concatenate([a, b]) > 0
        s = bagminhash.signatures(row[keep], np.concatenate([values, values])[keep], np.concatenate([a, b])[keep], 2)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08


def test_same_multiset_same_signature_in_any_batch():
    text = "the quick brown fox jumps over the lazy dog again and again"
    one = multisets(pa.array([text]), 5)
    two = multisets(pa.array(["noise words here", text, "more"]), 5)
    a = bagminhash.signatures(*one, 1)[0]
    assert (bagminhash.signatures(*two, 3)[1] == a).all()


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 101), (205, 200), (203, 205), (101, 100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 200, 203: 200, 205: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: list(rng.choice(vocabulary, n))
    base = draw(120)
    rows = [(i, " ".join(draw(60))) for i in range(40)]
    rows += [(100 + i, " ".join(base[:i * 4 + 20])) for i in range(26)]         # a chain of links
    for i in range(30):                                                          # near copies of one text
        copy = list(base)
        copy[int(rng.integers(0, 120))] = "other"
        rows.append((200 + i, " ".join(copy)))
    rows += [(300, "A b, c"), (301, "a B c!"), (302, "a b"), (303, None), (304, ""), (305, "?!"), (306, "?!"), (307, "!?"),
             (300, "A b, c"), (None, "a b c"), (None, "only here with no id at all"), (400, " ".join(["na"] * 5000)),
             (401, " ".join(["na"] * 4500)), (402, " ".join(["na"] * 3000)), (403, " ".join(draw(20_000)))]
    return rows


def test_classes(spark, docs_of, rows):
    got = bagminhash.classes(clashing(docs_of(rows))).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows)


def test_blocks_of_a_bucket_and_one_kept(spark, docs_of, rows, monkeypatch):
    monkeypatch.setattr(bagminhash, "BLOCK", 4)
    kept = bagminhash.keep_one(docs_of(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {(c if c is not None else d) for d, c, _ in _brute(rows)}
    assert sorted(kept.collect(), key=str) and {r.doc_id for r in kept.collect()} == want
    assert kept.count() == len(want)


def test_empty(docs_of):
    assert bagminhash.classes(docs_of([])).count() == 0
    assert bagminhash.keep_one(docs_of([])).count() == 0


def test_links_whose_sketches_agree_least(docs_of):
    """Pairs at similarity 0.8 that share a band, though their sketches agree in less than 70 % of the slots."""
    rng = np.random.default_rng(21)
    pairs = []
    for i in range(3000):
        w = [f"p{i}x{j}" for j in rng.integers(0, 10 ** 6, 54)]
        pairs.append((" ".join(w[:49]), " ".join(w[:44] + w[49:])))
    points = bagminhash.signatures(*multisets(pa.array([t for p in pairs for t in p]), 5), 6000).reshape(3000, 2, 125)
    same = points[:, 0] == points[:, 1]
    agree = ((points[:, 0] ^ points[:, 1]) & np.uint64(255) == 0).sum(axis=1)
    hard = np.flatnonzero((agree < 0.7 * 125) & same.reshape(3000, 25, 5).all(axis=2).any(axis=1))
    assert len(hard) >= 3 and all(_similarity(*map(_multiset, pairs[i])) == 0.8 for i in hard)
    rows = [(int(2 * i + k), pairs[i][k]) for i in hard for k in (0, 1)]
    got = bagminhash.classes(docs_of(rows)).select("doc_id", "class_id", "class_size").collect()
    assert sorted(map(tuple, got), key=str) == _brute(rows)


def test_oracle(spark, documents, docs_of):
    import duckdb
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    odd = [(1, base), (2, base + " fifteen"), (3, None), (4, ""), (5, "!!"), (6, "!!"), (7, "two words"), (8, "Two, words"), (9, "é é")]
    for df in (documents, docs_of(odd)):
        con = duckdb.connect()
        con.register("documents", df.select("doc_id", "text").toPandas())
        want = con.execute(f"SELECT doc_id, class_id, class_size FROM ({bagminhash.ORACLE})").fetchall()
        assert sorted(map(tuple, bagminhash.classes(df).collect())) == sorted(want)
