"""Operator 5 against tiktoken and the merge loop."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from cohortlens.llm import byte_bpe
from .conftest import clashing

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.BytePairEncoder(PATH, PATTERN)


@pytest.fixture(scope="module")
def reference(coder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={}).encode_ordinary


def _ids(coder, text):
    return np.frombuffer(coder.encode(text), np.int32).tolist()


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("ab \n'séß€日1²\x1c\u2003", max_size=60)))
def test_any_text(coder, reference, text):
    ids = _ids(coder, text)
    assert ids == reference(text)
    assert coder.encode_texts(pa.array([text, None, "", text])).to_pylist() == [ids, [], [], ids]
    assert b"".join(byte_bpe.decoder(PATH)[i].as_py() for i in ids).decode() == text


def test_matches_by_the_merge_loop(coder):
    rng = random.Random(3)
    for _ in range(300):
        data = bytes(rng.choice(b"abet \xc3\xa9") for _ in range(rng.randint(1, 40)))
        if data not in coder.ranks:
            assert coder.encode_bytes(data) == coder.merge_loop(data)


def test_unreachable_tokens_and_backtracking(tmp_path):
    """A vocabulary where the longest match is a trap, and a token no merge makes."""
    import base64
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"cd", b"xyz"]
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    coder = byte_bpe.BytePairEncoder(str(path), PATTERN)
    for n in range(6):
        for text in ("abcd" * n, "xyz" + "a" * n, "abc" + "d" * n, "bcd" * n + "abc"):
            if text.encode() not in coder.ranks:
                assert coder.encode_bytes(text.encode()) == coder.merge_loop(text.encode())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abst1.,\"- \n\t\x1c\x85\xa0\u2003\u3000é日'×", max_size=30), max_size=6))
def test_chunks_are_independent(coder, reference, texts):
    """White space of all kinds around the cuts; a slice of an array."""
    got = coder.encode_texts(pa.array(["x", *texts], pa.string()).slice(1))
    assert got.to_pylist() == [reference(t) for t in texts]


def test_chunk_memory_turns_over(coder, reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED_CHUNKS", 4)
    texts = ["one two three", "two  three four, five", "six seven eight nine", "one two"] * 3
    for text in texts:
        assert coder.encode_texts(pa.array([text])).to_pylist() == [reference(text)]


def test_long_match_is_linear(coder, reference):
    text = "ab" * 100_000
    assert len(_ids(coder, text)) > 0
    assert _ids(coder, text[:4000]) == reference(text[:4000])


def test_table(spark, documents, docs_of, coder, reference):
    rows = [(r.doc_id, r.text) for r in documents.collect()][:80] + [(None, "x"), (7, None), (7, ""), (7, ""), (8, "ü\x00")]
    got = byte_bpe.digest(clashing(docs_of(rows)), PATH, PATTERN).collect()
    want = []
    for doc_id, text in rows:
        ids = reference(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    order = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert byte_bpe.digest(docs_of([]), PATH, PATTERN).count() == 0


def test_operator_keeps_columns_and_unknown_ids_raise(spark, docs_of):
    coded = byte_bpe.encode(docs_of([(1, "hello there")]), PATH, PATTERN)
    assert coded.columns == ["doc_id", "lang", "source", "n_chars", "ids"]
    back = byte_bpe.decode(coded, PATH).first()
    assert bytes(back.decoded) == b"hello there"
    bad = spark.sql("select array(99999999) as ids")
    with pytest.raises(Exception, match="KeyError|99999999"):
        byte_bpe.decode(bad, PATH).collect()


def test_one_python_worker_encodes_and_decodes(spark, docs_of, capsys):
    docs = clashing(docs_of([(1, "hello there"), (2, None), (3, ""), (None, "ein Wort, zwei\nWörter"), (1, "hello there")]))
    both = byte_bpe.encode_decode(docs, PATH, PATTERN)
    apart = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN), PATH)
    rows = lambda df: sorted((r.doc_id or 0, r.ids or [], bytes(r.decoded), r.lang, r.score) for r in df.collect())
    assert rows(both) == rows(apart) and set(both.columns) == set(apart.columns)
    capsys.readouterr()
    byte_bpe.digest(docs, PATH, PATTERN).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1     # an executor keeps a worker for each
