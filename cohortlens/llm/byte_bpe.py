"""Operator 5: byte-level BPE encoding and decoding.

A text is cut by the tokenizer's split pattern and every match is encoded on
its own, exactly as the merge loop would: repeatedly join the adjacent pair of
lowest rank.  Instead of running that loop over a match, the encoder works
left to right:

* bytes are mapped to Latin-1 characters, one each, so that an Aho-Corasick
  automaton over the vocabulary walks down to the longest token that begins at
  a position; the shorter ones there are that token's own prefixes;
* at each position it takes the longest token that is *compatible* with the
  token before it - the merge loop over the two tokens' bytes gives back just
  these two - and backtracks to shorter tokens where no choice leads on;
* a sequence whose neighbours are all compatible is what the merge loop gives.
  Compatibility depends on two tokens only, so it is memoised, and every
  position is given up at most once: the work is linear in the match length.

With the public split pattern (``SPLIT``) no match goes on from a character that
isn't white space to one that is, nor from a letter to a mark; so a text falls
into *chunks* that are split and encoded independently.  (With another pattern
a chunk is a text.)  Chunks repeat: those of a batch are cut and made distinct
by Arrow on the texts' bytes, Python sees each different one once, and each
Python worker remembers the ids of recent ones.

Defined results: a null or empty text has no ids and decodes to no bytes.
Rows are mapped one by one: repeated rows, ties and extra columns pass
through; an empty table gives an empty table.  Ids outside the vocabulary
raise in ``decode``.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from cohortlens.llm import common
from cohortlens.llm.arrays import slices, text_bytes

# Fixed value: the split pattern of the public byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBERED_CHUNKS = 200_000    # per Python worker, and as many older ones
ENCODE_ROWS = 1024             # of a batch: more rows share more chunks
PART_BYTES = 16 << 20          # of texts that are cut at once, or one text
REMEMBERED_PAIRS = 250_000
NO_RANK = 1 << 31
IDS = pa.list_(pa.field("element", pa.int32(), nullable=False))
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_MARK = np.array([32 < b < 127 and not chr(b).isalnum() for b in range(256)])


def latin_1(pattern: str) -> str:
    """The same pattern for texts of Latin-1 characters only, with its Unicode
    classes written out, for the faster standard ``re``."""
    chars = [chr(i) for i in range(256)]
    members = {kind: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == kind) for kind in "LN"}
    members["s"] = "".join(re.escape(c) for c in chars if regex.match(r"\s", c))

    def written_out(found) -> str:
        inside = re.sub(r"\\p\{([LN])\}|\\(s)", lambda m: members[m[1] or m[2]], found[0])
        return inside if found[0][0] == "[" else f"[{inside}]"

    pattern = re.sub(r"\\S", lambda m: f"[^{members['s']}]", pattern)
    return re.sub(r"\[[^\]]*\\[ps][^\]]*\]|\\p\{[LN]\}|\\s", written_out, pattern)


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairEncoder:
    def __init__(self, path: str, pattern: str):
        self.ranks = vocabulary(path)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.pattern = regex.compile(pattern).findall
        self.latin_1_pattern = re.compile(latin_1(pattern)).findall
        self.cuttable = pattern == SPLIT
        self.automaton = ahocorasick.Automaton()
        self.widest = 0
        for token, rank in self.ranks.items():
            if self.merge_loop(token) == [rank]:  # only such tokens stand inside a longer match
                self.automaton.add_word(token.decode("latin-1"), rank)
                self.widest = max(self.widest, len(token))
        self.automaton.make_automaton()
        self._starts: dict[str, int | None] = {}    # by the way down the automaton: its longest token
        self._shorter: dict[int, int | None] = {}   # of a token: the longest one that it begins with
        self._pairs: dict[int, bool] = {}
        self._chunks: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def merge_loop(self, data: bytes) -> list[int]:
        """The definition: join the leftmost pair of lowest rank until none is left."""
        rank = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        joined = [rank(data[i:i + 2], NO_RANK) for i in range(len(data) - 1)]
        while joined:
            best = min(joined)
            if best == NO_RANK:
                break
            i = joined.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del joined[i]
            if i < len(joined):
                joined[i] = rank(parts[i] + parts[i + 1], NO_RANK)
            if i:
                joined[i - 1] = rank(parts[i - 1] + parts[i], NO_RANK)
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' bytes gives back the two tokens."""
        pair = left << 32 | right
        known = self._pairs.get(pair)
        if known is None:
            if len(self._pairs) >= REMEMBERED_PAIRS:
                self._pairs.clear()
            known = self.merge_loop(self.tokens[left] + self.tokens[right]) == [left, right]
            self._pairs[pair] = known
        return known

    def _longest(self, way: str) -> int | None:
        """The longest token that ``way`` begins with."""
        for cut in range(len(way), 0, -1):
            token = self.automaton.get(way[:cut], None)
            if token is not None:
                return token
        return None

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one match."""
        whole = self.ranks.get(data)
        if whole is not None or not data:
            return [whole] if data else []
        chars, size = data.decode("latin-1"), len(data)
        tokens, starts, widest, shorter = self.tokens, self._starts, self.widest, self._next_shorter
        depth, known = self.automaton.longest_prefix, self._pairs.get
        ids: list[int] = []
        dead: set[int] = set()                # positions from which nothing leads on
        at, token, last, arrived = 0, None, None, True
        while at < size:
            if arrived:                       # begin with the longest token here
                rest = chars[at:at + widest]
                way = rest[:depth(rest)]
                token = starts.get(way, -1)
                if token == -1:
                    token = starts[way] = self._longest(way)
                arrived = False
            while token is not None:
                end = at + len(tokens[token])
                if end not in dead:
                    fits = last is None or known(last << 32 | token)
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        ids.append(token)
                        at, last, arrived = end, token, True
                        break
                token = shorter(token)
            else:                             # never come back; a shorter one for the token before
                dead.add(at)
                if not ids:
                    raise ValueError("the vocabulary does not cover every byte")
                token = ids.pop()
                at -= len(tokens[token])
                last = ids[-1] if ids else None
                token = shorter(token)
        return ids

    def _next_shorter(self, token: int) -> int | None:
        """The longest token that ``token`` begins with, but itself."""
        found = self._shorter.get(token, -1)
        if found == -1:
            found = self._shorter[token] = self._longest(self.tokens[token][:-1].decode("latin-1"))
        return found

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern(text)
        return self.latin_1_pattern(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        ranks = self.ranks.get
        ids = array("i")
        for match in self.split(text):
            data = match.encode()
            whole = ranks(data)
            if whole is not None:
                ids.append(whole)
            else:
                ids.extend(self.encode_bytes(data))
        return ids.tobytes()

    def chunks(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(chunks of all texts one after another, where each text's end): cut
        before each blank or line feed behind a character that surely isn't white
        space - an ASCII one, or one of two bytes from U+00C0 on - and before
        each ASCII mark behind an ASCII letter."""
        raw, ends = text_bytes(texts)
        ends = ends.astype(np.int64)
        cut = np.zeros(len(raw) + 1, bool)
        if len(raw) and self.cuttable:
            letter = _LETTER[raw]
            graphic = (raw > 0x20) & (raw < 0x7F)
            graphic[1:] |= (raw[1:] >= 0x80) & (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xDF)
            cut[1:-1] = (((raw[1:] == 0x20) | (raw[1:] == 0x0A)) & graphic[:-1]) | (_MARK[raw[1:]] & letter[:-1])
        cut[ends] = True
        cut[0] = True
        at = np.flatnonzero(cut)
        if len(at) < 2:
            return pa.array([], pa.large_string()), np.searchsorted(at, ends)
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)), \
            np.searchsorted(at, ends)

    def encode_texts(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; null has none."""
        chunks, ends = self.chunks(texts)
        coded = chunks.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        pieces = self._known(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        pieces = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(pieces), np.int32)))
        ids = pieces.take(pa.array(which)).flatten()
        total = np.concatenate([[0], np.cumsum(size[which])])[np.concatenate([[0], ends])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(total), ids, type=IDS)

    def _known(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks."""
        if len(self._chunks) >= REMEMBERED_CHUNKS:
            self._chunks, self._older = {}, self._chunks
        known, older = self._chunks, self._older
        out = list(map(known.get, chunks))
        for i, ids in enumerate(out):
            if ids is None:
                chunk = chunks[i]
                ids = older.get(chunk)
                out[i] = ids = self.encode(chunk) if ids is None else ids
                known[chunk] = ids
        return out


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder, with its memory, per Python worker."""
    return BytePairEncoder(path, pattern)


@lru_cache(maxsize=1)
def decoder(path: str) -> pa.Array:
    """The bytes of each id, null where there is none: all that decoding needs."""
    tokens = {i: t for t, i in vocabulary(path).items()}
    return pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text",
           ids: str = "ids") -> DataFrame:
    """``docs`` without its ``text`` column and with the array<int> column
    ``ids`` in its place.  ``ranks_path`` must be readable on every executor
    (an installed vocabulary file)."""
    common.python_workers(docs.sparkSession, ENCODE_ROWS)
    keep = [c for c in docs.columns if c not in (text, ids)]
    schema = T.StructType([docs.schema[c] for c in keep]
                          + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        return _encoded(batches, encoder(ranks_path, pattern), [*keep, ids])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text)).mapInArrow(run, schema)


def _encoded(batches, bpe: BytePairEncoder, names: list[str]):
    """Batches with the ids, named last, of their last column's texts in its place."""
    for batch in batches:
        for part in slices(batch, len(names) - 1, PART_BYTES):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], bpe.encode_texts(part.columns[-1])], names=names)


def decode(coded: DataFrame, ranks_path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``coded`` with the binary column ``data``: the bytes its ids stand for."""
    common.python_workers(coded.sparkSession, ENCODE_ROWS)
    columns = [c for c in coded.columns if c not in (ids, data)] + [ids]
    schema = T.StructType([coded.schema[c] for c in columns]
                          + [T.StructField(data, T.BinaryType(), False)])

    def run(batches):
        return _decoded(batches, decoder(ranks_path), [*columns, data])

    return coded.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def _decoded(batches, tokens: pa.Array, names: list[str]):
    """Batches with one more column, named last: the bytes of their last column's ids."""
    for batch in batches:
        lists = batch.columns[-1].fill_null([])
        found = tokens.take(lists.flatten())
        if found.null_count:
            raise KeyError("an id outside the vocabulary")
        ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int32)
        column = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), found), b"")
        yield pa.RecordBatch.from_arrays([*batch.columns, column], names=names)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids",
                  data: str = "decoded") -> DataFrame:
    """What ``decode`` gives of what ``encode`` gives, with both in one Python
    worker of a task: two in a row would take a worker each, and executors keep
    idle workers with all that they remember."""
    common.python_workers(docs.sparkSession, ENCODE_ROWS)
    keep = [c for c in docs.columns if c not in (text, ids, data)]
    schema = T.StructType([docs.schema[c] for c in keep]
                          + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False),
                             T.StructField(data, T.BinaryType(), False)])

    def run(batches):
        coded = _encoded(batches, encoder(ranks_path, pattern), [*keep, ids])
        return _decoded(coded, decoder(ranks_path), [*keep, ids, data])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text)).mapInArrow(run, schema)


def digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Contract columns of the query, from the operator's ids and bytes."""
    coded = encode_decode(docs.select("doc_id", "text"), ranks_path, pattern)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
