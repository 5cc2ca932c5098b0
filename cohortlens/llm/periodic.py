"""Operator 12: maximal periodic runs of words, and texts without their repeats.

A *run* is a stretch of consecutive words with smallest period q, at least
max(``min_length``, 2 q) words long, that no neighbouring word extends keeping
the period.

Method.  The first phase of a grouping suffix sorter (Baier's) sorts suffixes by
their longest Lyndon prefix: groups start as the suffixes of equal first words;
taken from the greatest down, each member hands its group's context to the
nearest suffix to the left that is not yet done, and suffixes that got equally
many leave their group for one right above it, with the context that much longer.
The context's length, when a group's turn comes, is the members' entry in the
Lyndon array: no suffix array is needed.  Doing so under the order of words and
under its reverse gives, for every run, a place whose longest Lyndon word is the
run's root (the runs theorem).  Each such root is extended to both sides by the
longest common extensions of two places one period apart; it is a run if they
reach a period.  Extensions are found by halving on sums of word hashes, for all
roots at once, and every run is then compared word by word; where that does not
hold, its root is extended word by word.

Only stretches that can hold a run are sorted: two places of a run a period apart
agree for max(min_length - q, q) words, at least half of ``min_length``.  So a
run lies in a stretch that is covered by word sequences of that length which come
again *within the stretch* (``stretches``); this leaves nothing out.

Scale: each text is worked on whole, by itself, where it is read: no shuffle, and
a lost executor costs its tasks only.  A task holds one Arrow batch, in parts of
``PART_BYTES`` of text (or one text).

Defined results: a null or empty text, or one of white space, has no words, no
run and an empty collapsed text.  A null doc_id is never altered.  Repeated rows
give repeated results; an empty table an empty one.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cohortlens.llm.common import python_workers

MIN_LENGTH = 12
PART_BYTES = 32 << 20
ALTER_MODULUS = 10
BASE = np.uint64(0x9E3779B97F4A7C15)


# --- Lyndon arrays -------------------------------------------------------------------

def lyndon_array(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place, by the grouping phase.
    ``symbols``: numbers from 0 on, without gaps; a proper prefix is smaller."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(symbols, kind="stable")
    begin = np.flatnonzero(np.diff(symbols[order], prepend=-1)).tolist() + [n]
    places = order.tolist()
    members = [places[a:b] for a, b in zip(begin, begin[1:])]
    group = symbols.tolist()
    size = [len(m) for m in members]
    context = [1] * len(members)
    under = list(range(-1, len(members) - 1))     # the next smaller group
    over = list(range(1, len(members))) + [-1]    # the next greater one
    left, right = list(range(-1, n)), list(range(1, n + 2))   # among places not done
    length = [0] * n
    g = len(members) - 1
    while g >= 0:
        u = context[g]
        got: dict[int, int] = {}
        for i in members[g]:
            if group[i] != g:
                continue                           # it left for another group
            length[i] = u
            p, r = left[i], right[i]
            left[r] = p
            if p >= 0:
                right[p] = r
                got[p] = got.get(p, 0) + 1
        if len(got) == 1:
            (p, times), = got.items()
            moves = [(times, group[p], [p])]
        elif got:
            parts: dict[tuple[int, int], list[int]] = {}
            for p, times in got.items():
                parts.setdefault((-times, group[p]), []).append(p)
            moves = [(-times, old, leaving) for (times, old), leaving in sorted(parts.items())]
        else:
            moves = ()
        for times, old, leaving in moves:
            if size[old] == len(leaving):          # all that is left of it: the group itself grows
                context[old] += times * u
                continue
            size[old] -= len(leaving)
            new = len(members)
            members.append(leaving)
            size.append(len(leaving))
            context.append(context[old] + times * u)
            above = over[old]
            under.append(old)
            over.append(above)
            over[old] = new
            if above >= 0:
                under[above] = new
            for p in leaving:
                group[p] = new
        g = under[g]
    return np.array(length, np.int64)


# --- runs -----------------------------------------------------------------------------

def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Extensions:
    """Longest common extensions of two places, for many pairs at once."""

    def __init__(self, symbols: np.ndarray):
        n = self.n = len(symbols)
        self.power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE | np.uint64(1))]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(symbols) * self.power[:-1])])

    def _same(self, i, p, length):
        """Do ``length`` words from i and from i + p agree?"""
        one = self.sums[i + length] - self.sums[i]
        two = self.sums[i + p + length] - self.sums[i + p]
        return one * self.power[p] == two

    def right(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), self.n - i - p
        while (todo := low < high).any():
            middle = (low + high + 1) // 2
            same = self._same(i, p, middle)
            low, high = np.where(todo & same, middle, low), np.where(todo & ~same, middle - 1, high)
        return low

    def left(self, i: np.ndarray, p: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(i), i.copy()
        while (todo := low < high).any():
            middle = (low + high + 1) // 2
            same = self._same(i - middle, p, middle)
            low, high = np.where(todo & same, middle, low), np.where(todo & ~same, middle - 1, high)
        return low


def _by_word(symbols: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """(start, end) of the stretch of period ``p`` around [i, i + p)."""
    start, end = i, i + p
    while start > 0 and symbols[start - 1] == symbols[start - 1 + p]:
        start -= 1
    while end < len(symbols) and symbols[end] == symbols[end - p]:
        end += 1
    return start, end


def find_runs(symbols: np.ndarray, separators: int = 0, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, end, period) of all runs, by start, then period.  The
    smallest ``separators`` symbols (numbers below it) occur once each and part
    the text: they are smaller than all others in both orders."""
    n = len(symbols)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    values, ranks = np.unique(symbols, return_inverse=True)
    reverse = np.where(ranks < separators, ranks, len(values) - 1 - ranks + separators)
    words = np.flatnonzero(ranks >= separators)
    roots = []
    for order in (ranks, reverse):
        i, p = words, lyndon_array(order)[words]
        ahead = (i + p < n) & (ranks[np.minimum(i + p, n - 1)] == ranks[i])
        behind = (i > 0) & (ranks[i - 1] == ranks[np.maximum(i + p - 1, 0)])
        roots.append(np.stack([i, p], 1)[ahead | behind])
    i, p = np.unique(np.concatenate(roots), axis=0).T
    if not len(i):
        return np.zeros((0, 3), np.int64)
    common = Extensions(ranks)
    start, end = i - common.left(i, p), i + p + common.right(i, p)
    long = end - start >= np.maximum(min_length, 2 * p)
    rows, at = np.unique(np.stack([start, end, p], 1)[long], axis=0, return_index=True)
    i = i[long][at]
    out = []
    for (a, b, q), root in zip(rows.tolist(), i.tolist()):
        if not np.array_equal(ranks[a:b - q], ranks[a + q:b]):
            a, b = _by_word(ranks, root, q)
            if b - a < max(min_length, 2 * q):
                continue
        out.append((a, b, q))
    return np.array(sorted(set(out), key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def stretches(codes: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the stretches of all texts that may hold runs; ``ends``:
    where each text's words end."""
    width, n = max(1, min_length // 2), len(codes)
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n < width:
        return nothing
    starts = ends - np.diff(ends, prepend=0)
    text = np.repeat(np.arange(len(ends)), ends - starts)
    mixed = _mixed(codes)
    gram = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        gram = gram * (BASE | np.uint64(1)) + mixed[k:n - width + 1 + k]
    at = np.flatnonzero(text[:n - width + 1] == text[width - 1:])
    gram = gram[at] + _mixed(text[at])
    order = np.argsort(gram, kind="stable")
    sorted_at, same = at[order], np.diff(gram[order]) == 0
    one, two = sorted_at[:-1][same], sorted_at[1:][same]     # a place and the next one alike
    first = np.zeros(n + 1, bool)
    first[starts[starts < n]] = True
    while len(one):
        cover = np.zeros(n + 1, np.int32)
        for places in (one, two):
            np.add.at(cover, places, 1)
            np.add.at(cover, places + width, -1)
        covered = np.cumsum(cover)[:n] > 0
        begin = covered & (first[:n] | ~np.concatenate([[False], covered[:-1]]))
        number = np.cumsum(begin)
        within = number[one] == number[two]
        if within.all():
            begins = np.flatnonzero(begin)
            size = np.bincount(number[covered], minlength=len(begins) + 1)[1:]
            return begins, begins + size
        one, two = one[within], two[within]
    return nothing


def runs_of(codes: np.ndarray, ends: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows (start, end, period) of the runs of all texts, as places in ``codes``."""
    begins, stops = stretches(codes, ends, min_length)
    if not len(begins):
        return np.zeros((0, 3), np.int64)
    size = stops - begins
    offset = np.concatenate([[0], np.cumsum(size + 1)])       # a separator behind each
    source = np.arange(size.sum()) + np.repeat(begins - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    joined = np.empty(offset[-1], np.int64)
    is_separator = np.zeros(offset[-1], bool)
    is_separator[offset[1:] - 1] = True
    joined[is_separator] = np.arange(len(begins))
    joined[~is_separator] = codes[source].astype(np.int64) + len(begins)
    found = find_runs(joined, len(begins), min_length)
    where = np.searchsorted(offset, found[:, 0], side="right") - 1
    found[:, :2] += (begins - offset[:-1])[where][:, None]
    return found


# --- texts ------------------------------------------------------------------------------

def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words one after another, where each text's words end)."""
    split = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    ends = (split.offsets.to_numpy() - split.offsets[0].as_py())[1:].astype(np.int64)
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), kept[ends]


def altered(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """(place, period) from which on a text's words are made to repeat, for a
    tenth of the ids: the contract's planted repetition."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % ALTER_MODULUS:
        return None
    g = h // ALTER_MODULUS
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def _slices(texts: pa.Array):
    """Parts of at most PART_BYTES of text, a longer text alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(size, before + PART_BYTES, side="right")))
        yield at, upto - at
        at = upto


def analyse(texts: pa.Array, doc_ids: list | None = None, min_length: int = MIN_LENGTH):
    """(words, ends, codes, dictionary, runs) of texts; with ``doc_ids``, after the
    contract's alteration."""
    words, ends = words_of(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    begin = 0
    for end, doc_id in zip(ends.tolist(), doc_ids or []):
        if change := altered(end - begin, doc_id):
            a, p = change
            codes[begin + a:end] = codes[begin + a + np.arange(end - begin - a) % p]
        begin = end
    return ends, codes, coded.dictionary, runs_of(codes, ends, min_length)


def collapsed(ends: np.ndarray, codes: np.ndarray, dictionary: pa.Array, runs: np.ndarray) -> pa.Array:
    """Texts of the words that no run holds after its first period."""
    marks = np.zeros(len(codes) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 1], -1)
    kept = np.cumsum(marks)[:-1] == 0
    upto = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], ends])].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(upto), dictionary.take(pa.array(codes[kept])))
    return pc.binary_join(lists, " ")


RUNS = "doc_id bigint, start bigint, length bigint, period bigint"


def runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """One row per run of every text of (doc_id, text): start (word number), length, period."""
    python_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, count in _slices(batch.column(1)):
                ends, _, _, found = analyse(batch.column(1).slice(at, count), None, min_length)
                text = np.searchsorted(ends, found[:, 0], side="right")
                starts = np.concatenate([[0], ends])[text]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, count).take(pa.array(text)), pa.array(found[:, 0] - starts),
                     pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], names=["doc_id", "start", "length", "period"])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, RUNS)


def collapse(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, text) with all periods of each run but its first left out."""
    python_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, count in _slices(batch.column(1)):
                ends, codes, dictionary, found = analyse(batch.column(1).slice(at, count), None, min_length)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, count), collapsed(ends, codes, dictionary, found)],
                                                 names=["doc_id", "text"])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, text string")


def _row(found: list[list[int]]) -> tuple:
    """(n_runs, start, length, period, exponent_milli, runs_sha256) of one text's
    runs (start, length, period) by start, then period."""
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    s, n, q = min(found, key=lambda r: (-r[1], r[0], r[2]))
    return len(found), s, n, q, 1000 * n // q, hashlib.sha256(listed.encode()).hexdigest()


EMPTY_ROW = (0, None, None, None, None, hashlib.sha256(b"").hexdigest())
DIGEST = ("doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
          "runs_sha256 string, collapsed_sha256 string")


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the query, after its alteration of a tenth of the texts."""
    python_workers(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at, count in _slices(batch.column(1)):
                ids = batch.column(0).slice(at, count)
                ends, codes, dictionary, found = analyse(batch.column(1).slice(at, count), ids.to_pylist())
                starts = np.concatenate([[0], ends])
                rows = [EMPTY_ROW] * count
                text = np.searchsorted(ends, found[:, 0], side="right")
                found = np.stack([found[:, 0] - starts[text], found[:, 1] - found[:, 0], found[:, 2]], 1).reshape(-1, 3)
                for k in np.unique(text):
                    rows[k] = _row(found[text == k].tolist())
                found[:, 0] += starts[text]
                found[:, 1] += found[:, 0]
                texts = collapsed(ends, codes, dictionary, found).to_pylist()
                hashes = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                *counts, listed = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(c, pa.int64()) for c in counts], pa.array(listed), pa.array(hashes)],
                    names=[c.split(" ")[0] for c in DIGEST.split(", ")])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)
