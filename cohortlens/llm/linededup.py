"""Operator 10: reversible, incremental line deduplication.

A line's key is the line without white space at both ends and with A-Z
lower-cased.  A key of at least ``min_chars`` code points found in at least
``min_docs`` documents is a *repeat*: its lines go everywhere except in the
largest document id that holds it.

The index has three tables, all sharded by key hash:

* ``references``: one row per (key, document, line number) - the exact truth;
* ``counts``: per key, the number of documents and the largest id;
* ``filters``: per shard, cuckoo filters over the keys that are repeats now.
  A filter has 4 fingerprints of 16 bits a bucket, packed into one long, so a
  lookup is plain column arithmetic.  Fingerprints can be taken out again, so
  deleting a document undoes what inserting it did.  A full filter gets a
  twice as large successor in its shard's chain.

``insert`` and ``delete`` touch only the keys of the documents that come or
go.  Kept text is derived from the index on demand: a line whose key the
filters don't know stays without further work; the rest (repeats and the few
false positives) meet the exact counts.  Filters only prune, never decide.

Scale: per-document references are shuffled by (key, document), so no key is
hot; counts are pre-aggregated before their shuffle; the join of surviving
lines with counts is a plain equi-join that adaptive execution may split.
Filters are broadcast only while their stored size is at most
``BROADCAST_BYTES``; beyond it lines and filters meet by shard and salt, so that
the lines of a frequent key don't land in one task.  Either way every line
passes its shard's filters, with the same result.

Keys are represented by two 64-bit hashes with different seeds (128 bits).

Defined results: a null or empty text is one empty line.  Rows with the same
id are one document (a key in two of them counts once); each keeps its own
text.  A null id counts as one document, smaller than any other.  Repeated
rows give repeated results.  An empty table gives an empty result.  Extra
columns pass through ``keep_lines``.  Very long texts are split whole.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm.common import LINKS_PER_TASK, ascii_lower, fitted, python_workers, stored, unused

WHITE_SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
KEYS_PER_SHARD = 1 << 15
BROADCAST_BYTES = 64 << 20
SALTS = 16
LANES, LANE_BITS, LANE_MASK = 4, 16, 0xFFFF
MAX_KICKS = 500
MIX = 0x5BD1E995
NO_ID = -(1 << 63)

KEY = ["_h1", "_h2"]
ROW = ["_doc", "_text"]


# --- cuckoo filter -----------------------------------------------------------

def _slots(h2: int, mask: int) -> tuple[int, int, int]:
    mark = (h2 & LANE_MASK) or 1
    first = (h2 >> LANE_BITS) & mask
    return mark, first, first ^ ((mark * MIX) & mask)


class CuckooFilter:
    """Partial-key cuckoo filter; ``buckets`` has LANES marks a row, 0 = free."""

    def __init__(self, buckets: np.ndarray):
        self.buckets, self.mask = buckets, len(buckets) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        n = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / (LANES * 0.85)))))
        return cls(np.zeros((n, LANES), np.uint16))

    def _put(self, at: int, mark: int) -> bool:
        free = np.flatnonzero(self.buckets[at] == 0)
        if len(free):
            self.buckets[at, free[0]] = mark
        return bool(len(free))

    def insert(self, h2: int) -> bool:
        """False (and unchanged) if no place was found."""
        mark, one, two = _slots(h2, self.mask)
        if self._put(one, mark) or self._put(two, mark):
            return True
        at, moved = two, []
        for kick in range(MAX_KICKS):
            lane = (kick * 7 + mark) % LANES
            moved.append((at, lane))
            mark, self.buckets[at, lane] = int(self.buckets[at, lane]), mark
            at ^= (mark * MIX) & self.mask
            if self._put(at, mark):
                return True
        for at, lane in reversed(moved):  # undo: a mark must never get lost
            mark, self.buckets[at, lane] = int(self.buckets[at, lane]), mark
        return False

    def remove(self, h2: int) -> bool:
        mark, one, two = _slots(h2, self.mask)
        for at in (one, two):
            found = np.flatnonzero(self.buckets[at] == mark)
            if len(found):
                self.buckets[at, found[0]] = 0
                return True
        return False

    def __contains__(self, h2: int) -> bool:
        mark, one, two = _slots(h2, self.mask)
        return bool((self.buckets[one] == mark).any() or (self.buckets[two] == mark).any())

    def packed(self) -> list[int]:
        return np.ascontiguousarray(self.buckets).view("<i8").ravel().tolist()

    @classmethod
    def unpacked(cls, longs) -> CuckooFilter:
        return cls(np.array(longs, "<i8").view(np.uint16).reshape(-1, LANES).copy())


GONE, COME, KEPT = 0, 1, 2


def _change_filters(chains: pd.DataFrame, changes: pd.DataFrame) -> list[list[int]]:
    """A shard's chain after taking out and putting in the changed keys.  In a
    chain of several filters an equal mark may be another key's, so taking keys
    out builds the chain anew from all keys that are left (kind KEPT)."""
    chain = [CuckooFilter.unpacked(t) for t in chains["tables"].iloc[0]] if len(chains) else []
    gone, come, kept = (changes["_h2"][changes["kind"] == kind].tolist() for kind in (GONE, COME, KEPT))
    if gone and len(chain) > 1:
        chain, gone, come = [CuckooFilter.sized(len(kept))], [], kept
    for h2 in gone:
        any(f.remove(h2) for f in chain)
    if not chain:
        chain = [CuckooFilter.sized(len(come))]
    for h2 in come:
        if not chain[-1].insert(h2):
            chain.append(CuckooFilter.sized(2 * LANES * len(chain[-1].buckets)))
            chain[-1].insert(h2)
    return [f.packed() for f in chain]


def _update_filters(filters: DataFrame | None, changes: DataFrame) -> DataFrame:
    """``changes``: (_shard, _h2, kind), keys that became repeats or ceased to be,
    and, of shards that lose one, all keys that are repeats then."""
    schema = "_shard int, tables array<array<bigint>>"
    python_workers(changes.sparkSession)
    if filters is None:
        return changes.groupBy("_shard").applyInPandas(
            lambda key, c: pd.DataFrame({"_shard": [key[0]], "tables": [_change_filters(c.iloc[:0], c)]}), schema)
    return filters.groupBy("_shard").cogroup(changes.groupBy("_shard")).applyInPandas(
        lambda key, f, c: pd.DataFrame({"_shard": [key[0]], "tables": [_change_filters(f, c)]}), schema)


def _maybe_known(tables, h2):
    """Column form of ``in``: whether a chain of packed filters may hold the key."""
    mark = F.when(h2.bitwiseAND(LANE_MASK) == 0, 1).otherwise(h2.bitwiseAND(LANE_MASK))

    def in_table(table):
        mask = F.size(table).cast("long") - 1
        one = F.shiftright(h2, LANE_BITS).bitwiseAND(mask)
        two = one.bitwiseXOR((mark * MIX).bitwiseAND(mask))
        hit = F.lit(False)
        for at in (one, two):
            bucket = F.get(table, at.cast("int"))
            for lane in range(LANES):
                hit = hit | (F.shiftrightunsigned(bucket, LANE_BITS * lane).bitwiseAND(LANE_MASK) == mark)
        return hit

    return F.exists(tables, in_table)


# --- index -------------------------------------------------------------------

@dataclass(frozen=True)
class LineIndex:
    references: DataFrame    # _h1, _h2, _doc, _text, _line
    counts: DataFrame        # _h1, _h2, n_docs, last_doc
    filters: DataFrame       # _shard, tables
    n_shards: int
    min_chars: int
    min_docs: int


def _lines(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _named(docs: DataFrame, doc_id: str, text: str) -> list:
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_doc"),
            F.xxhash64(F.col(text)).alias("_text")]


def line_references(docs: DataFrame, min_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line whose key is long enough to count."""
    rows = docs.select(*_named(docs, doc_id, text), F.posexplode(_lines(F.col(text))).alias("_line", "_value"))
    key = ascii_lower(F.btrim("_value", F.lit(WHITE_SPACE)))
    return (rows.where(F.char_length("_value") >= min_chars)
            .select(*ROW, "_line", key.alias("_key"))
            .where(F.char_length("_key") >= min_chars)
            .select(F.xxhash64("_key").alias("_h1"),
                    F.xxhash64(F.lit("second seed"), "_key").alias("_h2"), *ROW, "_line"))


def _count(references: DataFrame) -> DataFrame:
    """The first shuffle is by (key, document): even for a key of every document."""
    return (references.select(*KEY, "_doc").distinct()
            .groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("_doc").alias("last_doc")))


def _sharded(keys: DataFrame, n_shards: int) -> DataFrame:
    return keys.withColumn("_shard", F.pmod("_h1", F.lit(n_shards)).cast("int"))


def build(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
          keys_per_shard: int = KEYS_PER_SHARD, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
    references = stored(line_references(docs, min_chars, doc_id, text), "line-references")
    counts = stored(fitted(_count(references), references.count(), LINKS_PER_TASK), "line-counts")
    repeats = counts.where(F.col("n_docs") >= min_docs)
    n_shards = max(1, -(-repeats.count() // keys_per_shard))
    changes = _sharded(repeats, n_shards).select("_shard", "_h2", F.lit(COME).alias("kind"))
    filters = stored(_update_filters(None, changes), "line-filters")
    return LineIndex(references, counts, filters, n_shards, min_chars, min_docs)


def _changed(index: LineIndex, before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys that became or ceased to be repeats, of those with changed counts."""
    was, now = F.coalesce("was", F.lit(0)), F.coalesce("now", F.lit(0))
    both = (before.select(*KEY, F.col("n_docs").alias("was"))
            .join(after.select(*KEY, F.col("n_docs").alias("now")), KEY, "full_outer"))
    return (_sharded(both, index.n_shards)
            .where((was >= index.min_docs) != (now >= index.min_docs))
            .select("_shard", "_h2", F.when(now >= index.min_docs, COME).otherwise(GONE).alias("kind")))


def _recount(index: LineIndex, references: DataFrame, touched: DataFrame) -> LineIndex:
    """``index`` with ``references`` and exact counts for the touched keys."""
    before = index.counts.join(touched, KEY, "left_semi")
    after = stored(_count(references.join(touched, KEY, "left_semi")), "line-recount")
    counts = stored(index.counts.join(touched, KEY, "left_anti").unionByName(after), "line-counts")
    changes = stored(_changed(index, before, after), "line-changes")
    losing = changes.where(F.col("kind") == GONE).select("_shard").distinct()
    kept = (_sharded(counts.where(F.col("n_docs") >= index.min_docs), index.n_shards)
            .join(losing, "_shard", "left_semi").select("_shard", "_h2", F.lit(KEPT).alias("kind")))
    filters = stored(_update_filters(index.filters, changes.unionByName(kept)), "line-filters")
    return replace(index, references=references, counts=counts, filters=filters)


def insert(index: LineIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> LineIndex:
    """The index with more documents; rows of an id it has join that document."""
    new = stored(line_references(docs, index.min_chars, doc_id, text), "line-references")
    return _recount(index, index.references.unionByName(new), new.select(*KEY).distinct())


def delete(index: LineIndex, doc_ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
    """The index without the documents whose ids ``doc_ids`` lists."""
    ids = doc_ids.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_doc")).distinct()
    gone = stored(index.references.join(ids, "_doc", "left_semi").select(*KEY).distinct(), "line-gone")
    left = stored(index.references.join(ids, "_doc", "left_anti"), "line-references")
    return _recount(index, left, gone)


def dropped_lines(index: LineIndex) -> DataFrame:
    """(_doc, _text, dropped): line numbers that go, per document row."""
    lines = _sharded(index.references, index.n_shards)
    if _filter_bytes(index) <= BROADCAST_BYTES:
        lines = lines.join(F.broadcast(index.filters), "_shard")
    else:   # the filters come to the lines' shards; a key's lines are spread over salts
        salted = index.filters.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        lines = lines.withColumn("_salt", F.pmod(F.xxhash64(*ROW, "_line"), F.lit(SALTS)).cast("int")) \
            .join(salted, ["_shard", "_salt"])
    lines = lines.where(_maybe_known(F.col("tables"), F.col("_h2")))
    repeats = index.counts.where(F.col("n_docs") >= index.min_docs).select(*KEY, "last_doc")
    return (lines.select(*KEY, *ROW, "_line").join(repeats, KEY)
            .where(F.col("_doc") != F.col("last_doc"))
            .groupBy(*ROW).agg(F.collect_set("_line").alias("dropped")))


def _filter_bytes(index: LineIndex) -> int:
    longs = F.aggregate("tables", F.lit(0), lambda total, table: total + F.size(table))
    return 8 * (index.filters.agg(F.sum(longs).alias("n")).first()["n"] or 0)


def keep_lines(index: LineIndex, docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
               names: tuple[str, str, str] = ("_n_lines", "_n_dropped", "_kept")) -> DataFrame:
    """``docs`` with three more columns, ``names``, which it must not have: the
    number of lines, of dropped ones, and the text without these.  ``docs`` are
    documents the index holds.  Its own columns travel as one struct, so none of
    them meets an inner name."""
    whole = unused([*docs.columns, *names], "_whole")
    body = F.col(whole).getField(text)
    lines = _lines(body)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), F.coalesce(body, F.lit(""))).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    n_lines, n_dropped, left = names
    return (docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole), *_named(docs, doc_id, text))
            .join(dropped_lines(index), ROW, "left")
            .select(whole, F.size(lines).cast("long").alias(n_lines),
                    F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias(n_dropped),
                    kept.alias(left))
            .select(f"{whole}.*", *names))


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the query."""
    docs = docs.select("doc_id", "text")
    return keep_lines(build(docs), docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
WITH split_up AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM split_up
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
  FROM numbered
), repeats AS (
  SELECT line_key, max(doc_id) AS keeper FROM keyed WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone
  FROM keyed k LEFT JOIN repeats r USING (line_key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
