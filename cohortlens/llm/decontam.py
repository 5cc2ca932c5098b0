"""Operator 7: benchmark decontamination, by DataFrame functions only.

Every run of ``size`` consecutive words of a benchmark item is a window (an
item with fewer words, but not none, is one window).  A document is hit where
a window occurs in it, word for word.

A prefix-filtered set join finds the occurrences:

* the items' words are counted over all documents; windows with a word that
  no document has cannot occur and go;
* tokens are ordered by rarity.  As all words of a window must match, its
  necessary prefix is one token: the rarest one, with its offset in the window;
* document words meet the prefix tokens by equality; the positional and
  length bounds ask that the whole window fits around the match;
* what is left is verified exactly: the document's words there are the window.

Nothing of a document is shuffled but its hits.  The windows are broadcast in
blocks of at most ``BLOCK_ROWS`` rows (one block for any usual benchmark; more
blocks mean more passes, with the same result).

Defined results: null and empty texts have no words, are not hit and, as
items, have no window.  Repeated documents each get their result; rows that
share an id but not the text are judged apart.  Items with a null id hit words
but are not listed.  Repeated items count once.  Empty tables: no documents
give no rows, no items give clean documents.  Only the named columns are
read, so extra columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import ascii_lower, fitted, stored, unused

SIZE = 10
BLOCK_ROWS = 200_000
ITEMS_PER_TASK, WINDOWS_PER_TASK = 1024, 1 << 16     # of stored windows and anchors
#: What stands between words, after lower-casing A-Z.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def item_windows(benchmark: DataFrame, size: int, item_id: str, text: str) -> DataFrame:
    """(_window, _tokens, _item): every window of every item."""
    items = benchmark.select(F.col(item_id).cast("string").alias("_item"), words(F.col(text)).alias("_all"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("_all") - size, F.lit(0)))
    tokens = F.explode(F.transform(starts, lambda i: F.slice("_all", i + 1, size)))
    return (items.where(F.size("_all") > 0).select("_item", tokens.alias("_tokens"))
            .select(F.array_join("_tokens", " ").alias("_window"), "_tokens", "_item").distinct())


def _in_blocks(table: DataFrame, key: str, block_rows: int) -> list[DataFrame]:
    """``table`` in parts by key, each small enough to broadcast."""
    blocks = max(1, -(-table.count() // block_rows))
    if blocks == 1:
        return [table]
    return [table.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b) for b in range(blocks)]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text"), words(F.col(text)).alias("_all"))


def token_counts(rows: DataFrame, vocabulary: DataFrame, block_rows: int) -> DataFrame:
    """(_token, _count) of the vocabulary's tokens over all documents."""
    return _union([
        rows.select(F.explode("_all").alias("_token")).join(F.broadcast(part), "_token")
        .groupBy("_token").agg(F.count(F.lit(1)).alias("_count"))
        for part in _in_blocks(vocabulary, "_token", block_rows)])


def anchors(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(_token, _offset, _window, _tokens): per window its rarest token; ties
    go to the earliest place.  Windows with a token without count are left out."""
    placed = (windows.select("_window", "_tokens").dropDuplicates(["_window"])
              .select("_window", F.posexplode("_tokens").alias("_offset", "_token"))
              .join(counts, "_token", "left"))
    rarest = placed.groupBy("_window").agg(
        F.min(F.struct(F.coalesce("_count", F.lit(0)).alias("_count"), "_offset", "_token")).alias("_first"))
    return rarest.where(F.col("_first._count") > 0).select(
        "_window", F.col("_first._token").alias("_token"), F.col("_first._offset").alias("_offset"),
        F.split("_window", " ").alias("_tokens"))


def occurrences(docs: DataFrame, windows: DataFrame, block_rows: int = BLOCK_ROWS,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_doc, _text, _start, _length, _window): where windows occur."""
    rows = _rows(docs, doc_id, text)
    vocabulary = windows.select(F.explode("_tokens").alias("_token")).distinct()
    first = stored(fitted(anchors(windows, token_counts(rows, vocabulary, block_rows)),
                          windows.count(), WINDOWS_PER_TASK), "decontam-anchors")
    at = rows.select("*", F.posexplode("_all").alias("_pos", "_token"))
    length = F.size("_tokens")
    start = F.col("_pos") - F.col("_offset")
    fits = (start >= 0) & (start + length <= F.size("_all"))
    same = F.slice("_all", F.greatest(start, F.lit(0)) + 1, length) == F.col("_tokens")
    return _union([
        at.join(F.broadcast(part), "_token").where(fits & same)
        .select("_doc", "_text", start.alias("_start"), length.alias("_length"), "_window")
        for part in _in_blocks(first, "_token", block_rows)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_rows: int = BLOCK_ROWS,
                  doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, _text (hash), n_words, n_hit and the
    sorted array of the items that occur in it."""
    windows = stored(fitted(item_windows(benchmark, size, item_id, item_text),
                            benchmark.count(), ITEMS_PER_TASK), "decontam-windows")
    hits = stored(occurrences(docs, windows, block_rows, doc_id, text), "decontam-hits")
    row = ["_doc", "_text"]
    before = Window.partitionBy(*row).orderBy("_start", "_length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("_start") + F.col("_length")
    covered = end - F.greatest("_start", F.coalesce(F.max(end).over(before), F.lit(0)))
    n_hit = (hits.select(*row, F.greatest(covered, F.lit(0)).alias("_new"))
             .groupBy(*row).agg(F.sum("_new").alias("n_hit")))
    items = (hits.select(*row, "_window").distinct().join(windows.select("_window", "_item"), "_window")
             .groupBy(*row).agg(F.array_sort(F.collect_set("_item")).alias("items")))
    found = n_hit.join(items, (n_hit["_doc"].eqNullSafe(items["_doc"])) & (n_hit["_text"] == items["_text"])) \
        .select(n_hit["_doc"].alias("_found_doc"), n_hit["_text"].alias("_found_text"), "n_hit", "items")
    every = _rows(docs, doc_id, text).select("_doc", "_text", F.size("_all").alias("_n"))
    return (every.join(found, F.col("_doc").eqNullSafe(F.col("_found_doc"))
                       & (F.col("_text") == F.col("_found_text")), "left")
            .select(F.col("_doc").alias(doc_id), "_text", F.col("_n").cast("long").alias("n_words"),
                    F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Contract columns of the query."""
    return decontaminate(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window occurs, columns unchanged."""
    doc, text = unused(docs.columns, "_dirty_doc"), unused(docs.columns, "_dirty_text")
    dirty = (decontaminate(docs, benchmark, **options).where(F.col("n_hit") > 0)
             .select(F.col("doc_id").alias(doc), F.col("_text").alias(text)).distinct())
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty[doc]) & (F.xxhash64(docs["text"]) == dirty[text]), "left_anti")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), hit AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw USING (n, win)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""
