"""Operator 13: exact deduplication over an extendible-hash index on shared files.

Two texts are equal when their normalised forms are, byte for byte: each run of
ASCII white space becomes one space.  A text's key is 64 bits of hash.

The index has two parts, both tables in the shared folder:

* ``entries``: one row per different text - key, place in the key's chain,
  SHA-256, size, copies, and the row that stays.  Files hold ranges of keys in
  ascending order, so a lookup prunes by Parquet's statistics;
* ``directory``: one row per bucket: how many leading bits of the key the
  bucket owns (its depth), their value, its number of entries and the
  generation of files that holds it.  A bucket beyond ``capacity`` entries is
  split by the next bit, the directory doubles where its deepest bucket is
  split, and so on until all fit.  A bucket whose keys can't be told apart by
  the directory's bits overflows: chains have any length.

Bytes are compared where copies meet: texts are grouped by (key, text), within
a task before the shuffle, so a text with a third of all rows crosses it once
per task.  Owner tasks then take a range of keys each, link the different texts
of a key into its chain and check them against the rows: each (key, digest)
must be one text, held by as many rows as have it; otherwise they raise.  So a
row finds its entry by key and digest alone, and texts move once.

``insert`` adds documents: only buckets that get new keys are rewritten, as a
new generation, and split where overfull; the others keep their files.

Scale: rows of a text with more than 1/``HOT`` of all rows (so at most ``HOT``
texts) are salted, and their entry replicated, for the join that brings the
result back to the rows; only those are broadcast.  Capacity grows with
the entries, so a directory has about 2^17 buckets at most; it is broadcast.

Defined results: a null text is an empty one; a text of white space is one
space, so it isn't empty.  The smallest doc_id stays, a null id only where all
ids are null; of several rows with that id one, and only one, stays.  Repeated
rows count as rows.  An empty table gives an empty result.  Whole texts are
compared.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortlens.llm.common import python_workers, stored

CAPACITY = 4096          # entries of a bucket, at least
MOST_BUCKETS_BITS = 16   # capacity grows so that about 2^16 full buckets hold all entries
SPARE_BITS = 4           # a bucket may be this much deeper than the average
HOT = 1000
OWNER_ROWS = 1 << 16
KEY = ["key", "sha"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def key_of(text: Column, key_bits: int = 64) -> Column:
    """The first ``key_bits`` bits of the hash (fewer make collisions, for tests)."""
    mask = -1 if key_bits >= 64 else -(1 << (64 - key_bits)) if key_bits else 0
    return F.xxhash64(text).bitwiseAND(F.lit(mask).cast("long"))


def prefix(key: Column, bits: Column | int) -> Column:
    """The first ``bits`` bits of a key as a number (0 for none)."""
    return F.call_function("shiftrightunsigned", F.call_function("shiftrightunsigned", key, F.lit(63) - bits), F.lit(1))


@dataclass
class Index:
    """``generations``: entry tables; ``directory``: depth, prefix, n, generation."""
    generations: list[DataFrame]
    directory: DataFrame
    key_bits: int
    capacity: int

    @property
    def depth(self) -> int:
        """Bits of the directory: its deepest bucket's."""
        return self.directory.agg(F.max("depth")).first()[0]


# --- rows and texts ----------------------------------------------------------------

def rows_of(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """(doc_id, key, sha, row) of every row, stored."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("text"))
    return stored(text.select("doc_id", key_of(F.col("text"), key_bits).alias("key"), F.unhex(F.sha2("text", 256)).alias("sha"))
                  .withColumn("row", F.monotonically_increasing_id()), "dedup-rows")


def _texts(docs: DataFrame, key_bits: int) -> DataFrame:
    """One row per different text, its copies counted by comparing bytes."""
    return (docs.select(normalised(F.col("text")).alias("text"))
            .groupBy(key_of(F.col("text"), key_bits).alias("key"), "text").agg(F.count(F.lit(1)).alias("copies"))
            .select("key", F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").cast("long").alias("size"), "copies"))


def _groups(rows: DataFrame) -> DataFrame:
    """Per (key, digest): its rows and the first of them."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), first.alias("first"))


def _chained(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries: owner tasks meet the texts and the rows of a range of keys, check
    one against the other and number the texts of each key."""
    python_workers(texts.sparkSession, OWNER_ROWS)
    both = (texts.select(*KEY, F.lit(0).alias("side"), "size", "copies", F.lit(None).cast("long").alias("doc_id"),
                         F.lit(None).cast("long").alias("row"))
            .unionByName(groups.select(*KEY, F.lit(1).alias("side"), F.lit(0).cast("long").alias("size"), "copies",
                                       F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row"))))
    dealt = both.repartitionByRange("key").sortWithinPartitions("key", "sha", "side")

    def own(batches):
        rest, last_key, last_link = None, None, -1
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            whole = table.num_rows - table.num_rows % 2       # a text and its rows lie beside each other
            rest, table = table.slice(whole), table.slice(0, whole).combine_chunks()
            if not whole:
                continue
            texts, held = (table.take(pa.array(np.arange(side, whole, 2))) for side in (0, 1))
            for name in ("key", "sha", "copies"):
                if not texts.column(name).equals(held.column(name)):
                    raise ValueError("the rows of a digest are not the copies of one text")
            if texts.column("side").to_numpy().any() or not held.column("side").to_numpy().all():
                raise ValueError("a key has two texts of one digest")
            keys = texts.column("key").to_numpy()
            begin = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if keys[0] > -(1 << 63) else 1))
            link = np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys))))
            if last_key is not None and keys[0] == last_key:
                link[:begin[1] if len(begin) > 1 else len(keys)] += last_link + 1
            last_key, last_link = keys[-1], int(link[-1])
            yield from pa.table({
                "key": texts.column("key"), "link": pa.array(link, pa.int64()), "sha": texts.column("sha"),
                "size": texts.column("size"), "copies": texts.column("copies"),
                "keep_id": held.column("doc_id"), "keep_row": held.column("row")}).to_batches()
        if rest is not None and rest.num_rows:
            raise ValueError("a text without rows")

    return dealt.mapInArrow(own, "key bigint, link bigint, sha binary, size bigint, copies bigint, keep_id bigint, keep_row bigint")


# --- directory ---------------------------------------------------------------------

def _split(entries: DataFrame, capacity: int, deepest: int, generation: int) -> DataFrame:
    """Buckets for ``entries`` (key, base): from depth ``base`` on, a bucket beyond
    ``capacity`` becomes the two of the next bit."""
    fine = entries.groupBy("base", prefix(F.col("key"), deepest).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    nodes = (fine.select("base", "p", "n", F.explode(F.sequence(F.col("base"), F.lit(deepest))).alias("depth"))
             .groupBy("base", "depth", F.call_function("shiftright", F.col("p"), F.lit(deepest) - F.col("depth")).alias("prefix"))
             .agg(F.sum("n").alias("n")))
    nodes = stored(nodes, "dedup-prefixes")
    overfull = (F.col("n") > capacity) & (F.col("depth") < deepest)
    halves = (nodes.where(overfull)
              .select("base", (F.col("depth") + 1).alias("depth"),
                      F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
              .join(nodes, ["base", "depth", "prefix"], "left").withColumn("n", F.coalesce("n", F.lit(0))))
    buckets = nodes.where(F.col("depth") == F.col("base")).select("base", "depth", "prefix", "n").unionByName(halves)
    return buckets.where(~overfull).select("depth", "prefix", "n", F.lit(generation).alias("generation"))


def _deepest(entries: int, capacity: int) -> int:
    return max(0, math.ceil(math.log2(max(1, entries) / capacity))) + SPARE_BITS


def routed(entries: DataFrame, directory: DataFrame, bits: int) -> DataFrame:
    """``entries`` with their bucket's depth, prefix and generation: 2^``bits``
    pointers, as many of them as a bucket is less deep lead to it."""
    below = F.lit(bits) - F.col("depth")
    first = F.call_function("shiftleft", F.col("prefix"), below)
    pointers = directory.select("depth", "prefix", "generation", F.explode(F.sequence(
        first, first + F.call_function("shiftleft", F.lit(1).cast("long"), below) - 1)).alias("_pointer"))
    return (entries.withColumn("_pointer", prefix(F.col("key"), bits))
            .join(F.broadcast(pointers), "_pointer").drop("_pointer"))   # bounded: see the module's text


ENTRY = ["key", "link", "sha", "size", "copies", "keep_id", "keep_row"]


def build(docs: DataFrame, key_bits: int = 64, capacity: int = CAPACITY) -> tuple[Index, DataFrame]:
    """The index of ``docs``, and their rows as ``members`` takes them."""
    rows = rows_of(docs, key_bits)
    entries = stored(_chained(_texts(docs, key_bits), _groups(rows)), "dedup-entries")
    n = entries.count()
    capacity = max(capacity, n >> MOST_BUCKETS_BITS)
    spark = docs.sparkSession
    directory = _split(entries.select("key", F.lit(0).alias("base")), capacity, _deepest(n, capacity), 0)
    if not n:
        directory = spark.createDataFrame([(0, 0, 0, 0)], directory.schema)
    return Index([entries], stored(directory, "dedup-directory"), key_bits, capacity), rows


def entries_of(index: Index) -> DataFrame:
    """All entries with their bucket: of each generation, those that the
    directory still has there."""
    out, bits = None, index.depth
    for generation, files in enumerate(index.generations):
        here = routed(files, index.directory, bits).where(F.col("generation") == generation)
        out = here if out is None else out.unionByName(here)
    return out


def insert(index: Index, docs: DataFrame) -> tuple[Index, DataFrame]:
    """The index with ``docs`` added, and the new rows.  Row numbers of the new
    documents follow all earlier ones.  A new text is an old one when key, size
    and SHA-256 agree (the index keeps no texts to compare with)."""
    bits, generation = index.depth, len(index.generations)
    rows = rows_of(docs, index.key_bits).withColumn("row", F.col("row") + F.lit(generation).cast("long") * (1 << 56))
    new = routed(_chained(_texts(docs, index.key_bits), _groups(rows)), index.directory, bits)
    new = stored(new, "dedup-new")
    touched = new.select("depth", "prefix").distinct()
    old = entries_of(index).join(touched, ["depth", "prefix"], "left_semi")
    first = F.min(F.struct(F.col("keep_id").isNull().alias("no_id"), "keep_id", "keep_row"))
    merged = (old.unionByName(new).groupBy("depth", "prefix", "key", "size", "sha")
              .agg(F.sum("copies").alias("copies"), first.alias("first"), F.min("link").alias("_link")))
    in_chain = F.expr("row_number() over (partition by depth, prefix, key order by _link, size, sha) - 1")
    merged = stored(merged.select("key", in_chain.cast("long").alias("link"), "sha", "size", "copies",
                                  F.col("first.keep_id").alias("keep_id"), F.col("first.keep_row").alias("keep_row"),
                                  F.col("depth").alias("base")).repartitionByRange("key").sortWithinPartitions("key"),
                    "dedup-entries")
    n = index.directory.agg(F.sum("n")).first()[0] + new.count()
    deepest = max(bits, _deepest(n, index.capacity))
    split = _split(merged.select("key", "base"), index.capacity, deepest, generation)
    kept = index.directory.join(touched, ["depth", "prefix"], "left_anti")
    directory = stored(kept.unionByName(split), "dedup-directory")
    return Index([*index.generations, merged.select(*ENTRY)], directory, index.key_bits, index.capacity), rows


def members(index: Index, rows: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of ``rows``."""
    entries = index.generations[0] if len(index.generations) == 1 else entries_of(index)
    repeated = entries.where(F.col("copies") > 1).select(*KEY, "copies", "keep_id", "keep_row")
    share = F.greatest(F.lit(1), F.ceil(rows.agg(F.count(F.lit(1))).scalar() / HOT)).cast("long")
    salts = F.ceil(F.col("copies") / share).cast("long")
    hot = F.broadcast(repeated.select(*KEY, salts.alias("_salts")).where(F.col("_salts") > 1))   # at most HOT texts
    spread = (rows.join(hot, KEY, "left")
              .withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("row"), F.col("_salts")))))
    replicated = repeated.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    alone = F.col("copies").isNull()
    return (spread.drop("_salts").join(replicated, [*KEY, "_salt"], "left")
            .select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.when(alone, F.lit(1).cast("long")).otherwise(F.col("copies")).alias("group_size"),
                    (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def digest(docs: DataFrame) -> DataFrame:
    """Contract columns of the query."""
    return members(*build(docs))


def keep_one(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of the rows that stay."""
    return digest(docs).where("kept").select("doc_id", "text_sha256")


ORACLE = """
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS x FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY x ORDER BY doc_id NULLS LAST, r) = 1 AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""
