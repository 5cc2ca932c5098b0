"""Operator 1: token ids as ORC files.

Texts are encoded whole; each document's ids end with an end id.  Documents
lie in ascending id order over all files: rows are dealt out by ranges of
(id, text hash), sorted, encoded and written.  ORC stores the ids as integer
runs, with row indexes every ``ROW_INDEX`` rows and Bloom filters on doc_id, in
stripes that readers take in parallel; a search for ids prunes files, stripes
and row groups by these (``find``).

``place`` grows with the order over all files, so the start of a document (ids
before it) needs only the sum of each partition and a running sum inside it.

The encoder remembers the ids of white-space separated chunks, which the
tokenizer treats one by one; the tokenizers library encodes what is new.  The
memory is two Arrow arrays, so no chunk that is known becomes a Python object.
As the library does by default, a special token's string in a text is that token.

Defined results: a null or empty text has the end id alone.  Equal ids are
ordered by their text; repeated rows lie beside each other.  Null ids come
first.  An empty table gives an empty one.  Only the named columns are read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortlens.llm.arrays import text_bytes
from cohortlens.llm.common import python_workers, scratch_path

END_ID = 2
REMEMBERED_CHUNKS = 450_000   # per Python worker, the ones used last
REMEMBERED_BYTES = 100        # longer chunks are not remembered
JOINED_WORDS = 200
ENCODE_ROWS = 1024            # of a batch from Spark
ENCODE_BYTES = 16 << 20       # of the batches encoded together: more texts share more chunks
ROW_INDEX = 1000
ORC = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": str(ROW_INDEX),
    "orc.stripe.size": str(64 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
PART_BITS = 33   # of monotonically_increasing_id


class ChunkEncoder:
    """The tokenizer of a file, with a memory of white-space separated chunks.

    The vocabulary's normaliser turns white space into blanks, which no token
    of its split pattern contains, so chunks are independent of each other.
    Texts of Latin-1 characters are lower-cased first, as the normaliser would
    do: fewer different chunks are left.  Lower-casing, splitting, finding the
    different chunks and looking them up are Arrow operations; Python sees new
    chunks only."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark runs a task per core
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)       # strings of special tokens are these tokens, as the library has it
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = "(?i)" + "|".join(re.escape(t) for t in special) if special else None
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._known = pa.array([], pa.string())              # the chunks used last, first
        self._known_ids = pa.array([], pa.list_(pa.int32()))

    def chunks(self, texts: pa.Array) -> pa.ListArray:
        """White-space separated chunks (ASCII white space) of each text; one that
        holds a special token's string, in any case, is not lower-cased."""
        raw, ends = text_bytes(texts)
        begin = ends - np.diff(ends, prepend=0)
        beyond = np.flatnonzero(raw > 0xC3)   # first bytes of characters beyond Latin-1
        latin = pa.array(np.searchsorted(beyond, ends) == np.searchsorted(beyond, begin))
        texts = texts.cast(pa.string()).fill_null("")
        # marks after a word (no apostrophe) are matches of their own: apart, both are met more often
        lowered = pc.replace_substring_regex(pc.utf8_lower(texts), r"(\pL)([^\s\pL\pN']+)(\s|$)", r"\1 \2\3")
        if self.special:
            latin = pc.and_(latin, pc.invert(pc.match_substring_regex(texts, self.special)))
        return pc.ascii_split_whitespace(pc.if_else(latin, lowered, texts))

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and the ends of each text in them."""
        found = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return np.concatenate([np.empty(0, np.int32), *found]), ends

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Like ``_coded``, for words of Latin-1 letters: each is one match of the
        split pattern, so its last token, and no other, ends a word."""
        starts = range(0, len(words), JOINED_WORDS)
        ids, ends = self._coded([" ".join(words[i:i + JOINED_WORDS]) for i in starts])
        cuts = np.flatnonzero(self.ends_word[ids]) + 1
        counts = np.searchsorted(cuts, ends, side="right")   # words up to the end of each group
        if counts.tolist() != [min(i + JOINED_WORDS, len(words)) for i in starts]:
            raise ValueError("the tokenizer's words are not those of its split pattern")
        return ids, cuts

    def _new_ids(self, chunks: pa.StringArray) -> pa.ListArray:
        """Ids of each of ``chunks``, from the tokenizers library."""
        is_word = pc.match_substring_regex(chunks, "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$")
        words, word_ends = self._word_ids(chunks.filter(is_word).to_pylist())
        others, other_ends = self._coded(chunks.filter(pc.invert(is_word)).to_pylist())
        pieces = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], word_ends, len(words) + other_ends]).astype(np.int32)),
            pa.array(np.concatenate([words, others])))
        is_word = is_word.to_numpy(zero_copy_only=False)
        place = np.where(is_word, np.cumsum(is_word), len(word_ends) + np.cumsum(~is_word)) - 1
        return pieces.take(pa.array(place))

    def _look_up(self, chunks: pa.StringArray) -> tuple[np.ndarray, pa.ListArray]:
        """The ids of the different chunks, and which of them each chunk has."""
        coded = chunks.dictionary_encode()
        different = coded.dictionary
        at = pc.index_in(different, value_set=self._known)
        is_new = at.is_null()
        added = self._new_ids(different.filter(is_new))
        is_new = is_new.to_numpy(zero_copy_only=False)
        at = at.fill_null(0).to_numpy()
        place = np.where(is_new, len(self._known) + np.cumsum(is_new) - 1, at)
        pieces = pa.concat_arrays([self._known_ids, added]).take(pa.array(place))

        idle = np.ones(len(self._known), bool)
        idle[at[~is_new]] = False
        short = pc.less_equal(pc.binary_length(different), REMEMBERED_BYTES)
        self._known = pa.concat_arrays([different.filter(short), self._known.filter(idle)])
        self._known_ids = pa.concat_arrays([pieces.filter(short), self._known_ids.filter(idle)])
        if len(self._known) > REMEMBERED_CHUNKS:   # a copy: a slice would keep the rest in memory
            kept = pa.array(np.arange(REMEMBERED_CHUNKS))
            self._known, self._known_ids = self._known.take(kept), self._known_ids.take(kept)
        return coded.indices.to_numpy(zero_copy_only=False), pieces

    def encode(self, texts: pa.Array, end_id: int) -> pa.ListArray:
        """Ids of each text, and the end id."""
        split = self.chunks(texts)
        edges = split.offsets.to_numpy().astype(np.int64)
        which, pieces = self._look_up(split.flatten())
        which = np.insert(which, edges[1:] - edges[0], len(pieces))
        pieces = pa.concat_arrays([pieces, pa.array([[end_id]], pieces.type)])
        size = np.diff(pieces.offsets.to_numpy())
        ids = pieces.take(pa.array(which)).flatten()
        last = edges[1:] - edges[0] + np.arange(len(texts))   # where the end ids stand among the pieces
        ends = np.concatenate([[0], np.cumsum(size[which])[last]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    """One encoder, with its memory, per Python worker."""
    return ChunkEncoder(path)


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches of ``size`` bytes or a little more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids) of (doc_id, text), rows in the order they come."""
    python_workers(docs.sparkSession, ENCODE_ROWS)

    def run(batches):
        coder = encoder(tokenizer_path)
        for batch in gathered(batches, ENCODE_BYTES):
            ids = coder.encode(batch.column(1), end_id)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int64)), ids],
                names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids array<int>")


def write(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = END_ID) -> None:
    """Write the ids of ``docs`` as ORC to ``path``: place, doc_id, n_tokens, ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_text"),
                       F.monotonically_increasing_id().alias("_row"))   # spreads repeated rows, too
    dealt = rows.repartitionByRange("doc_id", "_text", "_row").sortWithinPartitions("doc_id", "_text", "_row")
    (encode(dealt, tokenizer_path, end_id)
     .select(F.monotonically_increasing_id().alias("place"), "doc_id", "n_tokens", "ids")
     .write.options(**ORC).orc(path))


SCHEMA = "place bigint, doc_id bigint, n_tokens bigint, ids array<int>"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Documents by id: the filter reaches ORC's statistics and Bloom filters."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def with_starts(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``rows`` (place, n_tokens, ...) of the files with start: the ids of all
    documents before.  The window over all partitions sees one row of each."""
    part = F.shiftright("place", PART_BITS)
    sums = tokens.select(part.alias("_part"), "n_tokens").groupBy("_part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("_part", part).withColumn(
        "_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return (running.join(offsets, "_part").withColumn("start", F.col("_offset") + F.col("_inside"))
            .drop("_part", "_inside", "_offset"))


def digest(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Contract columns of the query, from the files."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token-ids") + ".orc"
    write(docs, tokenizer_path, path)
    tokens = read(spark, path)

    def check(batches):
        for batch in batches:
            ids = batch.column(2)
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            edges = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(edges).astype(np.int64)), pa.array(crc, pa.int64())],
                names=["place", "doc_id", "n_tokens", "ids_crc32"])

    python_workers(spark)
    rows = tokens.select("place", "doc_id", "ids").mapInArrow(
        check, "place bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    return with_starts(rows, tokens).select("doc_id", "start", "n_tokens", "ids_crc32")
