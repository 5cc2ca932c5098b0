"""Operator 6: near-duplicates by BagMinHash over word-shingle multisets.

Similarity is the weighted Jaccard similarity of the multisets of five-word
shingles of whole texts; documents are near-duplicates at 0.8 or more, and a
class is a connected component of that relation.

1. Texts with the same multiset (by a 128-bit hash) are one *node*, so copies
   cost one row each and nothing more.
2. A node's BagMinHash signature (``signatures``) has 125 slots, banded 25 x 5:
   two nodes of similarity 0.8 share no band with probability 5e-5.
3. Nodes that share a band form a bucket.  Buckets are never expanded into all
   pairs.  Two rounds look for links:
   a. every node with the smallest node of its bucket;
   b. in each bucket that still holds several classes, the pairs of different
      classes whose sketches (one byte per slot) agree in at least ``FLOOR`` of
      the slots, most alike first; a pair that a found link has joined by then
      is skipped, and so is one that an earlier band of the pair handles.
   Round (b) runs inside tasks, in blocks of ``BLOCK`` nodes: a bucket of any
   size is dealt out over as many tasks as it has pairs of blocks, and a block
   gives at most one link per node.
4. Verification is exact set arithmetic on the multisets: the k-th occurrence
   of a shingle is an element of its own, so size(A n B) / size(A u B) is the
   weighted similarity.  Elements are 32-bit hashes; chance agreement moves a
   similarity by less than 1e-5.

A link at exactly 0.8 is missed with a probability of 5e-5 (no common band; that
its sketches agree in less than FLOOR has 8e-8), and only where no chain of
other links joins the two classes.

Defined results: texts without words (null and empty ones too) have no
shingles; they are copies of each other only if the texts are equal, null
being equal to empty.  Texts of fewer than five words have one shingle.
Repeated rows and rows sharing an id are separate rows of the result.  The
class id is the smallest doc_id of the class (null if all ids are).  Empty
tables give empty results; only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm import common
from cohortlens.llm.common import DOCS_PER_TASK, fitted, stored
from cohortlens.llm.components import components
from cohortlens.llm.shingles import U, mix, multisets

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
FLOOR = 0.6
BLOCK = 512
ALL = (1 << 64) - 1
GAP, PLACE, LEVEL = U(0xD1B54A32D192ED03), U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25)
SEED = (U(0x6C62272E07BB0142), U(0x62B821756295C58D))
BAND_STEPS = np.array([3, 0x9E3779B1, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xC2B2AE3D27D4EB4F], U)


def signatures(row: np.ndarray, value: np.ndarray, times: np.ndarray, n_rows: int,
               slots: int = SLOTS) -> np.ndarray:
    """[n_rows, slots] point ids; a row without shingles has zeros."""
    """[n_rows, slots] point ids of the multisets given as (row, value, times);
    a row without values has zeros.

    Weight is discretised into the dyadic intervals [0,1), [1,2), [2,4), ...
    Each (value, interval) has a Poisson process of its own in time, at a rate
    of the interval's width; a point has a place inside the interval and counts
    only if that lies below the value's weight.  A slot keeps the first point
    that falls into it, so two multisets agree in a slot with the probability
    of their weighted Jaccard similarity.  Points are drawn in order of time
    and a process stops once it is later than every slot of its row.
    """
    at, ident, rate, low, weight = [], [], [], [], []
    level, width, start = 0, 1, 0
    index = np.arange(len(row))
    while len(index):
        at.append(row[index])
        ident.append(mix(value[index] + U(int(LEVEL) * (level + 1) & ALL)))
        rate.append(np.full(len(index), float(width)))
        low.append(np.full(len(index), float(start)))
        weight.append(times[index].astype(float))
        start += width
        width = start
        level += 1
        index = index[times[index] > start]
    best = np.full(n_rows * slots, np.inf)
    found = np.zeros(n_rows * slots, U)
    if not at:
        return found.reshape(n_rows, slots)
    at, ident, rate, low, weight = map(np.concatenate, (at, ident, rate, low, weight))
    time = np.zeros(len(at))
    step = 0
    while len(at):
        step += 1
        point = mix(ident + U(int(GAP) * step & ALL))
        time = time - np.log1p(-(point >> U(11)).astype(float) * 2.0 ** -53) / rate
        more = mix(point ^ PLACE)
        slot = at * slots + ((more >> U(32)) % U(slots)).astype(np.int64)
        inside = low + rate * ((more & U(0xFFFFFFFF)).astype(float) * 2.0 ** -32) < weight
        inside &= time < best[slot]
        where, when = slot[inside], time[inside]
        np.minimum.at(best, where, when)
        wins = when == best[where]
        found[where[wins]] = point[inside][wins]
        limit = best.reshape(n_rows, slots).max(axis=1)
        going = time < limit[at]
        if not going.all():
            at, ident, rate, low, weight, time = (x[going] for x in (at, ident, rate, low, weight, time))
    return found.reshape(n_rows, slots)


# --- per document ------------------------------------------------------------

def _node_ids(texts: pa.Array, row, value, times) -> list[bytes]:
    """128-bit hash of each multiset; of the text itself where it has no words."""
    n = len(texts)
    ids = np.zeros((n, 2), U)
    for k, seed in enumerate(SEED):
        np.add.at(ids[:, k], row, mix(mix(value ^ seed) + times.astype(U)))
    has = np.bincount(row, minlength=n) > 0
    raw = ids.tobytes()
    return [raw[16 * i:16 * i + 16] if has[i]
            else hashlib.md5(b"text:" + (texts[i].as_py() or "").encode()).digest() for i in range(n)]


def _profile(batches):
    """doc, text hash, text -> doc, text hash, multiset, bands, sketch."""
    for batch in batches:
        texts = batch.column(2)
        row, value, times = multisets(texts, SHINGLE)
        points = signatures(row, value, times, len(texts))
        offset = mix(np.arange(BANDS, dtype=U))
        bands = mix((points.reshape(-1, BANDS, ROWS) * BAND_STEPS).sum(axis=2, dtype=U) + offset)
        has = np.bincount(row, minlength=len(texts)) > 0
        ends = np.concatenate([[0], np.cumsum(has * BANDS)]).astype(np.int32)
        sketch = (points & U(255)).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(_node_ids(texts, row, value, times), pa.binary()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[has].ravel().view(np.int64))),
            pa.array([sketch[SLOTS * i:SLOTS * (i + 1)] for i in range(len(texts))], pa.binary()),
        ], names=["doc", "text_hash", "multiset", "bands", "sketch"])


def _elements(batches):
    """node, text -> node, elements of its multiset."""
    for batch in batches:
        row, value, times = multisets(batch.column(1), SHINGLE)
        copies = np.repeat(np.arange(len(row)), times)
        nth = np.arange(len(copies)) - np.repeat(np.cumsum(times) - times, times)
        marks = (mix(value[copies] + mix(nth.astype(U))) >> U(32)).astype(np.uint32).view(np.int32)
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[copies], minlength=batch.num_rows))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(marks))], names=["node", "elements"])


# --- inside a bucket -----------------------------------------------------------

ROW = ["bucket", "i", "j", "block", "band", "node", "leader", "comp", "bands", "sketch", "elements"]


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _links_between_classes(batches):
    """For runs of rows (ROW) of the same bucket and blocks i, j: verified
    links (a, b) between nodes of different classes, none of them implied by
    the others."""
    def links(rows):
        node, comp, band = rows["node"], rows["comp"], rows["band"][0]
        names, label = np.unique(np.array(comp), return_inverse=True)
        if len(names) == 1:
            return
        parent = list(range(len(names)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        sketch = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(node), SLOTS)
        bands = np.array(rows["bands"], np.int64)
        block = np.array(rows["block"])
        left, right = np.flatnonzero(block == rows["i"][0]), np.flatnonzero(block == rows["j"][0])
        same_block = rows["i"][0] == rows["j"][0]
        found = []
        for at in range(0, len(left), 64):
            some = left[at:at + 64]
            agree = (sketch[some][:, None, :] == sketch[right][None, :, :]).sum(axis=2)
            agree[label[some][:, None] == label[right][None, :]] = 0
            x, y = np.nonzero(agree >= FLOOR * SLOTS)
            x, y, agree = some[x], right[y], agree[x, y]
            once = (x < y) if same_block else slice(None)
            x, y, agree = x[once], y[once], agree[once]
            ours = (bands[x] == bands[y]).argmax(axis=1) == band
            found += zip((-agree[ours]).tolist(), x[ours].tolist(), y[ours].tolist())
        elements = {}
        for _, x, y in sorted(found):
            if root(label[x]) == root(label[y]) or rows["leader"][0] in (node[x], node[y]):
                continue    # joined by now, or compared in the first round
            for k in (x, y):
                if k not in elements:
                    elements[k] = rows["elements"][k].values.to_numpy()
            if _similar(elements[x], elements[y]):
                parent[root(label[x])] = root(label[y])
                yield node[x], node[y]

    group, held = None, {c: [] for c in ROW}
    out: list = []
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() if c != "elements" else list(batch.column(c)) for c in ROW}
        keys = list(zip(columns["bucket"], columns["i"], columns["j"]))
        edges = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        for begin, end in zip(edges, edges[1:]):
            if end > begin and keys[begin] != group:
                if held["node"]:
                    out += links(held)
                group, held = keys[begin], {c: [] for c in ROW}
            for c in ROW:
                held[c] += columns[c][begin:end]
        yield _pair_batch(out)
        out = []
    if held["node"]:
        out += links(held)
    yield _pair_batch(out)


def _pair_batch(found: list) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


# --- the operator ------------------------------------------------------------

def profiles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc, text_hash, multiset (its 128-bit hash), bands, sketch."""
    common.python_workers(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"),
                       F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(
        _profile, "doc bigint, text_hash bigint, multiset binary, bands array<bigint>, sketch binary")


def _alike(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sketches agree in FLOOR of the slots."""
    s, t = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("_s")), \
        sketches.select(F.col("node").alias("b"), F.col("sketch").alias("_t"))

    def compare(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SLOTS) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= FLOOR * SLOTS))

    return pairs.join(s, "a").join(t, "b").select("a", "b", "_s", "_t").mapInArrow(compare, "a bigint, b bigint")


def _verify(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """The pairs (a, b) whose multisets have SIMILARITY."""
    x, y = elements.alias("x"), elements.alias("y")
    both = F.size(F.array_intersect("x.elements", "y.elements"))
    total = F.size("x.elements") + F.size("y.elements")
    return (pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
            .where(both >= SIMILARITY * (total - both)).select("a", "b"))


def _members(nodes: DataFrame) -> DataFrame:
    """(bucket, band, node, leader, n) of every bucket of more than one node."""
    banded = nodes.select(F.posexplode("bands").alias("band", "bucket"), "node")
    buckets = (banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n"))
               .where(F.col("n") > 1))
    return banded.join(buckets, "bucket")


def _second_round(members: DataFrame, sketches: DataFrame, elements: DataFrame, comps: DataFrame) -> DataFrame:
    """Links between classes, bucket by bucket."""
    labelled = members.join(comps.withColumnRenamed("component", "_comp"), "node", "left") \
        .withColumn("comp", F.coalesce("_comp", "node")).drop("_comp")
    mixed = (labelled.groupBy("bucket").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"))
             .where(F.col("_lo") != F.col("_hi")).select("bucket"))
    rows = (labelled.join(mixed, "bucket").join(sketches, "node").join(elements, "node")
            .withColumn("_blocks", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int"))
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
            .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
            .withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other"))
            .select(*ROW))
    return (rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block", "node")
            .mapInArrow(_links_between_classes, "a bigint, b bigint").distinct())


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc, text_hash and its class (a node's number)."""
    rows = stored(profiles(docs, doc_id, text), "near-profiles")
    n_rows = rows.count()

    def kept(df: DataFrame, name: str) -> DataFrame:
        return stored(fitted(df, n_rows, DOCS_PER_TASK), name)

    first = rows.groupBy("multiset").agg(F.min_by(F.struct("doc", "text_hash", "bands", "sketch"), F.struct(
        F.col("doc").isNull(), "doc", "text_hash")).alias("_one"))
    nodes = kept(first.select("multiset", "_one.*", F.monotonically_increasing_id().alias("node")), "near-nodes")
    members = kept(_members(nodes), "near-members")
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi")
    sketches = kept(wanted.select("node", "bands", "sketch"), "near-sketches")
    common.python_workers(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).cast("long").alias("_d"), F.xxhash64(text).alias("_h"),
                        F.col(text).cast("string").alias("_text"))
    texts = (wanted.select("node", "doc", "text_hash")
             .join(keyed, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h")))
             .select("node", "_text"))
    elements = texts.mapInArrow(_elements, "node bigint, elements array<int>")
    if _any_repeated(rows):
        elements = elements.dropDuplicates(["node"])
    elements = kept(elements, "near-elements")
    star = _alike(members.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
                  .distinct(), sketches)
    comps = kept(components(kept(_verify(star, elements), "near-links")), "near-classes")
    found = _second_round(members, sketches, elements, comps)
    links = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)
    comps = kept(components(kept(links, "near-links")), "near-classes")
    numbers = nodes.select("multiset", "node").join(comps, "node", "left") \
        .select("multiset", F.coalesce("component", "node").alias("class"))
    return fitted(rows.select("doc", "text_hash", "multiset").join(numbers, "multiset").drop("multiset"),
                  n_rows, DOCS_PER_TASK)


def _any_repeated(rows: DataFrame) -> bool:
    return not rows.groupBy("doc", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, class_id (smallest id of its class) and
    class_size (rows of the class)."""
    rows = stored(near_classes(docs, doc_id, text), "near-rows")
    sizes = rows.groupBy("class").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(sizes, "class").select(F.col("doc").alias(doc_id), "class_id", "class_size")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, the one of smallest id; columns unchanged."""
    rows = stored(near_classes(docs, doc_id, text), "near-rows")
    first = rows.groupBy("class").agg(F.min(F.struct(
        F.col("doc").isNull().alias("no_id"), "doc", "text_hash")).alias("_first"))
    doc, hashed = common.unused(docs.columns, "_kept_doc"), common.unused(docs.columns, "_kept_text")
    keys = first.select(F.col("_first.doc").alias(doc), F.col("_first.text_hash").alias(hashed))
    kept = docs.join(keys, docs[doc_id].eqNullSafe(keys[doc]) & (F.xxhash64(docs[text]) == keys[hashed]), "left_semi")
    kept = kept.dropDuplicates([doc_id, text]) if _any_repeated(rows) else kept
    return fitted(kept, rows.count(), DOCS_PER_TASK)


#: DuckDB SQL for ``classes``' rows, for tables small enough to compare every
#: two texts that share a shingle.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
cut AS (
  SELECT r, unnest(CASE WHEN len(ws) = 0 THEN [chr(1) || t]
                        WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM d),
sets AS (SELECT r, s, count(*) AS n FROM cut GROUP BY r, s),
sizes AS (SELECT r, sum(n) AS n FROM sets GROUP BY r),
shared AS (
  SELECT a.r AS x, b.r AS y, sum(least(a.n, b.n)) AS alike FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE alike >= 0.8 * (a.n + b.n - alike)),
either AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT r, r AS q FROM d UNION SELECT reach.r, y FROM reach JOIN either ON x = q),
classes AS (SELECT r, min(q) AS class FROM reach GROUP BY r),
sized AS (SELECT class, min(doc_id) AS class_id, count(*) AS class_size FROM classes JOIN d USING (r) GROUP BY class)
SELECT d.doc_id, class_id, class_size FROM d JOIN classes USING (r) JOIN sized USING (class)
"""
