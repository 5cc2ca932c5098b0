"""Operator 11: Merkle manifest of a data set, kept as postorder append logs.

A tree's leaves stand in a fixed order; every two consecutive nodes of a level
become their parent, a last one alone becomes its own parent, until one node
remains.  Each language is a tree; the languages' roots, in order, are the
leaves of the top tree.

Leaves are dealt to *aligned builders*: a builder has the 2^``bits`` leaves
whose ranks agree but for the last ``bits`` bits, so a node of up to ``bits``
levels never needs leaves of two builders.  It appends each node to its log the
moment the node is complete, which is postorder.  A log is one row of a stored
table.  The builders' roots are the leaves of the next round, 2^``bits`` times
fewer; a tree of 10^11 documents takes four rounds of 4,096.

Nothing is looked up to find a node in a log.  A complete node of level k that
ends with leaf i lies behind the 2 i - popcount(i) nodes that were complete
before that leaf, the leaf, and k - 1 smaller ones; the nodes at the ragged
right edge follow all complete ones, lowest first (``position``).  A proof is
read off by addressing the siblings: in the document's own log, then in the
logs of the rounds above, whose part of the proof all leaves of a builder share.

Scale: texts are hashed where they are read and never shuffled.  Ranks come
from a range-partitioned sort and a window over one row per partition and tree,
so a language with all rows is spread like any other.  A task holds one
builder's leaves at a time.  Every round is a table in the shared folder, so a
lost executor costs the running round only.

Defined results: a null field is ``-``, an empty one ``0:``.  A null language
is a tree of its own, before all others; a null doc_id stands before all
others of its tree and is never tampered with.  Equal ids stand in the order
of their leaves; repeated rows beside each other.  An empty table gives an
empty result.  Whole texts are hashed.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortlens.llm.common import python_workers, stored

BITS = 12
PART_BITS = 33    # of monotonically_increasing_id
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64          # a digest in the logs and proofs is its hex text
TAMPER_MODULUS = 7


# --- one tree, one log ---------------------------------------------------------

def digest_of(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return (n - 1).bit_length() if n > 0 else 0


def position(level: int, index: int, leaves: int) -> int:
    """Where node ``index`` of ``level`` stands in the postorder log of a tree."""
    if (index + 1) << level <= leaves:
        last = ((index + 1) << level) - 1
        return 2 * last - last.bit_count() + level
    smallest = (leaves & -leaves).bit_length() - 1   # levels up to it have no ragged node
    return 2 * leaves - leaves.bit_count() + level - smallest - 1


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """The nodes of a tree over ``leaves``, ``levels`` high, as they get complete."""
    log, pending = [], []
    for i, node in enumerate(leaves):
        log.append(node)
        level = 0
        while level < levels and (i >> level) & 1:
            node = digest_of(pending.pop(), node)
            log.append(node)
            level += 1
        pending.append(node)
    edge = None                                       # the ragged node of the level
    for level in range(levels):
        if (len(leaves) >> level) & 1:
            edge = digest_of(pending.pop(), edge or b"")
        elif edge is not None:
            edge = digest_of(edge)
        else:
            continue
        log.append(edge)
    return log


def siblings(log: bytes, rank: int, leaves: int, levels: int) -> bytes:
    """Siblings on leaf ``rank``'s way up, from the log."""
    out = []
    for level in range(levels):
        sibling = (rank >> level) ^ 1
        if sibling <= (leaves - 1) >> level:
            at = HEX * position(level, sibling, leaves)
            out.append(log[at:at + HEX])
    return b"".join(out)


def fold(leaf: bytes, rank: int, leaves: int, proof: bytes, at: int = 0) -> tuple[bytes, int]:
    """(the root that ``leaf`` and its siblings give, end of what was read of ``proof``)."""
    last = leaves - 1
    while last:
        if rank & 1:
            leaf = digest_of(proof[at:at + HEX], leaf)
            at += HEX
        elif rank < last:
            leaf = digest_of(leaf, proof[at:at + HEX])
            at += HEX
        else:
            leaf = digest_of(leaf)
        rank, last = rank >> 1, last >> 1
    return leaf, at


# --- forests on Spark ------------------------------------------------------------

def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(n_chars: Column) -> Column:
    return F.sha2(F.concat(*[_field(n_chars if f == "n_chars" else F.col(f)) for f in FIELDS]), 256)


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (tree, ...) with ``rank`` from 0 in its tree, by ``order``, and the
    tree's leaves ``n``.  Rows equal in ``order`` are ranked one after another."""
    key = ["tree", *order, "_row"]
    dealt = (rows.withColumn("_row", F.monotonically_increasing_id())
             .repartitionByRange(*key).sortWithinPartitions(*key).drop("_row")
             .withColumn("_place", F.monotonically_increasing_id()))
    dealt = stored(dealt, name).withColumn("_part", F.shiftright("_place", PART_BITS))
    runs = dealt.groupBy("tree", "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
                       F.sum("_n").over(tree).alias("n"))
    return (dealt.join(runs, ["tree", "_part"])
            .withColumn("rank", F.col("_start") + F.col("_place") - F.col("_first"))
            .drop("_part", "_place", "_first", "_start"))


def grow(leaves: DataFrame, bits: int, name: str) -> list[DataFrame]:
    """The logs over ``leaves`` (tree, rank, n, hash), a stored table per round:
    tree, block, n (leaves of the round in the tree), leaves (of the block), log, root."""
    size = 1 << bits
    python_workers(leaves.sparkSession)

    def builder(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("rank").to_numpy())
        hashes = [h.encode() for h in rows.column("hash").take(pa.array(order)).to_pylist()]
        n = rows.column("n")[0].as_py()
        log = append_log(hashes, bits if n > size else height(n))
        return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()),
                         "n": pa.array([n], pa.int64()), "leaves": pa.array([len(hashes)], pa.int32()),
                         "log": pa.array([b"".join(log)], pa.binary()), "root": pa.array([log[-1].decode()])})

    rounds, rows = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        logs = (rows.select("tree", F.shiftright("rank", bits).alias("block"), "rank", "n", "hash")
                .groupBy("tree", "block")
                .applyInArrow(builder, "tree string, block bigint, n bigint, leaves int, log binary, root string"))
        rounds.append(stored(logs, f"{name}-round-{len(rounds)}"))
        if most <= size:
            return rounds
        most = (most + size - 1) >> bits
        rows = rounds[-1].where(F.col("n") > size).select(
            "tree", F.col("block").alias("rank"), F.shiftright(F.col("n") + (size - 1), bits).alias("n"),
            F.col("root").alias("hash"))


def roots(rounds: list[DataFrame], bits: int) -> DataFrame:
    """(tree, root) of every tree."""
    out = None
    for logs in rounds:
        done = logs.where(F.col("n") <= 1 << bits).select("tree", "root")
        out = done if out is None else out.unionByName(done)
    return out


def _levels(n: int, leaves: int, bits: int) -> int:
    return bits if n > 1 << bits else height(leaves)


def _spread(logs: DataFrame, carried: list[str], bits: int) -> DataFrame:
    """(tree, block, path, carried) of the leaves of ``logs``, which are the
    blocks of the round below."""
    given = ["tree", "block", "n", "leaves", "log", "path", *carried]
    types = dict(logs.dtypes)
    python_workers(logs.sparkSession)
    schema = ", ".join(["tree string, block bigint, path string", *[f"{c} {types[c]}" for c in carried]])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):      # a log is large: one at a time
                row = batch.slice(at, 1).to_pylist()[0]
                count, levels = row["leaves"], _levels(row["n"], row["leaves"], bits)
                paths = [(siblings(row["log"], r, count, levels).decode() + row["path"]) for r in range(count)]
                first = row["block"] << bits
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * count, pa.string()), pa.array(np.arange(first, first + count)), pa.array(paths),
                     *[pa.array([row[c]] * count) for c in carried]], names=["tree", "block", "path", *carried])

    return logs.select(*given).mapInArrow(run, schema)


def block_paths(rounds: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """(tree, block, path, ...) of the first round's blocks: the siblings from a
    block's root up, and ``above`` (tree, path, ...): what continues each tree."""
    carried = [c for c in above.columns if c not in ("tree", "path")]
    paths = None
    for logs in reversed(rounds):
        tops = (logs.where(F.col("n") <= 1 << bits).select("tree", "block").join(above, "tree")
                .select("tree", "block", "path", *carried))
        here = tops if paths is None else paths.unionByName(tops)
        if logs is rounds[0]:
            return here
        paths = _spread(logs.drop("root").join(here, ["tree", "block"]), carried, bits)


# --- the manifest -----------------------------------------------------------------

@dataclass
class Manifest:
    """``rows``: tree, rank, n, doc_id, leaf, claimed.  ``rounds``: the languages'
    logs; ``top``: the languages as leaves of the top tree; ``top_rounds``: its logs."""
    rows: DataFrame
    rounds: list[DataFrame]
    top: DataFrame
    top_rounds: list[DataFrame]
    bits: int


def build(docs: DataFrame, claimed: Column | None = None, bits: int = BITS) -> Manifest:
    """Manifest of ``docs``; ``claimed``: a leaf to be verified in a document's
    place (null or not given: its own)."""
    leaf = leaf_of(F.col("n_chars"))
    tree = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("lang")))   # "-" < "="
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"),
                       (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"))
    rows = ranked(stored(rows, "merkle-leaves"), ["doc_id", "leaf"], "merkle-ranked")
    rounds = grow(rows.withColumn("hash", F.col("leaf")), bits, "merkle-log")
    top = roots(rounds, bits).select(F.lit("").alias("tree"), F.col("tree").alias("member"), F.col("root").alias("hash"))
    top = ranked(top, ["member"], "merkle-top")
    return Manifest(rows, rounds, top, grow(top, bits, "merkle-top-log"), bits)


def proofs(manifest: Manifest) -> DataFrame:
    """Per row of the manifest: doc_id, leaf, subroot, root, proof (the siblings'
    digests up to the root, one after another) and folded_root, the root that the
    claimed leaf and the proof give."""
    bits = manifest.bits
    root = roots(manifest.top_rounds, bits).select("tree", F.lit("").alias("path"), "root")
    tops = block_paths(manifest.top_rounds, root, bits)
    members = _spread(manifest.top_rounds[0].drop("root").join(tops, ["tree", "block"]), ["root"], bits)
    above = (manifest.top.join(members.withColumnRenamed("block", "rank").drop("tree"), "rank")
             .select(F.col("member").alias("tree"), "path", F.col("hash").alias("subroot"), "root",
                     F.col("rank").alias("top_rank"), F.col("n").alias("top_n")))
    paths = stored(block_paths(manifest.rounds, above, bits), "merkle-paths")
    logs = manifest.rounds[0].drop("root", "n").join(paths, ["tree", "block"])
    rows = manifest.rows.withColumn("block", F.shiftright("rank", bits))

    def prove(docs: pa.Table, log: pa.Table) -> pa.Table:
        out = {"doc_id": docs.column("doc_id"), "leaf": docs.column("leaf")}
        found, folded = [], []
        if docs.num_rows:
            own = log.to_pylist()[0]
            n, upper = docs.column("n")[0].as_py(), own["path"].encode()
            levels = _levels(n, own["leaves"], bits)
            for rank, leaf, claim in zip(docs.column("rank").to_pylist(), docs.column("leaf").to_pylist(),
                                         docs.column("claimed").to_pylist()):
                proof = siblings(own["log"], rank & ((1 << bits) - 1), own["leaves"], levels) + upper
                subroot, at = fold((claim or leaf).encode(), rank, n, proof)
                found.append(proof.decode())
                folded.append(fold(subroot, own["top_rank"], own["top_n"], proof, at)[0].decode())
            out |= {c: pa.array([own[c]] * docs.num_rows, pa.string()) for c in ("subroot", "root")}
        else:
            out |= {c: pa.array([], pa.string()) for c in ("subroot", "root")}
        return pa.table(out | {"proof": pa.array(found, pa.string()), "folded_root": pa.array(folded, pa.string())})

    python_workers(rows.sparkSession)
    return (rows.select("tree", "block", "rank", "n", "doc_id", "leaf", "claimed").groupBy("tree", "block")
            .cogroup(logs.groupBy("tree", "block"))
            .applyInArrow(prove, "doc_id bigint, leaf string, subroot string, root string, proof string, folded_root string"))


def tampered() -> Column:
    """The leaf of a document whose id's crc32 7 divides, with n_chars one more."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % TAMPER_MODULUS == 0
    return F.when(hit & F.col("n_chars").isNotNull(), leaf_of((F.col("n_chars").cast("decimal(20,0)") + 1)))


def digest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Contract columns of the query."""
    return proofs(build(docs, tampered(), bits)).select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


#: DuckDB SQL for ``digest``'s rows: levels by recursion, siblings by their index,
#: crc32 bit by bit.
ORACLE = """
WITH RECURSIVE fields AS (
  SELECT row_number() OVER () AS r, doc_id, lang, CAST(doc_id AS VARCHAR) AS i, source AS s, n_chars,
         CAST(n_chars AS VARCHAR) AS c, CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR) AS c1, text AS t
  FROM documents),
parts AS (
  SELECT r, doc_id, lang,
         coalesce(strlen(i) || ':' || i, '-') || coalesce(strlen(s) || ':' || s, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(c) || ':' || c, '-') AS own, coalesce(strlen(c1) || ':' || c1, '-') AS more,
         coalesce(strlen(t) || ':' || t, '-') AS tail,
         i IS NOT NULL AND xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT),
             list_transform(range(1, length(i) + 1), lambda p: CAST(ascii(substr(i, CAST(p AS INT), 1)) AS BIGINT))),
           lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
             lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END)))) % 7 = 0 AS hit
  FROM fields),
leaves AS (
  SELECT r, doc_id, lang, sha256(head || own || tail) AS leaf,
         CASE WHEN hit THEN sha256(head || more || tail) ELSE sha256(head || own || tail) END AS claim FROM parts),
ranked AS (
  SELECT *, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS rnk,
         count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
  SELECT tree, 0 AS lvl, rnk AS idx, n, leaf AS h FROM ranked
  UNION ALL
  SELECT tree, lvl + 1, idx // 2, n, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes
  WHERE ((n - 1) >> lvl) > 0 GROUP BY tree, lvl, idx // 2, n),
subroots AS (SELECT tree, h AS subroot FROM nodes WHERE ((n - 1) >> lvl) = 0),
top AS (
  SELECT 0 AS lvl, tree - 1 AS idx, (SELECT count(*) FROM subroots) AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, n, sha256(string_agg(h, '' ORDER BY idx)) FROM top
  WHERE ((n - 1) >> lvl) > 0 GROUP BY lvl, idx // 2, n),
root AS (SELECT h AS root FROM top WHERE ((n - 1) >> lvl) = 0),
steps AS (
  SELECT q.r, s.lvl, q.rnk >> s.lvl AS idx, s.h FROM ranked q JOIN nodes s ON s.tree = q.tree AND s.idx = xor(q.rnk >> s.lvl, 1)
  UNION ALL
  SELECT q.r, 100 + s.lvl, (q.tree - 1) >> s.lvl, s.h FROM ranked q JOIN top s ON s.idx = xor((q.tree - 1) >> s.lvl, 1)),
proofs AS (SELECT r, string_agg(h, '' ORDER BY lvl) AS proof FROM steps GROUP BY r),
folded AS (
  SELECT r, 0 AS lvl, tree, rnk AS idx, n - 1 AS last, claim AS h FROM ranked
  UNION ALL
  SELECT f.r, CASE WHEN f.last > 0 THEN f.lvl + 1 ELSE 100 END, f.tree,
         CASE WHEN f.last > 0 THEN f.idx >> 1 ELSE f.tree - 1 END,
         CASE WHEN f.last > 0 THEN f.last >> 1 ELSE (SELECT max(n) - 1 FROM top) END,
         CASE WHEN f.last = 0 THEN f.h WHEN s.h IS NULL THEN sha256(f.h)
              WHEN f.idx & 1 = 1 THEN sha256(s.h || f.h) ELSE sha256(f.h || s.h) END
  FROM folded f LEFT JOIN steps s ON s.r = f.r AND s.lvl = f.lvl AND f.last > 0
  WHERE f.last > 0 OR f.lvl < 100)
SELECT q.doc_id, q.leaf, u.subroot, root.root, sha256(coalesce(p.proof, '')) AS proof_sha256,
       f.h AS folded_root, f.h = root.root AS verified
FROM ranked q JOIN subroots u ON u.tree = q.tree CROSS JOIN root
LEFT JOIN proofs p ON p.r = q.r JOIN folded f ON f.r = q.r AND f.lvl >= 100 AND f.last = 0
"""
