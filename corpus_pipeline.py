"""The corpus pipeline: documents in, token ids out.

Each stage calls one operator of ``cohortlens.llm``, takes (spark, docs,
sf_dir) and returns a DataFrame; ``run`` writes what a stage returns as
Parquet in the shared folder and hands the reread table to the next.  All
stages but the last return the columns of ``documents`` (and any others that
came in).  A null text passes the filters as an empty one and stays null.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.llm import bagminhash, byte_bpe, decontam, linededup, nbsvm
from cohortlens.llm.common import DOCS_PER_TASK, fitted, stored, table, unused
from cohortlens.llm.queries import BYTE_RANKS

#: A document goes only where the classifier holds junk for likelier than not.
REJECT_BELOW = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents the quality classifier rejects go."""
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    score, kept = unused(docs.columns, "_quality_score"), unused(docs.columns, "_quality_kept")
    scored = nbsvm.score(docs, model, REJECT_BELOW, score, kept)
    return scored.where(F.col(kept) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: repeated lines go; n_chars follows the kept text."""
    names = tuple(unused(docs.columns, c) for c in ("_n_lines", "_n_dropped", "_kept"))
    found = linededup.keep_lines(linededup.build(docs), docs, names=names)
    hit, kept = F.col(names[1]) > 0, F.col(names[2])
    changes = {"text": F.when(hit, kept).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(hit, F.char_length(kept).cast("long")) \
            .otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    found = found.select(*[changes[c].alias(c) if c in changes else F.col(f"`{c}`") for c in docs.columns])
    return fitted(found, docs.count(), DOCS_PER_TASK)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group of near-duplicates stays."""
    return bagminhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents in which a window of a benchmark item occurs go."""
    return fitted(decontam.clean(docs, table(spark, sf_dir, "benchmark")), docs.count(), DOCS_PER_TASK)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids of each kept text, decoded again to check them."""
    return byte_bpe.digest(docs, BYTE_RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encode),
]

#: SQL cannot express the classifier, MinHash or BPE stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
