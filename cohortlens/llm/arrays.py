"""Views of Arrow text columns as byte arrays, and small sampling helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after another, end of each); null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets[1:] - offsets[0]


def parts(texts: pa.Array, rows: int):
    """``texts`` in slices of ``rows``."""
    for at in range(0, len(texts), rows):
        yield texts.slice(at, rows)


def slices(batch: pa.RecordBatch, column: int, most: int):
    """``batch`` in parts of at most ``most`` bytes of the text ``column``, a longer
    text alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto = np.cumsum(size.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def first_occurrences(cells: np.ndarray, size: int, stamp: np.ndarray | None = None) -> np.ndarray:
    """Mask of one occurrence of each distinct value of ``cells`` (all < size)."""
    stamp = np.empty(size, np.int32) if stamp is None else stamp
    order = np.arange(len(cells), dtype=np.int32)
    stamp[cells] = order
    return stamp[cells] == order


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, modulus: int,
                    held_out: int) -> DataFrame:
    """(doc_id, text, y): at most ``rows`` labelled rows, by hash of the id,
    of those whose crc32 remainder is not ``held_out``.  The ids are broadcast:
    their number is bounded by ``rows``."""
    from cohortlens.llm.common import id_remainder
    chosen = (labels.where(F.col(label).isin(0, 1) & (id_remainder(F.col("doc_id"), modulus) != held_out))
              .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).distinct()
              .orderBy(F.xxhash64("_id"), "_id", "y").limit(rows))
    return (docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
            .select("doc_id", "text", "y"))
