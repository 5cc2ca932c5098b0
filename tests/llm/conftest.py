from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()),
                       T.StructField("toxic", T.IntegerType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, lang)."""
        return spark.createDataFrame(
            [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1]) if r[1] else 0) for r in rows], DOCS)
    return make


@pytest.fixture(scope="session")
def labels_of(spark):
    return lambda rows: spark.createDataFrame(rows, LABELS)


@pytest.fixture(scope="session")
def items_of(spark):
    return lambda rows: spark.createDataFrame(rows, ITEMS)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def clashing(df):
    """``df`` with extra columns named like results and inner columns: all names
    that the operators' modules give columns by ``alias`` or the like."""
    from pyspark.sql import functions as F
    taken = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("x").alias(name) for name in inner_names() if name.lower() not in taken])


def inner_names():
    import pathlib
    import re

    import cohortlens.llm
    found = {"score", "rank", "ids", "node", "class", "key", "predicted", "n_hit", "start", "bucket", "value", "dropped",
             "_doc", "_text", "_kept", "_n_dropped", "_n_lines", "_dirty_doc", "_dirty_text", "_kept_doc", "_kept_text",
             "_quality_score", "_quality_kept", "_whole"}
    for module in pathlib.Path(cohortlens.llm.__file__).parent.glob("*.py"):
        text = module.read_text()
        found |= set(re.findall(r'(?:alias|withColumn|withColumnRenamed)\("(\w+)"', text))
        found |= set(re.findall(r'"(_\w+)"', text))
    small, out = set(), []
    for name in sorted(found):
        if name.lower() not in small:
            small.add(name.lower())
            out.append(name)
    return out
