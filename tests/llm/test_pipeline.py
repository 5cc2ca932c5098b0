"""The pipeline: order of stages, what each keeps, edges, and independence of the rest."""
import hashlib
import pathlib

import pytest

import corpus_pipeline
from cohortlens.llm import bagminhash, decontam, linededup, nbsvm
from .conftest import clashing


def test_stages_on_the_driver_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.stored(stage(spark, before, sf), "test-stage")
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids and docs.count() == len(kept)
        if name != "byte-level BPE":
            assert docs.columns == columns
        if name == "quality classifier":
            model = nbsvm.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
            scored = {r.doc_id: r.score for r in nbsvm.score(before, model).collect()}
            assert kept == {d for d, s in scored.items() if s >= corpus_pipeline.REJECT_BELOW}
        elif name == "line dedup":
            assert kept == ids
            again = linededup.keep_lines(linededup.build(before), before).collect()
            assert {r.doc_id: r._kept for r in again} == {r.doc_id: r.text or "" for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text)
        elif name == "MinHash near-dedup":
            classes = bagminhash.classes(before).collect()
            assert kept == {r.class_id for r in classes}
        elif name == "benchmark decontamination":
            assert kept == {r.doc_id for r in decontam.digest(before, benchmark).where("not contaminated").collect()}
        else:
            assert kept == ids
            texts = {r.doc_id: r.text or "" for r in before.collect()}
            assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in docs.collect())


def test_edges(spark, docs_of, labels_of, items_of, tmp_path):
    good = "Plain words stand here in order, and this sentence goes on for a while."
    rows = [(1, good), (2, good), (3, None), (4, ""), (5, "one two three four five six seven eight nine ten"), (None, "no id"),
            (6, good + "\nunique tail of the sixth text"), (7, "x" * 60_000), (7, "x" * 60_000)]
    clashing(docs_of(rows)).write.parquet(str(tmp_path / "documents.parquet"))
    labels_of([(1, 1, 0), (2, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    items_of([(1, "one two three four five six seven eight nine ten")]).write.parquet(str(tmp_path / "benchmark.parquet"))
    first = corpus_pipeline.quality(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert {r.score for r in first.collect()} == {"x"}      # the table's own columns stay what they were
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    assert 5 not in ids and 1 in ids and 2 not in ids and ids.count(7) == 1 and None in ids


def test_empty_tables(spark, docs_of, labels_of, items_of, tmp_path):
    for name, df in (("documents", docs_of([])), ("labels", labels_of([])), ("benchmark", items_of([]))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_files_follow_the_rows_not_the_shuffles(spark, docs_of, items_of, tmp_path):
    """A session with many shuffle partitions doesn't make every small table many files."""
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "cohortlens-llm"
    most = 2 * spark.sparkContext.defaultParallelism
    tail = " ".join(f"word{k}" for k in range(60))
    rows = [(i, f"line number {i // 3} of them all\nstart {i // 2} here {tail if i % 2 else tail + ' more'}")
            for i in range(40 * most)]
    docs_of(rows).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    items_of([(i, f"item {i} has these ten words and {i} ends here now") for i in range(20 * most)]) \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    wanted = {"spark.sql.shuffle.partitions": str(5 * most), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in wanted}
    before = set(shared.glob("*")) if shared.exists() else set()
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        for name, stage in corpus_pipeline.STAGES[1:4]:
            docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "test-" + name.replace(" ", "-"))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    files = {p.name: len(list(p.glob("part-*"))) for p in set(shared.glob("*")) - before}
    assert {"near-nodes", "near-classes", "line-counts", "links", "decontam-windows"} <= {n.rsplit("-", 1)[0] for n in files}
    assert max(files.values()) <= most, files
    assert 0 < docs.count() <= len(rows)


def test_entry_registers_them():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert {f"op{n}" for n in (2, 6, 7, 9, 10, 11, 13)} == {x.split("_")[0] for x in entry.oracle_sql() if x.startswith("op")}


def test_nothing_else_imports_the_subpackage():
    import pathlib
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in (root / "cohortlens").rglob("*.py"):
        if "llm" not in path.parts:
            assert "cohortlens.llm" not in path.read_text(), path
