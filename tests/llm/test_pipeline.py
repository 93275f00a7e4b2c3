"""The pipeline's stages in their order, and its queries' registration."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import PROSE, documents


def test_stages_and_queries_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near copies", "secrets", "mixing", "packing"]
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    prose = [PROSE + f"and here is the part number {k} of the whole of it with words w{k} x{k} y{k} z{k} " + " ".join(f"t{k}_{j}" for j in range(30)) for k in range(30)]
    rows = [(k, t, "en", "s") for k, t in enumerate(prose)]
    rows += [(100, prose[0], "en", "s"), (101, prose[1].upper(), "en", "s"), (102, "too short", "en", "s"), (103, prose[3].replace("w3", "token=abcdefghijklmnop") + " ".join(f"q{j}" for j in range(40)), "en", "s")]
    documents(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_decisions_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, tables)
        assert docs.columns == before.columns, name
        docs = docs.cache()
    ids = {r["doc_id"] for r in docs.collect()}
    assert ids == {*range(30), 103} or ids == {*range(30)} - {1} | {1, 103}
    assert "[SECRET]" in docs.where("doc_id = 103").first()["text"]


def test_run_packs_what_is_left(spark, tables):
    rows = corpus_pipeline.run(spark, tables)
    whole = rows.groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).where("n % doc_tokens <> 0")
    assert whole.count() == 0 and rows.where("doc_id in (100, 102)").count() == 0


def test_stages_take_odd_rows(spark, tables, tmp_path):
    """Null ids and texts, repeated rows, an id with several texts, an empty table."""
    good = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id < 20")
    first = good.where("doc_id = 0").first()["text"]
    odd = documents(spark, [(None, None, None, None), (None, first, "en", "s"), (3, first, "en", "s"), (3, first, "en", "s"), (50, "", "en", "s"), (51, " \n", None, "s")])
    for name, docs in (("odd", good.select(odd.columns).union(odd)), ("empty", odd.limit(0))):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(k, 1, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        rows = corpus_pipeline.run(spark, d)
        ids = {r["doc_id"] for r in rows.select("doc_id").distinct().collect()}
        assert ids == (set(range(20)) if name == "odd" else set())
