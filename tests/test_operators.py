"""Aggregates, searches, fusion and indexes on small tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vexel.config import SearchConfig
from vexel.index import Index, IndexConflictError, IndexFormatError, IndexSpec, build_index
from vexel.operators import aggregates, hybrid, search
from vexel.plans import register
from vexel.sources import read_text_vectors, read_vector_file
from vexel.storage import new_path
from vexel.streaming import append_to_index


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(7)
    points = rng.standard_normal((600, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<float>").cache()
    return points, df


def true_cosine(points, q, k):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    return np.argsort(-(unit @ (q / np.linalg.norm(q))), kind="stable")[:k].tolist()


def test_vector_aggregates(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (1, [3.0, 4.0, 5.0]), (1, [5.0, 6.0, 7.0]), (1, None), (2, None)], "k int, v array<float>")
    assert {r["k"]: r["avg"] for r in aggregates.vector_avg(df, ["k"], "v").collect()} == {1: [3.0, 4.0, 5.0], 2: None}
    assert {r["k"]: r["sum"] for r in aggregates.vector_sum(df, ["k"], "v").collect()} == {1: [9.0, 12.0, 15.0], 2: None}
    assert aggregates.vector_avg(df.limit(0), ["k"], "v").count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0])], "k int, v array<float>")
    with pytest.raises(Exception, match="differ in dimension"):
        aggregates.vector_avg(mixed, ["k"], "v").collect()


def test_sparse_sum(spark):
    df = spark.sql("select 1 k, named_struct('dim', 5, 'indices', array(0, 2), 'values', array(1f, 2f)) v union all select 1, named_struct('dim', 5, 'indices', array(0, 4), 'values', array(1f, 3f)) union all select 1, named_struct('dim', 5, 'indices', array(2), 'values', array(-2f))")
    row = aggregates.sparsevec_sum(df, ["k"], "v").first()["sum"]
    assert (row["dim"], row["indices"], row["values"]) == (5, [0, 4], [2.0, 3.0])


def test_exact_topk_orders_nulls_last(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0])], "id long, vector array<float>")
    assert [r["id"] for r in search.exact_topk(df, [1.0, 0.0], 4).collect()] == [1, 4, 2, 3]


def test_filters(spark, corpus):
    _, df = corpus
    assert search.with_ids(df, [3, 3, None, 999], "id").count() == 1
    assert search.with_ids(df, [], "id").count() == 0
    assert search.with_ids(df, None, "id").count() == 600
    assert search.parse_allowlist(" 1, 2,,") == [1, 2]
    assert search.parse_allowlist("  ") is None
    with pytest.raises(ValueError):
        search.parse_allowlist("1,x")


def test_knn_recall_and_limits(corpus):
    points, df = corpus
    hits = 0
    for n in range(5):
        found = [r["id"] for r in search.knn(df, points[n].tolist(), 10).collect()]
        assert len(set(found)) == 10
        hits += len(set(found) & set(true_cosine(points, points[n], 10)))
    assert hits >= 35
    assert search.knn(df, points[0].tolist(), 1000).count() == 600
    assert search.knn(df.limit(0), points[0].tolist(), 3).count() == 0
    assert [r["id"] for r in search.knn(df, points[0].tolist(), 5, allowed=[3, 4]).orderBy("id").collect()] == [3, 4]
    for bad in ({"k": 0}, {"k": 1, "bit_width": 5}):
        with pytest.raises(ValueError):
            search.knn(df, points[0].tolist(), **bad)
    with pytest.raises(ValueError):
        search.knn(df, [1.0] * 7, 1)


@pytest.mark.parametrize("spec", [IndexSpec("flat"), IndexSpec("flat", bit_width=2), IndexSpec("ivf", lists=8), IndexSpec("ivf", lists=8, assign_dups=3), IndexSpec("graph")])
def test_index_kinds(spark, corpus, spec):
    points, df = corpus
    index = build_index(df, new_path(spark, "idx"), spec)
    q = (points[5] + 0.1).tolist()
    truth = true_cosine(points, np.asarray(q), 10)
    every = SearchConfig(search_k=600, probes=100, max_probes=100)
    assert [r["id"] for r in index.search(df, q, 10, every).collect()] == truth
    assert Index.open(spark, index.path).manifest["rows"] == 600
    some = [r["id"] for r in index.search(df, q, 10, SearchConfig(search_k=64, probes=4)).collect()]
    assert len(set(some)) == len(some) and len(set(some) & set(truth)) >= 4
    gone = index.delete(truth[:3])
    assert [r["id"] for r in gone.search(df, q, 10, every).collect()] == true_cosine_without(points, q, truth[:3])
    more = gone.insert(spark.createDataFrame([(1000, q)], "id long, vector array<float>"))
    base = df.union(spark.createDataFrame([(1000, q)], "id long, vector array<float>"))
    assert more.search(base, q, 1, every).first()["id"] == 1000
    assert not more.is_degraded()
    small = more.compact(base)
    assert small.manifest["rows"] == 598 and small.search(base, q, 1, every).first()["id"] == 1000


@pytest.mark.parametrize("spec", [IndexSpec("flat"), IndexSpec("ivf", lists=8, assign_dups=2), IndexSpec("graph")])
def test_index_lifecycle(spark, corpus, spec):
    """Replace, delete, insert again, vacuum, old versions, conflicting changes, drop."""
    points, df = corpus
    schema = "id long, vector array<float>"
    index = build_index(df, new_path(spark, "life"), spec)
    far, near = (points[5] * -1).tolist(), (points[7] + 0.01).tolist()
    changed = df.where("id <> 5").union(spark.createDataFrame([(5, far)], schema))
    nearest = lambda i, q: i.search(changed, q, 1, exhaustive=True).first()["id"]
    found = lambda i, q: {r["row_id"]: r["score"] for r in i.candidates(q, 600, probes=100).collect()}
    replaced = index.insert(spark.createDataFrame([(5, far)], schema))
    assert found(replaced, points[5].tolist())[5] < -0.8 < 0.8 < found(index, points[5].tolist())[5]
    assert replaced.ids().count() == 600 and nearest(replaced, far) == 5
    gone = replaced.delete([5, 7])
    assert gone.ids().count() == 598 and nearest(gone, near) != 7 and nearest(gone, far) != 5
    again = gone.insert(spark.createDataFrame([(7, near)], schema))
    assert again.ids().count() == 599 and nearest(again, near) == 7 and nearest(again, far) != 5
    with pytest.raises(IndexConflictError):
        gone.delete([1])
    base = changed.where("id <> 7").union(spark.createDataFrame([(7, near)], schema))
    small = again.vacuum(base)
    assert not small.manifest["deltas"] and not small.manifest["deleted"] and small.manifest["rows"] == 599
    assert nearest(small, near) == 7 and nearest(small, far) != 5 and small.ids().count() == 599
    assert nearest(again, near) == 7  # a reader of the version before
    smaller = Index.open(spark, index.path).delete([7]).vacuum(base).delete([9]).compact(base)
    assert smaller.ids().count() == 597
    names = [f.getPath().getName() for f in spark._jvm.org.apache.hadoop.fs.Path(index.path).getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(index.path))]
    assert sum(len(n) == 32 for n in names) == 2 and index.manifest["version"] not in names
    smaller.drop()
    with pytest.raises(IndexFormatError):
        Index.open(spark, index.path)


def test_cells_are_pruned_by_partition(spark, corpus):
    points, df = corpus
    index = build_index(df, new_path(spark, "cells"), IndexSpec("ivf", lists=16))
    plan = index.candidates(points[0].tolist(), 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_partial_index_holds_what_its_predicate_says(spark, corpus):
    _, df = corpus
    index = build_index(df, new_path(spark, "partial"), IndexSpec("flat", predicate="id % 3 = 0"))
    assert index.ids().count() == 200 and index.ids().where("row_id % 3 <> 0").count() == 0


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """20,000 vectors of 128 elements in loose clusters, and 40 queries that are not among them."""
    rng = np.random.default_rng(17)
    centers = rng.standard_normal((200, 128))
    points = (centers[rng.integers(200, size=20_040)] + 0.8 * rng.standard_normal((20_040, 128))).astype(np.float32)
    points, queries = points[:20_000], points[20_000:]
    path = str(tmp_path_factory.mktemp("large") / "points.parquet")
    rows = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), 128).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"id": np.arange(20_000), "vector": rows}), path)
    asked = spark.createDataFrame([(k, q.tolist()) for k, q in enumerate(queries)], "qid long, query array<float>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(-(unit(queries) @ unit(points).T), axis=1, kind="stable")
    return spark.read.parquet(path), asked, order


@pytest.mark.parametrize(("spec", "rows", "floor"), [(IndexSpec("flat"), 20_000, 0.95), (IndexSpec("flat", bit_width=2), 20_000, 0.9), (IndexSpec("ivf", lists=64), 20_000, 0.9), (IndexSpec("graph"), 2_000, 0.9)])
def test_recall_at_default_settings(spark, large, spec, rows, floor):
    """Of queries that the index doesn't hold; found ids are distinct."""
    df, asked, order = large
    df = df.where(F.col("id") < rows)
    truth = np.stack([x[x < rows][:10] for x in order])
    index = build_index(df, new_path(spark, "recall"), spec)
    found = {}
    for r in index.batch_search(df, asked, 10).collect():
        found.setdefault(r["qid"], []).append(r["id"])
    assert all(len(x) == len(set(x)) == 10 for x in found.values()) and len(found) == len(truth)
    assert np.mean([len(set(found[k]) & set(t)) / 10 for k, t in enumerate(truth.tolist())]) >= floor
    one = [r["id"] for r in index.search(df, asked.where("qid = 3").first()["query"], 10).collect()]
    assert one == found[3]


@pytest.mark.parametrize(("bits", "floor"), [(4, 0.95), (3, 0.9), (2, 0.8)])
def test_recall_of_estimates_alone(large, bits, floor):
    """Share of the 10 nearest among the 32 best estimates, without exact re-ranking."""
    df, asked, order = large
    truth = order[:, :10]
    queries = [r["query"] for r in asked.orderBy("qid").limit(20).collect()]
    found = search.knn_many(df, queries, 32, bits).toArrow().to_pandas()
    best = found.sort_values(["score", "id"], ascending=[False, True]).groupby("q").head(32)
    hits = [len(set(best[best.q == k].id) & set(truth[k].tolist())) / 10 for k in range(20)]
    assert np.mean(hits) >= floor


def true_cosine_without(points, q, gone):
    order = [i for i in true_cosine(points, np.asarray(q), len(points)) if i not in gone]
    return order[:10]


def test_iterative_scan_fills_a_filtered_search(corpus, spark):
    points, df = corpus
    index = build_index(df, new_path(spark, "iter"), IndexSpec("ivf", lists=8))
    q = points[1].tolist()
    short = index.search(df, q, 10, SearchConfig(search_k=10, probes=1), where="id % 10 = 0").count()
    full = index.search(df, q, 10, SearchConfig(search_k=10, probes=1, iterative_scan="relaxed_order"), where="id % 10 = 0").count()
    assert short < full == 10


def test_index_refuses_what_it_does_not_know(spark, tmp_path):
    with pytest.raises(IndexFormatError):
        Index.open(spark, str(tmp_path))
    (tmp_path / "manifest.json").write_text('{"format": 99}')
    with pytest.raises(IndexFormatError):
        Index.open(spark, str(tmp_path))
    for bad in ({"dim": 7}, {"bit_width": 1}, {"kind": "ivf"}, {"kind": "graph", "lists": 3}, {"assign_dups": 9}):
        with pytest.raises(ValueError):
            IndexSpec(**bad)


def test_token_index_and_colbert(spark):
    rng = np.random.default_rng(3)
    tokens = rng.standard_normal((40, 4, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(tokens)], "id long, tokens array<array<float>>")
    q = tokens[9, :2].tolist()
    unit = np.asarray(q) / np.linalg.norm(q, axis=1, keepdims=True)
    truth = np.argsort([-sum((t @ u).max() for u in unit) for t in tokens], kind="stable")[:5].tolist()
    assert [r["id"] for r in hybrid.colbert_search(df, q, 5, per_token_k=400, candidate_n=40).collect()] == truth
    index = build_index(df, new_path(spark, "tok"), IndexSpec("colbert", lists=4), "id", "tokens")
    assert [r["id"] for r in index.colbert_search(df, q, 5, per_token_k=400, candidate_n=40, probes=4).collect()] == truth
    assert hybrid.colbert_search(df, [], 5).count() == 0


def test_rrf(spark):
    dense = spark.createDataFrame([(2, 0), (1, 1), (3, 2), (4, 3)], "id long, rank int")
    sparse = spark.createDataFrame([(2, 0), (3, 1), (1, 2), (4, 3)], "id long, rank int")
    fused = hybrid.rrf_fuse([dense, sparse]).collect()
    assert fused[0]["id"] == 2 and fused[0]["score"] == pytest.approx(2 / 60)


def test_stream_into_index(spark, corpus, tmp_path):
    points, df = corpus
    path = new_path(spark, "stream")
    build_index(df.limit(0), path, IndexSpec("flat", dim=32))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(append_to_index(spark, path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = Index.open(spark, path).search(df, points[3].tolist(), 1, SearchConfig(search_k=600))
    assert found.first()["id"] == 3


def test_sql_table_function_and_sources(spark, corpus, tmp_path):
    points, df = corpus
    register(spark)
    df.createOrReplaceTempView("corpus")
    literal = "array(" + ",".join(f"{x}f" for x in points[4].astype(float)) + ")"
    rows = spark.sql(f"select * from knn(table(select id, vector from corpus) with single partition, {literal}, 3, 4)").collect()
    assert rows[0]["id"] == 4 and len(rows) == 3
    assert spark.sql(f"select vexel_self_score({literal}, 4)").first()[0] > 0.5
    few = spark.sql(f"select * from knn(table(select id, vector from corpus) with single partition, {literal}, 3, 4, array(4L, 9L))").collect()
    assert sorted(r["id"] for r in few) == [4, 9]
    df.withColumn("tokens", F.array(F.slice("vector", 1, 16), F.slice("vector", 17, 16))).createOrReplaceTempView("token_corpus")
    tokens = "array(" + ",".join("array(" + ",".join(f"{x}f" for x in points[4, a : a + 16].astype(float)) + ")" for a in (0, 16)) + ")"
    found = spark.sql(f"select * from colbert_search(table(select id, tokens from token_corpus) with single partition, {tokens}, 5)").collect()
    plain = hybrid.colbert_search(spark.table("token_corpus"), points[4].reshape(2, 16).tolist(), 5, exhaustive=True).collect()
    assert [r["id"] for r in found] == [r["id"] for r in plain] and np.allclose([r["score"] for r in found], [r["score"] for r in plain])
    (tmp_path / "v.tsv").write_text("1\t[1, 2]\n2\t[3, 4.5]\n")
    assert [r["v"] for r in read_text_vectors(spark, str(tmp_path / "v.tsv"), "id long, v string", ["v"]).orderBy("id").collect()] == [[1.0, 2.0], [3.0, 4.5]]
    np.concatenate([np.asarray([2, 2], "<u4").view("<f4"), np.asarray([1, 2, 3, 4], "<f4")]).tofile(tmp_path / "v.bin")
    assert [r["vector"] for r in read_vector_file(spark, str(tmp_path / "v.bin")).orderBy("id").collect()] == [[1.0, 2.0], [3.0, 4.0]]


def test_plans_push_filters_and_prune_columns(spark, corpus, tmp_path):
    _, df = corpus
    path = str(tmp_path / "p")
    df.withColumn("other", F.lit("x")).write.parquet(path)
    top = search.exact_topk(spark.read.parquet(path).where("id > 5").select("id", "vector"), [1.0] * 32, 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThan(id,5)" in plan and "other" not in plan.split("ReadSchema")[1]


def test_batch_search_passes_nulls_over(spark, corpus):
    points, df = corpus
    asked = spark.createDataFrame([(1, points[3].tolist()), (None, points[4].tolist()), (2, None)], "qid long, query array<float>")
    rows = df.union(spark.createDataFrame([(None, points[3].tolist()), (900, None)], df.schema))
    found = search.batch_topk(rows, asked, 3, "cosine").collect()
    assert {r["qid"] for r in found} == {1} and next(r["id"] for r in found if r["rank"] == 1) == 3
    assert search.within(asked.select(F.col("qid").alias("left_id"), F.col("query").alias("a")), rows.select(F.col("id").alias("right_id"), F.col("vector").alias("b")), 0.001).collect()[0]["right_id"] == 3


def test_bm25_and_joining_back(spark):
    texts = ["the cat sat", "the the the dog and more of it", "a cat and a cat", None, "", "dog"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    words = [t.split() if t else [] for t in texts]
    mean = sum(map(len, words)) / 6
    plain = {}
    for i, w in enumerate(words):
        for t in ("cat", "dog"):
            n = sum(t in x for x in words)
            tf = w.count(t)
            if tf:
                plain[i] = plain.get(i, 0) + np.log(1 + (6 - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    got = hybrid.bm25(df, ["Cat", "dog"])
    assert {r["id"]: r["score"] for r in got.collect()} == pytest.approx(plain)
    back = hybrid.joined_back(got.orderBy(F.desc("score")).limit(2), df).collect()
    assert back[0]["text"] == texts[max(plain, key=plain.get)] and len(back) == 2
    assert hybrid.bm25(df.limit(0), ["cat"]).count() == 0


def test_every_module_imports_on_its_own():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    names = [".".join(p.relative_to(root).with_suffix("").parts) for p in sorted((root / "vexel").rglob("*.py")) if "llm" not in p.parts]
    script = "import importlib, os, sys\nfor n in sys.argv[1:]:\n    if os.fork() == 0:\n        importlib.import_module(n); os._exit(0)\n    assert os.wait()[1] == 0, n"
    assert subprocess.run([sys.executable, "-c", script, *[n.removesuffix(".__init__") for n in names]], cwd=root).returncode == 0


def test_metrics(spark):
    truth = spark.createDataFrame([(1, 10), (1, 11)], "qid long, id long")
    found = spark.createDataFrame([(1, 10), (1, 12)], "qid long, id long")
    assert hybrid.recall_at_k(found, truth).first()["recall"] == 0.5
    gains = spark.createDataFrame([(1, 10, 3.0), (1, 11, 1.0)], "qid long, id long, gain double")
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "qid long, id long, rank int")
    assert hybrid.ndcg_at_k(ranked, gains).first()["ndcg"] == pytest.approx(1.0)


def test_whole_distance_join_matches_brute_force(spark, tmp_path):
    from vexel.queries import QUERIES

    points = np.random.default_rng(3).standard_normal((120, 8)).astype(np.float32) / 4
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    dist = np.sqrt(((points[:, None].astype(float) - points[None].astype(float)) ** 2).sum(axis=2))
    true = {(i, j) for i in range(120) for j in range(i + 1, 120) if dist[i, j] <= 1.1}
    found = [tuple(r) for r in QUERIES["distance_join_whole"](spark, str(tmp_path)).collect()]
    assert len(found) == len(set(found)) and set(found) == true and any(i >= 40 for i, _ in true)


@pytest.mark.parametrize("metric,limit", [("l2", 1.1), ("l2", 0.0), ("cosine", 0.5), ("l1", 2.0)])
def test_distance_joins_in_blocks_match_brute_force(spark, monkeypatch, metric, limit):
    """Blocks of a few rows, copies, repeated ids, very long vectors, NaN and nulls; the exact distances come along."""
    rng = np.random.default_rng(5)
    points = (rng.standard_normal((90, 8)) / 3).astype(np.float32)
    points[70:75], points[80], points[81, 2] = points[3], 1e6, np.nan
    ids = [*range(88), 5, 5]
    rows = [(i, p.tolist()) for i, p in zip(ids, points, strict=True)] + [(None, points[0].tolist()), (500, None)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    dist = search.pairwise(metric, points.astype(float), points.astype(float))
    near = [(ids[a], ids[b], dist[a, b]) for a in range(90) for b in range(90) if dist[a, b] <= limit]
    monkeypatch.setattr(search, "JOIN_ROWS", 10)
    monkeypatch.setattr(search, "BLOCK_BYTES", 600)
    found = search.within(df.select(F.col("id").alias("left_id"), F.col("vector").alias("a")), df.select(F.col("id").alias("right_id"), F.col("vector").cast("array<double>").alias("b")), limit, metric)
    assert sorted(map(tuple, found.collect())) == sorted(near)
    whole = search.within_self(df, limit, metric)
    assert sorted(map(tuple, whole.collect())) == sorted((a, b, d) for a, b, d in near if a < b)
    assert whole.rdd.getNumPartitions() > 1


def test_every_point_of_a_graph_can_be_reached(spark, tmp_path):
    """Copies beyond a list's length, far groups and a single point; an exhaustive search finds all rows."""
    from vexel.index import graph

    rng = np.random.default_rng(2)
    far = rng.standard_normal((3, 16)) * 50
    points = np.concatenate([np.repeat(rng.standard_normal((1, 16)), 200, axis=0), *(f + rng.standard_normal((150, 16)) / 100 for f in far), np.full((1, 16), 500.0)]).astype(np.float32)
    links, entry = graph.build(points)
    seen, todo = {entry}, [entry]
    while todo:
        new = set(links[todo.pop()].tolist()) - seen
        seen |= new
        todo += new
    assert len(seen) == len(points) == len(links)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<float>")
    index = build_index(df, str(tmp_path / "g"), IndexSpec("graph", "l2"))
    assert index.search(df, points[0].tolist(), len(points), exhaustive=True).count() == len(points)
    assert graph.build(points[:1])[1] == 0 and graph.build(points[:0]) == ([], 0)


def test_batch_scoring_stays_within_bounded_arrays():
    """4096 queries over a batch of 10,000 rows take no arrays of queries times rows; what is found is the plain answer, ties by id."""
    import tracemalloc

    import pyarrow as pa

    from vexel.index import store
    from vexel.quantize import Quantizer

    rng = np.random.default_rng(4)
    quantizer, ids = Quantizer(8, 4), np.arange(4096)
    points, queries = rng.standard_normal((10_000, 8)).astype(np.float32), rng.standard_normal((4096, 8)).astype(np.float32)
    points[5000:] = points[:5000]
    codes, scale = quantizer.encode(points)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(scale), pa.array(quantizer.pack(codes), pa.binary())], names=["row_id", "scale", "codes"])
    tracemalloc.start()
    got = list(store._score(quantizer, ids, queries, 5, None)(iter([batch])))
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    got = sorted(zip(*(np.concatenate([b.column(i).to_numpy() for b in got]).tolist() for i in range(3)), strict=True))
    assert len(got) == 5 * 4096
    for q in (0, 1, 4095):
        scores = (quantizer.levels[codes] * scale[:, None]) @ queries[q]
        rows = [r for i, r, _ in got if i == q]
        assert np.sort(scores[rows]) == pytest.approx(np.sort(scores)[-5:], abs=1e-5)
        assert len({r % 5000 for r in rows}) == 3 and sum(r < 5000 for r in rows) == 3


def plain_walk(scores, offsets, neighbours, entry, k, dead):
    """One query's walk, step by step."""
    width, seen, best, done = max(4 * k, 64), {entry}, [entry], set()
    while True:
        best = sorted(best, key=lambda p: (-scores[p], p))[: min(width, len(scores))]
        ahead = [p for p in best if p not in done]
        if not ahead:
            return {p for p in [p for p in best if not dead[p]][:k]}
        done.add(ahead[0])
        new = [p for p in neighbours[offsets[ahead[0]] : offsets[ahead[0] + 1]].tolist() if p not in seen]
        seen.update(new)
        best += new


@pytest.mark.parametrize("kind", ["spread", "copies", "star", "one"])
def test_queries_that_walk_together_find_what_each_finds_alone(kind):
    from vexel.index import graph

    rng = np.random.default_rng(6)
    points = rng.standard_normal((1 if kind == "one" else 900, 16)).astype(np.float32)
    if kind == "copies":
        points[:500] = points[0]
    links, entry = graph.build(points)
    if kind == "star":
        links[entry] = np.setdiff1d(np.arange(900), [entry]).astype(np.int32)
    offsets, neighbours = np.concatenate([[0], np.cumsum([len(x) for x in links])]), np.concatenate(links)
    scores = (rng.standard_normal((70, 16)).astype(np.float32) @ points.T).astype(np.float32)
    if kind == "copies":
        scores[:, :500] = scores[:, :1]
    for k, dead in ((3, np.zeros(len(points), dtype=bool)), (40, rng.random(len(points)) < 0.3)):
        places, found = graph.search(scores, offsets, neighbours, entry, k, dead)
        for q in range(len(scores)):
            some = places[q] >= 0
            assert set(places[q][some].tolist()) == plain_walk(scores[q], offsets, neighbours, entry, k, dead)
            assert (found[q][some] == scores[q][places[q][some]]).all()


def test_batches_do_by_block_what_needs_no_query(spark, tmp_path, monkeypatch):
    """A block of queries takes one quantizer, and a task's shards give it no more rows than one shard does."""
    from vexel.index import store

    rng = np.random.default_rng(8)
    points = rng.standard_normal((400, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, vector array<float>").coalesce(1)
    index = build_index(df, str(tmp_path / "g"), IndexSpec("graph"), config=SearchConfig(graph_build_partitions=4))
    made, real = [], store.Quantizer
    monkeypatch.setattr(store, "Quantizer", lambda *a: made.append(a) or real(*a))
    found = index._candidates(np.arange(50), points[:50], 10)
    assert len(made) <= 2
    walked = index._walk(np.arange(50), np.stack([index.quantizer.prepare(p) for p in points[:50]]), 10, None)
    per_task = walked.groupBy(F.spark_partition_id(), "qid").count().agg(F.max("count")).first()[0]
    assert per_task == 10 and walked.rdd.getNumPartitions() < 4
    best = {r["qid"]: r["row_id"] for r in found.orderBy("score").collect()}
    assert best == {i: i for i in range(50)}


def test_exact_search_measures_few_pairs(monkeypatch):
    """Of 300 queries and 6000 rows few pairs are measured element by element; found are the plain answer, copies and rows without a direction included."""
    rng = np.random.default_rng(9)
    points = rng.standard_normal((6000, 16)).astype(np.float32).astype(float)
    points[100:130], points[5000:5030], points[40] = points[7], points[7], 0
    ids = rng.permutation(6000)
    asked = np.concatenate([[40, 7, 100], np.arange(200, 497)])
    with np.errstate(invalid="ignore"):
        exact = search.pairwise("cosine", points[asked], points)
    measured, real = [], search._cosines
    monkeypatch.setattr(search, "_cosines", lambda a, b, sizes: measured.append(len(a)) or real(a, b, sizes))
    monkeypatch.setattr(search, "pairwise", lambda *a: pytest.fail("all pairs were measured"))
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(points.tolist(), pa.list_(pa.float64()))], names=["id", "v"])
    got = {}
    for b in search._local_topk(ids[asked], points[asked], 5, "cosine", True)(iter([batch])):
        for q, i, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
            got.setdefault(q, []).append((np.nan_to_num(d, nan=9.0), i))
    for q, dist in zip(asked, exact, strict=True):
        plain = sorted((np.nan_to_num(d, nan=9.0), int(i)) for d, i in zip(dist, ids, strict=True) if i != ids[q])[:5]
        assert sorted(got[ids[q]]) == plain
    assert 300 * 5 <= sum(measured) < 300 * 6000 / 10
