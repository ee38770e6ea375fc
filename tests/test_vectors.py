"""Search in stored cells against the exact one."""

from __future__ import annotations

import numpy as np

from inkwell.operators import retrieve as R
from inkwell.operators.vectors import VectorIndex

VECTORS = "vec_id long, embedding array<float>"


def test_pruned_search_is_exact_and_scores_fewer(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    rows = [(k, [float(x) for x in centres[k % 12] + 0.15 * rng.normal(size=16)]) for k in range(900)]
    odd = [(901, None), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15)]
    vectors = spark.createDataFrame(rows, VECTORS)
    index = VectorIndex(spark, f"file://{tmp_path}/v", id_type="bigint", cells=24)
    index.build(vectors.unionByName(spark.createDataFrame(odd, VECTORS)))
    asked = [(k, v) for k, v in rows[::60]] + [(5000, [-x for x in rows[0][1]]), (5001, [float(x) for x in rng.normal(size=16)])]
    queries = spark.createDataFrame([*asked, (5002, [0.0] * 16)], "query_id long, query_vector array<float>")
    want = R.top_k(R.dense_scores(vectors, queries.where("query_id <> 5002")), 7)
    hits, looked = index.search(queries, 7)
    rows_of = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    assert rows_of(hits) == rows_of(want)
    counts = {r.query_id: (r.scored, r.vectors) for r in looked.collect()}
    assert set(counts) == {k for k, _ in asked} and all(n == 900 for _, n in counts.values())
    assert sum(s for s, _ in counts.values()) < 0.5 * 900 * len(counts)
    assert rows_of(index.search(queries, 2000)[0]) == rows_of(R.top_k(R.dense_scores(vectors, queries.where("query_id <> 5002")), 2000))


def test_few_and_no_vectors(spark, tmp_path):
    index = VectorIndex(spark, f"file://{tmp_path}/v", id_type="bigint")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<float>")
    index.build(spark.createDataFrame([], VECTORS))
    assert index.search(queries, 3)[0].count() == 0
    index.build(spark.createDataFrame([(7, [0.0, 2.0]), (8, [3.0, 0.0]), (9, [3.0, 0.0])], VECTORS))
    assert [(r.id, r.score) for r in index.search(queries, 3)[0].orderBy("rank").collect()] == [(8, 1.0), (9, 1.0), (7, 0.0)]


def test_nearest_is_all_pairs_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    some = [[float(x) for x in rng.normal(size=8)] for _ in range(40)]
    rows = [(k, some[k % 40]) for k in range(3000)] + [(3001, None), (3002, [1.0]), (3003, [None] * 8)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3)
    queries = spark.createDataFrame([(k, some[k]) for k in range(5)] + [(9, [1.0, 0.0])], "query_id long, query_vector array<float>")
    rows_of = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    for k in (7, 100, 4000):
        assert rows_of(R.nearest(vectors, queries, k)) == rows_of(R.top_k(R.dense_scores(vectors, queries), k))
    zero = R.nearest(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], VECTORS), queries.where("query_id = 9"), 2)
    assert [(r.id, str(r.score)) for r in zero.orderBy("rank").collect()] == [(1, "nan"), (2, "1.0")]  # as in SQL


def test_dense_queries_send_the_best_of_a_task_only(spark, sf_dir):
    from inkwell.plans import catalogue

    for name in ("dense_topk", "dense_pruned_topk"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "zip_with" not in plan and "Join Cross" not in plan, name
