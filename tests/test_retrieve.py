"""The best documents in a task against all scores."""

from __future__ import annotations

import random
from dataclasses import replace

from pyspark.sql import functions as F

from inkwell.config import DEFAULT
from inkwell.operators import retrieve as R


def test_best_bm25_is_the_best_of_all_scores(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{n}" for n in range(30)]
    docs = [(k % 290, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for k in range(300)] + [(k, docs_text) for k, docs_text in ((900, "w1 w2 w2"), (901, "w1 w2 w2"), (902, None))]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(n, " ".join(rng.choices([*words, "none"], k=4))) for n in range(9)] + [(20, "none"), (21, "")], "query_id int, query string")
    flat = replace(DEFAULT, bm25_b=0.0)
    rows_of = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    for pairs in (R.PAIRS, 700, 10):  # one piece, many, and a join
        monkeypatch.setattr(R, "PAIRS", pairs)
        for rows in (docs, docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))):
            one, two = R.best_bm25(rows, queries, 5, (DEFAULT, flat))
            assert rows_of(one) == rows_of(R.top_k(R.bm25_scores(rows, queries), 5)) and rows_of(one)
            assert rows_of(two) == rows_of(R.top_k(R.bm25_scores(rows, queries, config=flat), 5))
    assert rows_of(R.best_bm25(docs, queries.where("query_id > 9"), 5)[0]) == []
