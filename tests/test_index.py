"""The stored index against scoring of all documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import retrieve as R
from inkwell.operators.index import PostingIndex, words_of


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    pick = lambda: f"w{int(words * rng.random() ** 3)}"
    return [(k, " ".join(pick() for _ in range(rng.choice([0, 1, 5, 40, 41, 300]))) if k % 17 else None) for k in range(n)]


ASKED = [(1, "w0 w1 w2"), (2, "w50 w58 w59"), (3, "w0"), (4, "none of these"), (5, ""), (6, "w59 w59 w7")]


def same(spark, index, docs, asked, k, scope="all"):
    hits, looked = index.search(asked, k, scope)
    want = R.top_k(R.bm25_scores(docs, asked), k)
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 5)) for r in df.collect())
    assert rows(hits) == rows(want)
    return {r.query_id: (r.scored, r.ranges) for r in looked.collect()}


def test_all_segments_count_and_blocks_are_skipped(spark, tmp_path):
    index = PostingIndex(spark, f"file://{tmp_path}/i", id_type="bigint", per_range=4)
    rows = corpus(1, 500)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame(ASKED, "query_id int, query string")
    assert index.search(asked, 3)[0].count() == 0 and index.search(asked, 3)[0].columns == ["query_id", "id", "score", "rank"]
    index.append(docs.where("doc_id < 300"), "a")
    index.append(docs.where("doc_id >= 300"), "b")
    looked = same(spark, index, docs, asked, 5)
    assert looked[2][0] < looked[2][1] and looked[3][0] < looked[3][1] and set(looked) == {1, 2, 3, 6}
    same(spark, index, docs, asked, 1)
    same(spark, index, docs, asked, 1000)
    # a segment that is written again takes the place of the first; a broken one does not count
    index.append(docs.where("doc_id >= 300"), "b")
    same(spark, index, docs, asked, 5)
    docs.write.parquet(f"file://{tmp_path}/i/blocks/scope=all/segment=broken")
    same(spark, index, docs, asked, 5)
    df = {r.term: r.df for r in index.terms().collect()}
    assert df == {r.term: r.df for r in R.postings(docs).groupBy("term").agg(F.count("*").alias("df")).collect()}
    index.drop(segment="a")
    same(spark, index, docs.where("doc_id >= 300"), asked, 5)


def test_scopes_are_apart_and_names_are_checked(spark, tmp_path):
    index = PostingIndex(spark, f"file://{tmp_path}/i", id_type="bigint")
    one, two = (spark.createDataFrame(corpus(s, 80), "doc_id long, text string") for s in (2, 3))
    asked = spark.createDataFrame(ASKED, "query_id int, query string")
    index.append(one, "0001", "one")
    index.append(two, "0001", "two")
    same(spark, index, one, asked, 5, "one")
    index.drop("one")
    assert index.search(asked, 5, "one")[0].count() == 0
    same(spark, index, two, asked, 5, "two")
    with pytest.raises(ValueError):
        index.append(one, "a/b")


def shuffled(spark, act):
    """Rows that ``act`` shuffles."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    rows = lambda: sum(s.shuffleWriteRecords() for s in (lambda l: [l.apply(n) for n in range(l.size())])(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)))
    before = rows()
    act()
    return rows() - before


def test_documents_are_shuffled_and_words_are_not(spark, tmp_path):
    index = PostingIndex(spark, f"file://{tmp_path}/i", id_type="bigint")
    docs = spark.createDataFrame(corpus(4, 400), "doc_id long, text string")
    assert shuffled(spark, lambda: index.append(docs, "a")) < 800


def test_words_of_a_task_are_tokens(spark):
    odd = [f"a{chr(c)}b{chr(c)}" for c in [*range(0x21), 0x7F, 0x85, 0xA0, 0x180E, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF]]
    odd += ["", " ", "x\x1c y\x1fz \x1d", "\x1e", "é \U0001F600 ß"]
    rows = spark.createDataFrame([(t,) for t in odd], "text string")
    assert [(r.text, r.w) for r in rows.select("text", R.tokens(F.col("text")).alias("w")).collect()] == [(t, words_of(t)) for t in odd]
