"""Queries on retrieval and evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkwell.operators import retrieve as R
from inkwell.operators.index import PostingIndex
from inkwell.operators.vectors import VectorIndex
from inkwell.plans import inputs
from inkwell.sources.readers import drop_folder, parquet, shared_dir, spread

FLAGSHIP = "the and with that reon"


def _docs(spark, sf):
    return inputs.documents(spark, sf)


def _asked(spark, sf):
    return parquet(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _one(spark):
    return spark.createDataFrame([(0, FLAGSHIP)], "query_id int, query string")


def bm25_topk(spark, sf):
    """Ten best documents of one query."""
    return R.top_k(R.bm25_scores(_docs(spark, sf), _one(spark)), 10).select(F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def bm25_corpus_stats(spark, sf):
    return R.corpus_stats(_docs(spark, sf)).select("n_docs", F.round("avg_len", 6).alias("avg_len"))


def bm25_postings(spark, sf):
    """Document frequency and occurrences of every term."""
    return R.postings(_docs(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def corpus_append(spark, sf):
    """Terms of a corpus to which documents of the source ``src0`` were uploaded again; nothing is replaced."""
    docs = parquet(spark, sf, "documents")
    again = docs.where("source = 'src0'").select(F.concat(F.lit("again-"), "doc_id").alias("doc_id"), "text")
    both = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(again)
    return R.postings(both).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_multi_query_topk(spark, sf):
    """Ten best documents of each benchmark text as a query."""
    return R.best_bm25(_docs(spark, sf), _asked(spark, sf), 10)[0].select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def _index(spark, sf):
    """A stored index of all documents: those of one source first, then the others as a second segment."""
    folder = f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
    drop_folder(spark, folder, now=False)
    index, docs = PostingIndex(spark, folder, id_type="bigint"), parquet(spark, sf, "documents")
    first = F.coalesce(F.col("source") == "src0", F.lit(False))
    for name, rows in (("first", docs.where(first)), ("more", docs.where(~first))):
        index.append(spread(rows.select("doc_id", "text"), docs), name)
    return index


def bm25_index_topk(spark, sf):
    """Ten best documents of each benchmark text, from a stored index that skips blocks."""
    hits, _ = _index(spark, sf).search(_asked(spark, sf), 10)
    return hits.select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def bm25_index_terms(spark, sf):
    """Document frequencies from the heads of a stored index' blocks, over its segments."""
    return _index(spark, sf).terms().select("term", "df")


def _vectors(spark, sf):
    return parquet(spark, sf, "embeddings")


def dense_topk(spark, sf):
    """Ten nearest of every query; the queries are the vectors whose id is divisible by 50."""
    asked = _vectors(spark, sf).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return R.nearest(spread(_vectors(spark, sf), _vectors(spark, sf)), asked, 10).select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def dense_pruned_topk(spark, sf):
    """The same from stored cells of vectors, of which only those are scored that may be among the nearest."""
    folder = f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}"
    drop_folder(spark, folder, now=False)
    index, vectors = VectorIndex(spark, folder, id_type="bigint"), _vectors(spark, sf)
    index.build(vectors)
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    hits, _ = index.search(asked, 10)
    return hits.select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def dense_topk_by_group(spark, sf):
    """In each group (label, the session), the nearest to its smallest vector."""
    v = _vectors(spark, sf)
    asked = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("query_vector"), F.min("vec_id").alias("query_id"))
    return R.top_k(R.dense_scores(v, asked, scope="label"), 10, ("query_id",)).select("query_id", "label", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def _lists(spark, sf):
    """BM25 with the usual and with flat length normalisation, as two rankings of the same queries."""
    from dataclasses import replace

    from inkwell.config import DEFAULT

    docs, asked = _docs(spark, sf), _asked(spark, sf)
    one, two = R.best_bm25(docs, asked, 10, (DEFAULT, replace(DEFAULT, bm25_b=0.0)))  # both scores come from the same pass
    return docs, asked, one, two


def weighted_rrf(spark, sf):
    _, _, one, two = _lists(spark, sf)
    return R.fuse(one, two).select("query_id", F.col("id").alias("doc_id"), "score")


def _reranked(spark, sf):
    docs, asked, one, two = _lists(spark, sf)
    return R.rerank(R.fuse(one, two), docs.withColumnRenamed("doc_id", "id"), asked)


def rerank_topn(spark, sf):
    return _reranked(spark, sf).select("query_id", F.col("id").alias("doc_id"), "coverage", "score", F.col("rank").cast("long").alias("rank"))


def evidence_rows(spark, sf):
    rows = _reranked(spark, sf).withColumn("doc_id", F.col("id")).withColumn("filename", F.concat(F.lit("doc-"), "id", F.lit(".txt")))
    return R.evidence_rows(rows).select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "filename", "chunk_id", F.col("page_start").cast("long").alias("page_start"), "snippet")


def evidence_block(spark, sf):
    return R.evidence_block(_reranked(spark, sf).withColumn("doc_id", F.col("id")))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_corpus_stats, bm25_postings, corpus_append, bm25_multi_query_topk, bm25_index_topk, bm25_index_terms, dense_topk, dense_pruned_topk, dense_topk_by_group, weighted_rrf, rerank_topn, evidence_rows, evidence_block)}


def _d_bm25(name: str, queries: str, b: float = 0.75) -> str:
    """CTEs up to NAME, the ten best of each query."""
    return f"""
    {name}_q AS (SELECT DISTINCT query_id, unnest(list_filter(string_split_regex(query, '\\s+'), lambda w: w <> '')) AS term FROM ({queries})),
    {name}_h AS (SELECT doc_id, term, len, count(*) AS tf FROM words WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
    {name}_df AS (SELECT term, count(*) AS df FROM {name}_h GROUP BY term),
    {name}_s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * len / avg_len))), 6) AS score
                 FROM {name}_h JOIN {name}_df USING (term) JOIN {name}_q USING (term), stats GROUP BY ALL),
    {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_s QUALIFY rank <= 10)"""


_WORDS = """lists AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
    words AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM lists),
    stats AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM lists)"""
_ASKED = "SELECT item_id AS query_id, text AS query FROM benchmark"
_FUSED = f"""WITH {_WORDS}, {_d_bm25('one', _ASKED)}, {_d_bm25('two', _ASKED, 0.0)},
    fused AS (SELECT query_id, doc_id, round(sum(part), 9) AS score FROM (SELECT query_id, doc_id, 0.6 / (60 + rank) AS part FROM one UNION ALL SELECT query_id, doc_id, 0.4 / (60 + rank) FROM two) GROUP BY ALL)"""
_BEST = f"""{_FUSED},
    cov AS (SELECT f.query_id, f.doc_id, f.score, d.text, round((SELECT count(*) FROM one_q q WHERE q.query_id = f.query_id AND list_contains(l.w, q.term)) / (SELECT count(*) FROM one_q q WHERE q.query_id = f.query_id), 6) AS coverage
            FROM fused f JOIN documents d USING (doc_id) JOIN lists l USING (doc_id)),
    best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coverage DESC, score DESC, doc_id) AS rank FROM cov QUALIFY rank <= 8)"""
_COSINE = "round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
ORACLE = {
    "bm25_topk": f"WITH {_WORDS}, {_d_bm25('one', f'''SELECT 0 AS query_id, '{FLAGSHIP}' AS query''')} SELECT doc_id, score, rank FROM one",
    "bm25_corpus_stats": f"WITH {_WORDS} SELECT n_docs, round(avg_len, 6) AS avg_len FROM stats",
    "bm25_postings": f"WITH {_WORDS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM tf GROUP BY term",
    "corpus_append": """WITH l AS (SELECT doc_id || '' AS doc_id, text FROM documents UNION ALL SELECT 'again-' || doc_id, text FROM documents WHERE source = 'src0'),
        w AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS term FROM l)
        SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY term""",
    "bm25_multi_query_topk": f"WITH {_WORDS}, {_d_bm25('one', _ASKED)} SELECT query_id, doc_id, score, rank FROM one",
    "bm25_index_topk": f"WITH {_WORDS}, {_d_bm25('one', _ASKED)} SELECT query_id, doc_id, score, rank FROM one",
    "bm25_index_terms": f"WITH {_WORDS} SELECT term, count(DISTINCT doc_id) AS df FROM words GROUP BY term",
    "dense_topk": f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {_COSINE} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
    "dense_pruned_topk": f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, {_COSINE} AS score FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
    "dense_topk_by_group": f"""WITH q AS (SELECT label, min(vec_id) AS query_id, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label),
        s AS (SELECT query_id, label, vec_id, {_COSINE} AS score FROM embeddings v JOIN q USING (label))
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
    "weighted_rrf": f"{_FUSED} SELECT query_id, doc_id, score FROM fused",
    "rerank_topn": f"{_BEST} SELECT query_id, doc_id, coverage, score, rank FROM best",
    "evidence_rows": f"{_BEST} SELECT query_id, rank, CAST(doc_id AS VARCHAR) AS doc_id, 'doc-' || doc_id || '.txt' AS filename, '' AS chunk_id, CAST(1 AS BIGINT) AS page_start, substring(text, 1, 500) AS snippet FROM best",
    "evidence_block": f"""{_BEST} SELECT query_id, string_agg('[Evidence ' || rank || ']' || chr(10) || 'filename: ' || chr(10) || 'doc_id: ' || doc_id || chr(10) || 'chunk_id: ' || chr(10) || 'pages: -' || chr(10) || 'doc_type: ' || chr(10) || 'text: ' || text, chr(10) || chr(10) ORDER BY rank) AS evidence FROM best GROUP BY query_id""",
}
