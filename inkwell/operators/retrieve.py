"""Retrieval: BM25 postings, cosine search, weighted rank fusion, rerank stand-in, evidence."""

from __future__ import annotations

from itertools import chain
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from inkwell.config import DEFAULT, Config
from inkwell.operators.nearest import Best, candidates, columns, rounded
from inkwell.sources.readers import settled

#: Rows that are sent to every task, at most.
FEW = 200_000
QUERY_BLOCK = 10_000
#: Numbers of a matrix of terms and queries, or of terms of documents and queries, at most.
PAIRS = 4_000_000


def sized(small: DataFrame, bound: int = FEW) -> DataFrame:
    """To be sent to every task if it is counted to have ``bound`` rows at most; else Spark joins by shuffle."""
    return F.broadcast(small) if small.limit(bound + 1).count() <= bound else small


def tokens(c: Column) -> Column:
    """Runs between white space, case kept, repeats kept."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), "")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: tuple[str, ...] = ()) -> DataFrame:
    """(scope, id, term, tf, doc_len); one shuffle, pre-aggregated in each task."""
    words = docs.select(*scope, F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    return words.select(*scope, "id", F.size("w").cast("long").alias("doc_len"), F.explode("w").alias("term")).groupBy(*scope, "id", "doc_len", "term").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str = "text", scope: tuple[str, ...] = ()) -> DataFrame:
    """Documents and mean length of each scope."""
    n = docs.select(*scope, F.size(tokens(F.col(text_col))).alias("len"))
    return n.groupBy(*scope).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log1p((n_docs - df + 0.5) / (df + 0.5))


def matches(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id, doc_len, tf, df, n_docs, avg_len) for each query term that a document has;
    ``queries`` has query_id and query.

    Documents are read once for matches and once for their number and mean length. Only occurrences of
    query terms are shuffled: their distinct terms filter them where they lie, and frequent terms meet
    their queries without a shuffle, as long as queries have no more than ``FEW`` terms.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    few = F.broadcast if asked.limit(FEW + 1).count() <= FEW else lambda rows: rows
    return _hits(docs, asked, few, id_col, text_col).join(few(asked), "term")


def _hits(docs: DataFrame, asked: DataFrame, few, id_col: str, text_col: str) -> DataFrame:
    """(id, doc_len, term, tf, df, n_docs, avg_len) of the terms that are asked for, by document."""
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    words = words.select("id", F.size("w").cast("double").alias("doc_len"), F.explode("w").alias("term"))
    hits = words.join(few(asked.select("term").distinct()), "term", "left_semi").groupBy("id", "doc_len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    hits = hits.repartition("id")  # what follows goes by document, where the scores of all queries stay in the task
    return hits.join(few(df), "term").crossJoin(F.broadcast(corpus_stats(docs, text_col)))  # one row


def _part(config: Config) -> Column:
    """What a term adds to a score."""
    k1, b = config.bm25_k1, config.bm25_b
    return idf(F.col("n_docs"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (F.lit(1 - b) + b * F.col("doc_len") / F.col("avg_len")))


def bm25(found: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(query_id, id, score) from ``matches``."""
    return found.groupBy("query_id", "id").agg(F.round(F.sum(_part(config)), 6).alias("score"))


def best_bm25(docs: DataFrame, queries: DataFrame, k: int, configs: tuple[Config, ...] = (DEFAULT,), id_col: str = "doc_id", text_col: str = "text") -> list[DataFrame]:
    """The k best documents of each query (query_id, id, score, rank), for each of the settings.

    Terms of a document meet the queries as rows of a matrix, in the task that has the document, and a task
    gives the k best of each query. If queries and terms are too many for that matrix, pairs are joined.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    size = asked.agg(F.count_distinct("query_id").alias("queries"), F.count_distinct("term").alias("terms"), F.count("*").alias("n")).first()
    if size.queries * size.terms > PAIRS or size.n > FEW:
        found = matches(docs, queries, id_col, text_col)
        return [top_k(bm25(found, c), k) for c in configs]
    table = asked.toArrow()
    ids, terms = (table.column(c).combine_chunks().dictionary_encode() for c in ("query_id", "term"))
    names, of = terms.dictionary, SimpleNamespace(ids=ids.dictionary)
    has = np.zeros((len(names), len(of.ids)))
    np.add.at(has, (terms.indices.to_numpy(), ids.indices.to_numpy()), 1.0)
    parts = [f"part{n}" for n in range(len(configs))]

    def run(batches):
        best, rest = [Best(of, k) for _ in configs], None
        for batch in chain(batches, [None]):  # a document's rows follow each other; the last one's wait for the next batch
            rows = pa.Table.from_batches([b for b in (rest, batch) if b is not None]).combine_chunks() if rest is not None or batch is not None else None
            if rows is None or not len(rows):
                continue
            rows = rows.to_batches()[0]
            key = rows.column("id").dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
            end = starts[-1] if batch is not None else len(rows)
            rest, rows, starts = rows.slice(end), rows.slice(0, end), starts[starts < end]
            term = pc.index_in(rows.column("term"), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
            for own in np.split(starts, np.flatnonzero(np.diff(starts * max(1, len(of.ids)) // PAIRS)) + 1) if len(starts) else []:
                last = starts[np.searchsorted(starts, own[-1]) + 1] if own[-1] != starts[-1] else end
                met = has[term[own[0] : last]]
                for b, name in zip(best, parts, strict=True):
                    doc = b.ids_of(rows.column("id").take(pa.array(own)))
                    total = np.add.reduceat(met * rows.column(name).to_numpy()[own[0] : last, None], own - own[0], axis=0)
                    scores = rounded(total)
                    d, q = np.nonzero((total > 0) & (scores >= b.scores[:, -1]))
                    b.offer(q, doc[d], scores[d, q])
        for n, b in enumerate(best):
            for out in b.batch():
                yield out.append_column("n", pa.array(np.full(len(out), n, np.int32)))

    rows = _hits(docs, asked, F.broadcast, id_col, text_col).select("id", "term", *[_part(c).alias(name) for c, name in zip(configs, parts, strict=True)])
    own = StructType([*columns(queries, rows.schema["id"]).fields, StructField("n", IntegerType())])
    found = rows.sortWithinPartitions("id").mapInArrow(run, own)
    if len(configs) > 1:
        found = settled(found, "best")  # k rows of each query and task
    return [top_k(found.where(F.col("n") == n).drop("n"), k) for n in range(len(configs))]


def bm25_scores(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: Config = DEFAULT) -> DataFrame:
    """(query_id, id, score) for every document with a query term."""
    return bm25(matches(docs, queries, id_col, text_col), config)


def top_k(scores: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The k best of each group, ties by id, with rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """In double precision, divided by both norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_scores(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scope: str | None = None) -> DataFrame:
    """(query_id, id, score) of exact search; ``queries`` has query_id, query_vector and the scope.

    Vectors are read where they lie. Queries are sent to every task in blocks of ``QUERY_BLOCK`` at
    most, a scan of the vectors for each block; with a scope that has more, both sides are joined on it.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), *([scope] if scope else []))
    score = lambda joined: joined.select("query_id", *([scope] if scope else []), "id", F.round(cosine(F.col("v"), F.col("query_vector")), 6).alias("score"))
    if scope:
        return score(rows.join(sized(queries, QUERY_BLOCK), scope))
    blocks = -(-queries.limit(QUERY_BLOCK + 1).count() // QUERY_BLOCK)
    if blocks > 1:
        blocks = -(-queries.count() // (QUERY_BLOCK // 2))
    out = None
    for k in range(max(1, blocks)):
        some = queries if blocks <= 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        part = score(rows.crossJoin(F.broadcast(some)))
        out = part if out is None else out.unionByName(part)
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best of each query by exact search (query_id, id, score, rank); ``queries`` has query_id and query_vector.

    All pairs are compared, as products of matrices in each task; only the k best of a task are shuffled.
    """
    return top_k(candidates(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), queries, k), k)


def fuse(dense: DataFrame, sparse: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (query_id, id, rank)."""
    lists = [r.select("query_id", "id", (F.lit(w) / (F.lit(config.fusion_constant) + F.col("rank"))).alias("part")) for r, w in ((dense, config.dense_weight), (sparse, config.sparse_weight))]
    return lists[0].unionByName(lists[1]).groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))


def term_coverage(query: Column, text: Column) -> Column:
    """Share of the distinct query terms that the text has: the stand-in for a neural reranker."""
    asked = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def rerank(fused: DataFrame, texts: DataFrame, queries: DataFrame, n: int = DEFAULT.rerank_n) -> DataFrame:
    """The n best by coverage, then fused score, then id; ``texts`` has id and text.

    Fused lists are short, so they are written and sent to the texts, which stay where they lie; beyond
    ``FEW`` rows both are joined by shuffle.
    """
    fused = settled(fused, "fused")
    rows = texts.select("id", "text").join(sized(fused), "id").join(sized(queries.select("query_id", "query")), "query_id")
    rows = rows.withColumn("coverage", F.round(term_coverage(F.col("query"), F.col("text")), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("coverage"), F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).drop("query")


def evidence_rows(ranked: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Evidence items: snippet of the text, missing names empty, missing pages 1."""
    have = set(ranked.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    page = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(1)) if c in have else F.lit(1)
    return ranked.select("query_id", "rank", text("doc_id").alias("doc_id"), text("filename").alias("filename"), text("chunk_id").alias("chunk_id"), page("page_start").alias("page_start"), page("page_end").alias("page_end"), F.substring("text", 1, config.snippet_chars).alias("snippet"))


def evidence_block(ranked: DataFrame) -> DataFrame:
    """One text of all evidence of a query, in rank order."""
    have = set(ranked.columns)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    block = F.concat_ws("\n", F.format_string("[Evidence %d]", "rank"), F.concat(F.lit("filename: "), text("filename")), F.concat(F.lit("doc_id: "), text("doc_id")), F.concat(F.lit("chunk_id: "), text("chunk_id")), F.concat(F.lit("pages: "), text("page_start"), F.lit("-"), text("page_end")), F.concat(F.lit("doc_type: "), text("doc_type")), F.concat(F.lit("text: "), text("text")))
    parts = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda x: x["block"]), "\n\n").alias("evidence"))
