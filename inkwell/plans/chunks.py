"""Queries on pages, chunks, sheets and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.operators import chunk as C
from inkwell.plans import inputs
from inkwell.sources import readers


def _bounds(spark, sf):
    return C.page_bounds(inputs.source_pages(spark, sf))


def page_bounds(spark, sf):
    b = _bounds(spark, sf)
    return b.select("doc_id", F.col("page_number").cast("long").alias("page_number"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


def char_to_page(spark, sf):
    """Pages of a probe every 997 characters, in gaps and beyond the end too."""
    b = C.bounds_array(_bounds(spark, sf))
    probes = b.select("doc_id", "bounds", F.explode(F.sequence(F.lit(-5).cast("long"), F.element_at("bounds", -1)["char_end"].cast("long") + 2000, F.lit(997).cast("long"))).alias("at"))
    return probes.select("doc_id", "at", C.char_to_page(F.col("at"), F.col("bounds")).cast("long").alias("page_number"))


def _one_long(spark, sf):
    """All documents as the pages of one."""
    docs = readers.parquet(spark, sf, "documents")
    return docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("doc_id").alias("page_number"), F.col("text").alias("cleaned_text"))


def page_bounds_long(spark, sf):
    return C.page_bounds_long(_one_long(spark, sf))


def char_to_page_join(spark, sf):
    """Pages of places at the edges and in the middle of all pages, and between them, in one long document."""
    b = C.page_bounds_long(_one_long(spark, sf))
    at = F.array(F.col("char_start") - 1, F.col("char_start"), F.floor((F.col("char_start") + F.col("char_end")) / 2), F.col("char_end"), F.col("char_end") + 1)
    return C.char_to_page_join(b.select("doc_id", F.explode(at).alias("at")), b)


def text_chunks(spark, sf):
    """Windows of every document."""
    docs = inputs.documents(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), F.col("text").alias("cleaned_text"))
    out = C.text_chunks(docs.withColumn("full_text", F.col("cleaned_text")), C.page_bounds(docs))
    return out.select("doc_id", "chunk_index", "text", "char_start", "char_end", "page_start", "page_end")


def text_chunks_udtf(spark, sf):
    """The same windows by a lateral join, a row at a time."""
    docs = inputs.documents(spark, sf).select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page_number"), F.col("text").alias("cleaned_text"))
    out = C.text_chunks_lateral(docs.withColumn("full_text", F.col("cleaned_text")), C.page_bounds(docs))
    return out.select("doc_id", "chunk_index", "text", "char_start", "char_end", "page_start", "page_end")


CELLS = "array('line', 'part', 'qty')"


def order_tables(spark, sf, by="l_orderkey"):
    """Tables of three columns from line items: a header and a row each."""
    items = readers.parquet(spark, sf, "lineitem")
    # A flat struct, as Spark makes the order of a nested one again for each comparison.
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = items.groupBy(F.col(by).alias("doc_id")).agg(F.sort_array(F.collect_list(key)).alias("r"))
    cells = lambda x: F.array(*[x[c].cast("int").cast("string") for c in ("l_linenumber", "l_partkey", "l_quantity")])
    return rows.select("doc_id", F.lit(1).alias("page_number"), F.lit(0).alias("table_index"), F.concat(F.array(F.expr(CELLS)), F.transform("r", cells)).alias("rows"))


def _long(df):
    return df.select(*[F.col(f.name).cast("long").alias(f.name) if f.dataType.typeName() == "integer" else F.col(f.name) for f in df.schema.fields])


def table_chunks_rows(spark, sf):
    return _long(C.table_blocks(order_tables(spark, sf)).drop("page_number", "table_index", "header_included"))


def table_chunks_full(spark, sf):
    """Tables of hundreds of rows, one a supplier, with cells to strip and to drop."""
    t = order_tables(spark, sf, "l_suppkey")
    t = t.withColumn("rows", F.transform("rows", lambda r: F.concat(F.array(F.lit("  ")), F.transform(r, lambda c: F.concat(F.lit(" "), F.repeat(c, 12), F.lit(" "))))))
    return _long(C.table_blocks(t).drop("page_number", "table_index", "header_included"))


def sheet_pages(spark, sf):
    """A sheet for each order; empty cells and rows fall out of its text, and a sheet of only such ones is
    a page of its title."""
    items = readers.parquet(spark, sf, "lineitem")
    rows = items.select(F.col("l_orderkey").alias("doc_id"), F.lit("Lines").alias("sheet"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("row_no"), F.array(F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("l_returnflag"))), F.when(F.col("l_partkey") % 5 != 0, F.col("l_linestatus"))).alias("cells"))
    rows = rows.withColumn("cells", F.when(F.col("row_no.l_linenumber") == 3, F.array(F.lit(" "), F.lit(None).cast("string"))).otherwise(F.col("cells")))
    return readers.sheet_pages(rows).select("doc_id", "raw_text", F.size(F.flatten("tables")).cast("long").alias("n_rows"), "confidence", F.array_join("warnings", ";").alias("warnings"))


def chunk_flatten(spark, sf):
    """Index rows of text chunks (every second order has one) and of the table chunks after them."""
    t = order_tables(spark, sf)
    legal = inputs.legal_docs(spark, sf).where("doc_id % 2 = 0")
    text = legal.select("doc_id", F.lit(0).alias("chunk_index"), "text", F.lit(0).alias("char_start"), F.length("text").alias("char_end"), F.lit(1).alias("page_start"), F.lit(1).alias("page_end"))
    text = text.withColumn("chunk_id", C.chunk_id("text"))
    bounds = t.where("doc_id % 3 = 0").select("doc_id", F.lit(1).alias("page_number"), (F.col("doc_id") % 7).alias("char_start"))
    tables = C.table_chunks(t, bounds, text.groupBy("doc_id").agg(F.count("*").alias("n")))
    docs = t.select("doc_id", F.concat(F.lit("order-"), "doc_id").alias("filename"), F.lit("xlsx").alias("file_type"), F.lit("unknown").alias("doc_type"))
    flat = C.flatten(C.all_chunks(text, tables), docs, "s1")
    return _long(flat.select("chunk_id", "doc_id", "filename", "file_type", "session_id", "chunk_index", "char_start", "char_end", "page_start", "page_end", "chunk_chunk_kind", "chunk_table_row_count", "chunk_char_count", "chunk_word_count"))


def session_documents(spark, sf):
    """The documents (orders) of each session (customer), in order of arrival."""
    orders = readers.parquet(spark, sf, "orders")
    listed = orders.groupBy(F.col("o_custkey").alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("o"))
    return listed.select("session_id", F.array_join(F.transform("o", lambda x: x["o_orderkey"]), ",").alias("document_ids"), F.size("o").cast("long").alias("n"))


def get_many(spark, sf):
    """Documents by lists of ids, some of which are missing."""
    docs = readers.parquet(spark, sf, "documents").select("doc_id", "source")
    lists = readers.parquet(spark, sf, "orders").select("o_orderkey", F.array(F.col("o_orderkey") % 700, F.lit(10**9), (F.col("o_orderkey") * 7) % 1500).alias("ids"))
    return readers.in_order_of(lists, docs, "ids", "doc_id").select("o_orderkey", F.col("pos").cast("long").alias("pos"), "doc_id", "source")


QUERIES = {f.__name__: f for f in (page_bounds, char_to_page, page_bounds_long, char_to_page_join, text_chunks, text_chunks_udtf, table_chunks_rows, table_chunks_full, sheet_pages, chunk_flatten, session_documents, get_many)}

_D_BOUNDS = f"""b AS (SELECT doc_id, page_number, coalesce(sum(length(cleaned_text) + 2) OVER (PARTITION BY doc_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, length(cleaned_text) AS n FROM ({inputs.PAGES}) WHERE regexp_matches(cleaned_text, '\\S')),
    bounds AS (SELECT doc_id, page_number::BIGINT AS page_number, char_start, char_start + n - 1 AS char_end FROM b)"""
_D_LONG = """b AS (SELECT CAST(0 AS BIGINT) AS doc_id, doc_id AS page_number, coalesce(sum(length(text) + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start, length(text) AS n FROM documents WHERE regexp_matches(text, '\\S')),
    bounds AS (SELECT doc_id, page_number, char_start, char_start + n - 1 AS char_end FROM b)"""
_D_BLOCKS = """cells AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k,
                     l_linenumber || ' | ' || l_partkey || ' | ' || CAST(l_quantity AS INT) AS cells FROM lineitem),
    blocks AS (SELECT *, (k - 1) // 12 AS block, CASE WHEN k <= 12 THEN 1 ELSE ((k - 1) // 12) * 12 + 2 END AS start, (k - 1) % 12 AS off FROM cells),
    done AS (SELECT doc_id, block, start, count(*) AS n, 'Table block on page 1' || chr(10) || 'Table 1' || chr(10) || 'Columns: line | part | qty' || chr(10) || string_agg('Row ' || (start + off) || ': ' || cells, chr(10) ORDER BY k) AS text FROM blocks GROUP BY doc_id, block, start)"""
_R12 = "repeat(CAST({} AS VARCHAR), 12)"
_HEAD = f"'Table block on page 1' || chr(10) || 'Table 1' || chr(10) || 'Columns: ' || {' || chr(32) || chr(124) || chr(32) || '.join(_R12.format(repr(c)) for c in ('line', 'part', 'qty'))}"
_D_FULL = f"""
    WITH RECURSIVE items AS (
        SELECT l_suppkey AS doc_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i,
               {_R12.format('l_linenumber')} || ' | ' || {_R12.format('l_partkey')} || ' | ' || {_R12.format('CAST(l_quantity AS INT)')} AS cells FROM lineitem),
    f AS (
        SELECT doc_id, i, cells, CAST(0 AS BIGINT) AS block, CAST(1 AS BIGINT) AS label, CAST(1 AS BIGINT) AS n, length({_HEAD}) + 8 + length(cells) AS len FROM items WHERE i = 0
        UNION ALL
        SELECT doc_id, i, cells, CASE WHEN opens THEN block + 1 ELSE block END, CASE WHEN opens THEN i + 2 ELSE label END, CASE WHEN opens THEN 1 ELSE n + 1 END,
               CASE WHEN opens THEN length({_HEAD}) + 7 + length(CAST(i + 2 AS VARCHAR)) + length(cells) ELSE grown END
        FROM (SELECT *, n + 1 > 12 OR grown > 2000 AS opens
              FROM (SELECT x.doc_id, x.i, x.cells, block, label, n, len + 7 + length(CAST(label + n AS VARCHAR)) + length(x.cells) AS grown FROM f JOIN items x ON x.doc_id = f.doc_id AND x.i = f.i + 1)))
    SELECT doc_id, block, {_HEAD} || chr(10) || string_agg('Row ' || (label + n - 1) || ': ' || cells, chr(10) ORDER BY i) AS text, label AS table_row_start, label + count(*) - 1 AS table_row_end, count(*) AS table_row_count, CAST(3 AS BIGINT) AS table_column_count
    FROM f GROUP BY doc_id, block, label"""
ORACLE = {
    "page_bounds": f"WITH {_D_BOUNDS} SELECT * FROM bounds",
    "char_to_page": f"""WITH {_D_BOUNDS}, ends AS (SELECT doc_id, max(char_end) AS last_end, max(page_number) AS last_page, min(page_number) AS first_page, min(char_start) AS first_start FROM bounds GROUP BY doc_id),
        probes AS (SELECT *, unnest(range(-5, last_end + 2001, 997)) AS at FROM ends)
        SELECT p.doc_id, p.at, CASE WHEN p.at < p.first_start THEN p.first_page ELSE coalesce(b.page_number, p.last_page) END AS page_number
        FROM probes p LEFT JOIN bounds b ON b.doc_id = p.doc_id AND p.at BETWEEN b.char_start AND b.char_end""",
    "page_bounds_long": f"WITH {_D_LONG} SELECT * FROM bounds",
    "char_to_page_join": f"""WITH {_D_LONG}, p AS (SELECT doc_id, unnest([char_start - 1, char_start, (char_start + char_end) // 2, char_end, char_end + 1]) AS at FROM bounds)
        SELECT p.doc_id, p.at, CASE WHEN p.at < 0 THEN (SELECT min(page_number) FROM bounds) ELSE coalesce(b.page_number, (SELECT max(page_number) FROM bounds)) END AS page_number
        FROM p LEFT JOIN bounds b ON p.at BETWEEN b.char_start AND b.char_end""",
    "table_chunks_rows": f"WITH {_D_BLOCKS} SELECT doc_id, block, text, start AS table_row_start, start + n - 1 AS table_row_end, n AS table_row_count, CAST(3 AS BIGINT) AS table_column_count FROM done",
    "sheet_pages": """WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, l_extendedprice, concat_ws(' | ', l_partkey, CASE WHEN l_partkey % 2 = 0 THEN l_returnflag END, CASE WHEN l_partkey % 5 <> 0 THEN l_linestatus END) AS line, l_linenumber <> 3 AS kept FROM lineitem)
        SELECT doc_id, 'Sheet: Lines' || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_extendedprice) FILTER (kept), '') AS raw_text, count(*) FILTER (kept) AS n_rows, CAST(1.0 AS DOUBLE) AS confidence,
               CASE WHEN bool_or(kept) THEN '' ELSE 'Sheet ''Lines'' is empty' END AS warnings FROM c GROUP BY doc_id""",
    "table_chunks_full": _D_FULL,
    "chunk_flatten": f"""WITH {_D_BLOCKS}, legal AS (SELECT * FROM ({inputs.LEGAL}) WHERE doc_id % 2 = 0),
        parts AS (SELECT doc_id, 'text' AS kind, CAST(0 AS BIGINT) AS chunk_index, text, CAST(0 AS BIGINT) AS char_start, CAST(NULL AS BIGINT) AS n FROM legal WHERE doc_id IN (SELECT doc_id FROM done)
                 UNION ALL SELECT doc_id, 'table', block + (1 - doc_id % 2), text, CASE WHEN doc_id % 3 = 0 THEN doc_id % 7 ELSE 0 END, n FROM done)
        SELECT sha256(doc_id || ':' || kind || ':' || chunk_index) AS chunk_id, doc_id, 'order-' || doc_id AS filename, 'xlsx' AS file_type, 's1' AS session_id, chunk_index, char_start, char_start + length(text) AS char_end, 1::BIGINT AS page_start, 1::BIGINT AS page_end,
               kind AS chunk_chunk_kind, n AS chunk_table_row_count, length(text) AS chunk_char_count, len(regexp_extract_all(text, '\\S+')) AS chunk_word_count FROM parts""",
    "session_documents": "SELECT o_custkey AS session_id, string_agg(o_orderkey, ',' ORDER BY o_orderdate, o_orderkey) AS document_ids, count(*) AS n FROM orders GROUP BY o_custkey",
    "get_many": """WITH l AS (SELECT o_orderkey, [o_orderkey % 700, 1000000000, (o_orderkey * 7) % 1500] AS ids FROM orders), x AS (SELECT o_orderkey, unnest(range(0, 3)) AS pos, unnest(ids) AS doc_id FROM l)
        SELECT o_orderkey, pos, doc_id, source FROM x JOIN documents USING (doc_id)""",
}
