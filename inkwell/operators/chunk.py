"""Chunks: page assembly, overlapping text windows, table blocks and flat index rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from inkwell.config import DEFAULT, Config
from inkwell.functions import text as T

#: Where a text is preferably split, in order.
SEPARATORS = ("\n\nSECTION ", "\n\nSection ", "\n\nARTICLE ", "\n\nArticle ", "\n\nCLAUSE ", "\n\nClause ", "\n\nSHEET: ", "\n\nSheet: ", "\n\n", "\n", ". ", "; ", ", ", " ", "")

#: What Python strips, as windows are stripped.
PYTHON_WHITE = T.WHITE + "\x1c\x1d\x1e\x1f"


def page_bounds(pages: DataFrame) -> DataFrame:
    """First and last character of each page with text, in the document's joined text."""
    earlier = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    full = pages.where(~T.is_blank(F.col("cleaned_text"))).withColumn("_len", F.length("cleaned_text"))
    full = full.withColumn("char_start", F.coalesce(F.sum(F.col("_len") + 2).over(earlier), F.lit(0)))
    return full.select("doc_id", "page_number", "char_start", (F.col("char_start") + F.col("_len") - 1).alias("char_end"))


#: Pages of a range, and characters of a bucket, of documents of any length.
PAGE_RANGE = 1_000
CHAR_BUCKET = 4_096


def page_bounds_long(pages: DataFrame, span: int = PAGE_RANGE) -> DataFrame:
    """``page_bounds`` for documents whose pages are too many for one task: the characters of each range of
    ``span`` page numbers are counted first, combined in each task, and summed over the ranges; then pages
    are numbered within their range, whose start is known."""
    full = pages.where(~T.is_blank(F.col("cleaned_text"))).select("doc_id", "page_number", F.length("cleaned_text").cast("long").alias("_len"), F.floor(F.col("page_number") / span).alias("_range"))
    ranges = full.groupBy("doc_id", "_range").agg(F.sum(F.col("_len") + 2).alias("_chars"))
    earlier = lambda *by: Window.partitionBy("doc_id", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("doc_id", "_range", F.coalesce(F.sum("_chars").over(earlier("_range")), F.lit(0)).alias("_from"))
    inside = full.withColumn("_at", F.coalesce(F.sum(F.col("_len") + 2).over(earlier("_range", "page_number")), F.lit(0)))
    begin = F.col("_from") + F.col("_at")
    return inside.join(starts, ["doc_id", "_range"]).select("doc_id", "page_number", begin.alias("char_start"), (begin + F.col("_len") - 1).alias("char_end"))


def char_to_page_join(places: DataFrame, bounds: DataFrame, width: int = CHAR_BUCKET) -> DataFrame:
    """``places`` (doc_id, at and others) with page_number, as ``char_to_page`` has it, for documents whose
    bounds are too many for one row: a page is in each bucket of ``width`` characters that it reaches into, and
    a place meets the pages of its bucket only."""
    bucket = lambda c: F.floor(c / width)
    cut = bounds.select(F.col("doc_id").alias("_d"), "page_number", "char_start", "char_end", F.explode(F.sequence(bucket(F.col("char_start")), bucket(F.col("char_end")))).alias("_b"))
    ends = bounds.groupBy(F.col("doc_id").alias("_e")).agg(F.min("char_start").alias("_start"), F.min_by("page_number", "char_start").alias("_first"), F.max_by("page_number", "char_start").alias("_last"))
    own = (F.col("doc_id") == F.col("_d")) & (bucket(F.col("at")) == F.col("_b")) & F.col("at").between(F.col("char_start"), F.col("char_end"))
    found = places.join(cut.withColumnRenamed("page_number", "_own"), own, "left").join(ends, F.col("doc_id") == F.col("_e"), "left")
    page = F.when(F.col("at") < F.col("_start"), F.col("_first")).otherwise(F.coalesce("_own", "_last", F.lit(1)))
    return found.select(*places.columns, page.alias("page_number"))


def bounds_array(bounds: DataFrame) -> DataFrame:
    return bounds.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("char_start", "char_end", "page_number"))).alias("bounds"))


def char_to_page(at: Column, bounds: Column) -> Column:
    """The page of a character: before all the first, in a gap or after all the last, without any 1.

    ``bounds`` is sorted and does not overlap.
    """
    def halve(s, _):
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        right = F.element_at(bounds, F.greatest(middle, F.lit(1)))["char_start"] <= at
        return F.struct(F.when(right, middle).otherwise(s["lo"]).alias("lo"), F.when(right, s["hi"]).otherwise(F.greatest(s["lo"], middle - 1)).alias("hi"))

    size = F.coalesce(F.size(bounds), F.lit(0))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.greatest(size, F.lit(1)))).cast("int") + 1)
    begun = F.aggregate(steps, F.struct(F.lit(1).alias("lo"), size.alias("hi")), halve)["lo"]  # by binary search
    first, last, own = F.element_at(bounds, 1), F.element_at(bounds, -1), F.element_at(bounds, begun)
    return F.when(size <= 0, 1).when(at < first["char_start"], first["page_number"]).when(at <= own["char_end"], own["page_number"]).otherwise(last["page_number"])


def _pieces(text: str, separators) -> tuple[list[str], tuple]:
    """The text cut at the first separator that occurs, which stays at the following piece's start."""
    k = next(i for i, s in enumerate(separators) if s == "" or s in text)
    s, rest = separators[k], separators[k + 1 :]
    if not s:
        return list(text), ()
    first, *others = text.split(s)
    return [p for p in [first, *(s + o for o in others)] if p], rest


def windows_of(text: str, size: int = DEFAULT.chunk_chars, overlap: int = DEFAULT.overlap_chars, separators=SEPARATORS) -> Iterator[tuple[str, int]]:
    """Windows of at most ``size`` characters and their starts, with up to ``overlap`` in common, as they are found.

    Pieces are joined up to the size; then from the front as many go as leave at most the overlap
    and room for the next. Larger pieces are split by the remaining separators. Windows are stripped.
    """

    def walk(part: str, seps) -> Iterator[str]:
        pieces, rest = _pieces(part, seps)
        held: list[str] = []
        total = 0
        for p in pieces:
            if len(p) >= size and rest:
                yield "".join(held)
                held, total = [], 0
                yield from walk(p, rest)
                continue
            if total + len(p) > size and held:
                yield "".join(held)
                while held and (total > overlap or total + len(p) > size):
                    total -= len(held.pop(0))
            held.append(p)
            total += len(p)
        yield "".join(held)

    last, length = 0, 0
    for part in walk(text, tuple(separators)) if text else ():
        w = part.strip()
        if w:
            at = text.find(w, max(0, last + length - overlap))
            if at < 0:
                at = text.find(w, last)
            yield w, at
            last, length = at, len(w)


def split_text(text: str, size: int = DEFAULT.chunk_chars, overlap: int = DEFAULT.overlap_chars, separators=SEPARATORS) -> list[tuple[str, int]]:
    """All of ``windows_of``."""
    return list(windows_of(text, size, overlap, separators))


@F.udtf(returnType="chunk_index int, text string, start int")
class TextWindows:
    """The windows of a text as rows, for a lateral join; a text's windows are never in memory together."""

    def eval(self, text: str):
        for k, (w, at) in enumerate(windows_of(text or "")):
            yield k, w, at


def text_chunks_lateral(docs: DataFrame, bounds: DataFrame, text_col: str = "full_text") -> DataFrame:
    """``text_chunks`` for texts of so many windows that an array of them is too large."""
    rows = docs.select("doc_id", F.col(text_col).alias("_text")).lateralJoin(TextWindows(F.col("_text").outer())).select("doc_id", "chunk_index", F.struct("text", "start").alias("w"))
    return _placed(rows, bounds)


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("start", IntegerType())])))
def text_windows(texts: pd.Series) -> pd.Series:
    return pd.Series([[{"text": w, "start": s} for w, s in split_text(t or "")] for t in texts], dtype=object)


def windows(text: Column) -> Column:
    """The windows of a text, as ``text_windows`` has them. A text shorter than one is its only window; just the
    others go to Python."""
    size, text = DEFAULT.chunk_chars, F.coalesce(text, F.lit(""))
    whole = F.btrim(text, F.lit(PYTHON_WHITE))
    start = F.length(text) - F.length(F.ltrim(text, F.lit(PYTHON_WHITE)))
    none = F.array().cast("array<struct<text:string,start:int>>")
    one = F.when(whole == "", none).otherwise(F.array(F.struct(whole.alias("text"), start.alias("start"))))
    return F.when(F.length(text) < size, one).otherwise(text_windows(F.when(F.length(text) >= size, text)))


def text_chunks(docs: DataFrame, bounds: DataFrame, text_col: str = "full_text") -> DataFrame:
    """Text chunks with their character and page ranges."""
    return _placed(docs.select("doc_id", F.posexplode(windows(F.col(text_col))).alias("chunk_index", "w")), bounds)


def _placed(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """Windows with their character and page ranges."""
    rows = rows.join(bounds_array(bounds), "doc_id", "left")
    start, end = F.col("w.start"), F.col("w.start") + F.length("w.text")
    rows = rows.select("doc_id", "chunk_index", F.col("w.text").alias("text"), start.alias("char_start"), end.alias("char_end"), char_to_page(start, F.col("bounds")).cast("int").alias("page_start"), char_to_page(F.greatest(start, end - 1), F.col("bounds")).cast("int").alias("page_end"))
    return rows.withColumn("chunk_id", chunk_id("text"))


def chunk_id(kind: str) -> Column:
    """Ids that a rerun gives again."""
    return F.sha2(F.concat_ws(":", "doc_id", F.lit(kind), F.col("chunk_index")), 256)


def normalize_table(rows: Column) -> Column:
    """Stripped cells without empty ones, rows without cells dropped."""
    cells = F.transform(rows, lambda r: F.filter(F.transform(r, lambda c: T.strip(F.coalesce(c, F.lit("")))), lambda c: c != ""))
    return F.filter(cells, lambda r: F.size(r) > 0)


def table_blocks(tables: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Chunks of tables (doc_id, page_number, table_index, rows), each block under the header again.

    A block ends where one more row would exceed the row or the character limit; one fold over a
    table's rows finds them. The first block counts rows from 1, later ones from the row's place in
    the table, header included.
    """
    # A generator of one row keeps what it makes from being made again wherever it is used.
    t = tables.select(*[c for c in tables.columns if c != "rows"], F.explode(F.array(normalize_table(F.col("rows")))).alias("rows")).where(F.size("rows") > 0)
    t = t.withColumns({"head": F.concat_ws("\n", F.format_string("Table block on page %d", "page_number"), F.format_string("Table %d", F.col("table_index") + 1), F.concat(F.lit("Columns: "), F.array_join(F.element_at("rows", 1), " | "))), "n_columns": F.size(F.element_at("rows", 1))})
    alone = F.size("rows") == 1
    body = F.when(alone, F.col("rows")).otherwise(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(1))))
    t = t.select("doc_id", "page_number", "table_index", "head", "n_columns", F.explode(F.array(F.transform(body, lambda r: F.array_join(r, " | ")))).alias("cells"))
    # The fold keeps where blocks begin, and of the open one its label, rows and characters.
    state = "struct<begins:array<int>,label:int,n:int,len:int>"
    initial = F.expr(f"CAST(NULL AS {state})")
    sizes = F.transform("cells", lambda c, i: F.struct(i.alias("i"), F.length(c).alias("len")))
    width = lambda no, size: 7 + F.length(no.cast("string")) + size  # noqa: E731  a line break, the label and the cells

    def step(a, x):
        grown = a["len"] + width(a["label"] + a["n"], x["len"])
        full = a.isNull() | (a["n"] + 1 > config.table_rows) | (grown > config.chunk_chars)
        label = F.when(a.isNull(), 1).otherwise(x["i"] + 2)
        fresh = F.struct(F.concat(F.coalesce(a["begins"], F.array().cast("array<int>")), F.array(x["i"])).alias("begins"), label.alias("label"), F.lit(1).alias("n"), (F.length("head") + width(label, x["len"])).alias("len"))
        more = F.struct(a["begins"].alias("begins"), a["label"].alias("label"), (a["n"] + 1).alias("n"), grown.alias("len"))
        return F.when(full, fresh).otherwise(more)

    # Generators stand between the fold and its uses, so that it runs once a table; a block has its own rows only.
    t = t.select("doc_id", "page_number", "table_index", "head", "n_columns", "cells", F.explode(F.array(F.aggregate(sizes, initial, step)["begins"])).alias("begins"))

    def block(at, k):
        upto = F.coalesce(F.try_element_at("begins", k + 2), F.size("cells"))
        return F.struct(F.when(k == 0, 1).otherwise(at + 2).alias("start"), F.slice("cells", at + 1, upto - at).alias("own"))

    t = t.select("doc_id", "page_number", "table_index", "head", "n_columns", F.posexplode(F.transform("begins", block)).alias("block", "o"))
    lines = F.transform("o.own", lambda c, k: F.concat(F.lit("Row "), (F.col("o.start") + k).cast("string"), F.lit(": "), c))
    return t.select(
        "doc_id", "page_number", "table_index", "block",
        F.concat(F.col("head"), F.lit("\n"), F.array_join(lines, "\n")).alias("text"),
        F.col("o.start").alias("table_row_start"), (F.col("o.start") + F.size("o.own") - 1).alias("table_row_end"), F.size("o.own").alias("table_row_count"),
        F.col("n_columns").alias("table_column_count"), F.lit(True).alias("header_included"),
    )


def table_chunks(tables: DataFrame, bounds: DataFrame, text_counts: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Table chunks after the text chunks of their documents; ``text_counts`` has doc_id and n."""
    blocks = table_blocks(tables, config)
    order = Window.partitionBy("doc_id").orderBy("page_number", "table_index", "block")
    rows = blocks.join(bounds.select("doc_id", "page_number", "char_start"), ["doc_id", "page_number"], "left").join(text_counts, "doc_id", "left")
    start = F.coalesce("char_start", F.lit(0)).cast("int")
    rows = rows.withColumns({"chunk_index": (F.coalesce("n", F.lit(0)) + F.row_number().over(order) - 1).cast("int"), "char_start": start})
    return rows.withColumns({"char_end": F.col("char_start") + F.length("text"), "page_start": F.col("page_number").cast("int"), "page_end": F.col("page_number").cast("int")}).withColumn("chunk_id", chunk_id("table")).drop("n", "block", "page_number")


def all_chunks(text: DataFrame, tables: DataFrame) -> DataFrame:
    """Both kinds with one metadata struct, whose table fields are null for text."""
    null = lambda kind: F.lit(None).cast(kind)
    meta = lambda method, kind, span, t: F.struct(
        T.word_count(F.col("text")).alias("word_count"), F.length("text").alias("char_count"), F.lit(method).alias("chunk_method"), F.lit(kind).alias("chunk_kind"), span.alias("page_span"),
        *[(F.col(c) if t else null("int")).cast("int").alias(c) for c in ("table_index", "table_row_start", "table_row_end", "table_row_count", "table_column_count")],
        (F.col("header_included") if t else null("boolean")).alias("header_included"),
    )
    base = ["chunk_id", "doc_id", "text", "page_start", "page_end", "char_start", "char_end", "chunk_index"]
    a = text.select(*base, meta("langchain_recursive", "text", F.col("page_end") - F.col("page_start") + 1, False).alias("metadata"))
    return a.unionByName(tables.select(*base, meta("table_block", "table", null("int"), True).alias("metadata")))


def flatten(chunks: DataFrame, docs: DataFrame, session_id: str | None = None) -> DataFrame:
    """Index rows: chunk, its document's attributes, and metadata fields prefixed with chunk_."""
    attributes = ["filename", "file_type", "doc_type", "doc_type_confidence", "quality_score", "avg_confidence", "extraction_method", "is_usable"]
    rows = chunks.join(docs.select("doc_id", *[c for c in attributes if c in docs.columns]), "doc_id")
    fields = [F.col(f"metadata.{f.name}").alias(f"chunk_{f.name}") for f in chunks.schema["metadata"].dataType.fields]
    out = rows.select(*[c for c in rows.columns if c != "metadata"], *fields)
    return out if session_id is None else out.withColumn("session_id", F.lit(session_id))
