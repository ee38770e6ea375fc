"""From files to documents: pages of all formats, their fallback, entities, and the rows of an upload."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.config import DEFAULT, Config
from inkwell.functions import entities
from inkwell.functions import text as T
from inkwell.operators import documents
from inkwell.operators.draft import OcrEngine
from inkwell.sources import readers

#: The columns of raw pages, whatever file they come from.
COLUMNS = ("doc_id", "filename", "page_number", "raw_text", "confidence", "extraction_method", "has_tables", "tables", "warnings")
_TABLES = "array<array<array<string>>>"


def raw_pages(found: DataFrame, extractor=None, engine: OcrEngine | None = None) -> DataFrame:
    """Pages of workbooks, images and, with an ``extractor``, PDF files; see ``readers`` for each. Every file
    of ``found`` has pages, whose ``error`` is null, or one row that says in it why there are none."""
    rows = readers.workbook_rows(found)
    parts = [readers.sheet_pages(rows, keep=("filename", "page_number", "error")), readers.image_pages(found, engine), readers.pdf_pages(found, extractor, engine)]
    return reduce(DataFrame.unionByName, [with_defaults(part, "error") for part in parts])


def unread(raw: DataFrame, found: DataFrame) -> DataFrame:
    """Files of which ``raw_pages`` says why they have no pages, like those that were not let in."""
    return raw.where("error is not null").select("doc_id", "filename", "error").join(found.select("doc_id", "extension"), "doc_id").select("doc_id", "filename", "extension", "error")


def with_defaults(pages: DataFrame, *more: str) -> DataFrame:
    """Pages (doc_id, filename, page_number, raw_text and any others of ``COLUMNS``) with all of these."""
    missing = {"confidence": F.lit(None).cast("double"), "extraction_method": F.lit("native_text")}
    for name, kind in (("tables", _TABLES), ("warnings", "array<string>")):
        own = F.col(name) if name in pages.columns else F.lit(None)
        missing[name] = F.coalesce(own.cast(kind), F.array().cast(kind))
    pages = pages.withColumns({c: e for c, e in missing.items() if c not in pages.columns or c in ("tables", "warnings")})
    return pages.withColumn("has_tables", F.size("tables") > 0).select(*COLUMNS, *more)


#: Warnings on answers of the vision model.
NO_ANSWER = "Multimodal fallback returned no usable text"
FAILED = "Multimodal fallback failed: %s"


def vision_answers(found: DataFrame, pages: DataFrame, vision: OcrEngine, extractor=None, config: Config = DEFAULT) -> DataFrame:
    """What a vision model reads from the weak ones of recognised pages, for ``merge_fallback``: doc_id,
    page_number, raw_text, confidence, warnings. A call that fails gives no text and a warning."""
    weak = documents.clean_pages(pages.drop("warnings")).where(F.col("extraction_method").isin("ocr_scan", "ocr_image") & documents.needs_ocr_fallback(F.col("confidence"), F.col("cleaned_text"), config))
    asked = weak.groupBy("doc_id").agg(F.collect_set("page_number").alias("numbers")).join(found.select("doc_id", "extension", "content"), "doc_id")

    def run(batches):
        for frame in batches:
            out = []
            for r in frame.itertuples():
                images = [image for _, _, image in extractor(bytes(r.content))] if r.extension == ".pdf" else [bytes(r.content)]
                for n in sorted(r.numbers):
                    text, failed = "", None
                    try:
                        text = vision.read(images[n - 1])[0].strip() if images[n - 1] is not None else ""
                    except Exception as why:  # whatever the model's client raises is the page's warning
                        failed = str(why)
                    out.append((r.doc_id, n, text, failed))
            yield pd.DataFrame(out, columns=["doc_id", "page_number", "raw_text", "failed"])

    read = asked.mapInPandas(run, "doc_id string, page_number int, raw_text string, failed string")
    cleaned = T.clean(F.col("raw_text"))
    read = read.withColumn("_clean", cleaned)
    notes = F.concat(T.clean_warnings(F.col("raw_text"), F.col("_clean")), F.when(F.col("_clean") == "", F.array(F.lit(NO_ANSWER))).otherwise(F.array().cast("array<string>")))
    notes = F.when(F.col("failed").isNotNull(), F.array(F.format_string(FAILED, "failed"))).otherwise(notes)
    return read.select("doc_id", "page_number", "raw_text", T.text_confidence(F.col("_clean")).alias("confidence"), notes.alias("warnings"))


def finished_pages(pages: DataFrame, answers: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """Cleaned pages with all their warnings: the cleaner's, then the source's, then that of the vision
    fallback's ``answers``, and that a page has next to no text (pages of PDF files)."""
    own = pages.withColumnRenamed("warnings", "_noted")
    out = documents.clean_pages(own)
    out = out.withColumn("warnings", F.concat("warnings", "_noted")).drop("_noted")
    if answers is not None:
        out = documents.merge_fallback(out, answers, config)
    return documents.flag_short_pages(out, config, F.lower("filename").endswith(".pdf"))


def file_methods(pages: DataFrame) -> DataFrame:
    """(doc_id, extraction_method) of whole files: of a PDF by its native and recognised pages, of others
    that of their pages."""
    native, pdf = F.col("extraction_method") == "native_text", F.col("filename").rlike(r"(?i)\.pdf\z")
    counted = pages.groupBy("doc_id").agg(F.count_if(native).alias("native"), F.count_if(~native).alias("scanned"), F.bool_or(pdf).alias("pdf"), F.min_by("extraction_method", "page_number").alias("first"))
    return counted.select("doc_id", F.when(F.col("pdf"), documents.extraction_method(F.col("native"), F.col("scanned"))).otherwise(F.col("first")).alias("extraction_method"))


def document_rows(pages: DataFrame, found: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Documents from finished pages and the files they are of."""
    of_files = found.select("doc_id", "filename", F.regexp_replace("extension", "^[.]", "").alias("file_type"), F.col("length").alias("file_size_bytes"))
    named = pages if "filename" in pages.columns else pages.join(of_files.select("doc_id", "filename"), "doc_id")
    return documents.process(pages, config).join(file_methods(named), "doc_id").join(of_files, "doc_id").withColumn("processed_at", F.current_timestamp())


def entity_rows(pages: DataFrame) -> DataFrame:
    """The entities of documents, each once."""
    kept = entities.first_of_each(entities.extract(pages), readers.parts_of(pages, 1))
    return kept.select("doc_id", F.col("ord").cast("int").alias("ord"), "entity_type", "value", "normalized", F.col("page").cast("int").alias("page"), F.round("confidence", 3).alias("confidence"))


def upload_rows(docs: DataFrame, chunks: DataFrame, found_entities: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """What an upload answers for each document: its attributes and any ``more`` of them, and counts of pages,
    chunks and entities."""
    n = lambda rows, name: rows.groupBy("doc_id").agg(F.count("*").alias(name))
    out = docs.join(n(chunks, "chunk_count"), "doc_id", "left").join(n(found_entities, "entity_count"), "doc_id", "left")
    return out.select(
        "doc_id", "filename", F.lit("processed").alias("status"), F.lit("File processed successfully").alias("message"), "quality_score", "doc_type", "total_pages", "avg_confidence",
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.transform("warnings", lambda w: w["message"]).alias("warnings"), *more,
    )
