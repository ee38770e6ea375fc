"""From pages to documents: confidence, warnings, quality and fallback, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.config import DEFAULT, Config
from inkwell.functions import text as T
from inkwell.functions.classify import DOMAIN_LEXICON, classify

#: Messages.
LOW_CONFIDENCE = "Average extraction confidence is low (%d%%). Review extracted text carefully."
UNKNOWN_TYPE = "Could not determine document type. Classification keywords may be absent."
NO_TEXT = "No usable text could be extracted from this document."
FALLBACK_USED = "Used multimodal LLM fallback because OCR was empty, low-confidence, or too short"
FALLBACK_KEPT = "Multimodal LLM fallback was attempted, but the original OCR output was retained"
LITTLE_TEXT = "Page %d: very little text (%d words) — may be blank, a diagram, or a failed extraction"


def clean_pages(pages: DataFrame, composed: bool = False) -> DataFrame:
    """Adds cleaned_text, word_count, warnings, and confidence where the page has none of its own."""
    raw = F.coalesce(F.col("raw_text"), F.lit(""))
    own = F.col("confidence") if "confidence" in pages.columns else F.lit(None).cast("double")
    out = pages.withColumn("cleaned_text", T.clean(raw, composed))
    return out.withColumns({"warnings": T.clean_warnings(raw, F.col("cleaned_text")), "word_count": T.word_count(F.col("cleaned_text")), "confidence": F.coalesce(own, T.text_confidence(F.col("cleaned_text")))})


def flag_short_pages(pages: DataFrame, config: Config = DEFAULT, which: Column | None = None) -> DataFrame:
    """A further warning on pages (those ``which`` says) with next to no text."""
    note = F.format_string(LITTLE_TEXT, F.col("page_number"), F.col("word_count"))
    short = F.length(T.strip(F.col("cleaned_text"))) < config.least_page_chars
    short = short if which is None else short & which
    return pages.withColumn("warnings", F.when(short, F.array_append("warnings", note)).otherwise(F.col("warnings")))


def needs_ocr_fallback(confidence: Column, cleaned: Column, config: Config = DEFAULT) -> Column:
    return (confidence < config.low_confidence) | (F.length(T.strip(cleaned)) < config.least_page_chars)


def merge_fallback(pages: DataFrame, answers: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pages after the vision fallback; ``answers`` has doc_id, page_number, raw_text, confidence and
    warnings of the pages that were tried. A better answer replaces a weak page's text."""
    tried = answers.select("doc_id", "page_number", F.col("raw_text").alias("f_raw"), T.clean(F.coalesce("raw_text", F.lit(""))).alias("f_clean"), F.col("confidence").alias("f_conf"), F.col("warnings").alias("f_warn"))
    rows = pages.join(tried, ["doc_id", "page_number"], "left")
    weak = needs_ocr_fallback(F.col("confidence"), F.col("cleaned_text"), config) & F.col("f_clean").isNotNull()
    answered = weak & (F.col("f_clean") != "")
    longer = F.length(T.strip(F.col("f_clean"))) > F.length(T.strip(F.col("cleaned_text")))
    better = answered & (longer | (F.col("f_conf") > F.col("confidence")) | T.is_blank(F.col("cleaned_text")))
    pick = lambda new, old: F.when(better, new).otherwise(F.col(old))
    own = F.coalesce("f_warn", F.array().cast("array<string>"))
    notes = F.when(better, F.concat("warnings", F.array(F.lit(FALLBACK_USED)), own)).when(answered, F.concat("warnings", F.array(F.lit(FALLBACK_KEPT)), own)).when(weak, F.concat("warnings", own)).otherwise(F.col("warnings"))
    changed = {"raw_text": pick(F.col("f_raw"), "raw_text"), "cleaned_text": pick(F.col("f_clean"), "cleaned_text"), "confidence": pick(F.greatest("confidence", "f_conf"), "confidence"), "word_count": pick(T.word_count(F.col("f_clean")), "word_count"), "extraction_method": pick(F.lit("multimodal_llm"), "extraction_method"), "warnings": notes}
    return rows.select(*[changed.get(c, F.col(c)).alias(c) for c in pages.columns])


def extraction_method(native: Column, scanned: Column) -> Column:
    """Of a whole file, from its page counts."""
    return F.when(native == 0, "ocr_scan").when(scanned == 0, "native_text").otherwise("hybrid")


def word_confidence(words: DataFrame) -> DataFrame:
    """Mean confidence and text of recognised words of a page; -1 marks no word."""
    real = (F.col("conf") >= 0) & ~T.is_blank(F.col("text"))
    return words.groupBy("doc_id", "page_number").agg(F.coalesce(F.round(F.avg(F.when(real, F.col("conf"))) / 100, 3), F.lit(0.0)).alias("confidence"))


def quality_score(confidence: Column, usable_ratio: Column, n_warnings: Column) -> Column:
    raw = confidence * 0.5 + usable_ratio * 0.3 + (F.lit(0.2) - F.least(n_warnings * 0.05, F.lit(0.2)))
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 3)


def assemble(pages: DataFrame, config: Config = DEFAULT, blank_pages: bool = False) -> DataFrame:
    """One row a document: full text, mean confidence, weak pages, page warnings, usable-page ratio.

    A document's pages meet in one row; that is as large as the file was. The full text leaves blank pages
    out; with ``blank_pages`` it has them too, and is null where no page has a text.
    """
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "cleaned_text", "confidence", "warnings")))
    docs = pages.groupBy("doc_id").agg(
        ordered.alias("p"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("avg_confidence"),
        F.count("*").cast("int").alias("total_pages"),
        (F.count_if(F.length(T.strip(F.col("cleaned_text"))) >= config.least_page_chars) / F.greatest(F.count("*"), F.lit(1))).alias("usable_ratio"),
    )
    texts = F.transform("p" if blank_pages else F.filter("p", lambda x: ~T.is_blank(x["cleaned_text"])), lambda x: x["cleaned_text"])
    full = F.array_join(texts, "\n\n", "")
    if blank_pages:
        full = F.when(F.exists(texts, lambda x: x.isNotNull()), full)
    return docs.select(
        "doc_id", "avg_confidence", "total_pages", "usable_ratio",
        full.alias("full_text"),
        F.transform(F.filter("p", lambda x: x["confidence"] < config.low_confidence), lambda x: x["page_number"]).alias("low_confidence_pages"),
        F.flatten(F.transform("p", lambda x: F.transform(x["warnings"], lambda w: F.struct(F.lit("PAGE_WARNING").alias("code"), w.alias("message"), x["page_number"].cast("int").alias("page"))))).alias("page_warnings"),
    )


def document_warnings(config: Config = DEFAULT) -> Column:
    """In order: low confidence, unknown type, page warnings, no text."""
    one = lambda when, code, message: F.when(when, F.array(F.struct(F.lit(code).alias("code"), message.alias("message"), F.lit(None).cast("int").alias("page")))).otherwise(F.array().cast("array<struct<code:string,message:string,page:int>>"))
    return F.concat(
        one(F.col("avg_confidence") < config.low_confidence, "LOW_OVERALL_CONFIDENCE", F.format_string(LOW_CONFIDENCE, F.bround(F.col("avg_confidence") * 100).cast("int"))),
        one(F.col("doc_type") == "unknown", "UNKNOWN_DOC_TYPE", F.lit(UNKNOWN_TYPE)),
        F.col("page_warnings"),
        one(T.is_blank(F.col("full_text")), "NO_TEXT_EXTRACTED", F.lit(NO_TEXT)),
    )


def process(pages: DataFrame, config: Config = DEFAULT, lexicon=DOMAIN_LEXICON) -> DataFrame:
    """Documents with type, warnings, usability and quality, from cleaned pages."""
    docs = classify(assemble(pages, config), "full_text", lexicon)
    docs = docs.withColumn("warnings", document_warnings(config))
    return docs.withColumns({
        "is_usable": ~T.is_blank(F.col("full_text")) & (F.col("avg_confidence") >= config.least_usable_confidence),
        "quality_score": quality_score(F.col("avg_confidence"), F.col("usable_ratio"), F.size("warnings")),
    }).drop("page_warnings")
