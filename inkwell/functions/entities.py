"""Entity extraction by patterns, with normal forms and first-occurrence deduplication."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.functions.text import is_ascii, strip

#: Patterns of each type, in order; all ignore case.
PATTERNS = {
    "date": [
        r"\b(\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4})\b",
        r"\b(\d{4}[\/\-]\d{1,2}[\/\-]\d{1,2})\b",
        r"\b(\w+ \d{1,2},\s*\d{4})\b",
        r"\b(\d{1,2}(?:st|nd|rd|th)? (?:day of )?\w+ \d{4})\b",
        r"\b(\d{1,2} \w+ \d{4})\b",
    ],
    "amount": [
        r"\$\s*[\d,]+(?:\.\d{2})?",
        r"USD\s*[\d,]+(?:\.\d{2})?",
        r"[\d,]+(?:\.\d{2})?\s*dollars?",
    ],
    "case_number": [
        r"(?:Case\s*(?:No\.?|Number)\s*[:.]?\s*)([\w\-/]+)",
        r"(?:Docket\s*(?:No\.?|#)\s*[:.]?\s*)([\w\-/]+)",
        r"\b(\d{2}-[A-Z]{2}-\d{4,6})\b",
        r"\b([A-Z]{2}\s*\d{4,8})\b",
    ],
    "party": [
        r"(?:between|by and between)\s+([A-Z][A-Za-z ,.'-]{3,60}?)\s+(?:and|,)",
        r"(?:Plaintiff|Petitioner)[,:]?\s+([A-Z][A-Za-z ,.'-]{3,60})",
        r"(?:Defendant|Respondent)[,:]?\s+([A-Z][A-Za-z ,.'-]{3,60})",
        r"(?:Landlord|Lessor)[,:]?\s+([A-Z][A-Za-z ,.'-]{3,60})",
        r"(?:Tenant|Lessee)[,:]?\s+([A-Z][A-Za-z ,.'-]{3,60})",
        r"(?:Grantor|Grantee)[,:]?\s+([A-Z][A-Za-z ,.'-]{3,60})",
    ],
    "address": [
        r"\d{1,5}\s+\w[\w\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Place|Pl|Way|Circle|Cir)(?:\.)?(?:\s+(?:Suite|Ste|Apt|Unit|#)\s*[\w\d]+)?(?:,\s*[\w\s]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)?",
    ],
}
#: For each pattern, in the same order, what a text must have one of for it to match; none: any text.
NEEDS = {
    "date": [("/", "-"), ("/", "-"), (",",), (), ()],
    "amount": [("$",), ("usd",), ("dollar",)],
    "case_number": [("case",), ("docket",), ("-",), ()],
    "party": [("between",), ("plaintiff", "petitioner"), ("defendant", "respondent"), ("landlord", "lessor"), ("tenant", "lessee"), ("grantor", "grantee")],
    "address": [()],
}
#: For each pattern, in the same order, a cheaper one that is found wherever it is; none: it is cheap itself.
BEFORE = {
    "date": [r"\d[\/\-]\d", r"\d[\/\-]\d", r" \d{1,2},", r" \d{4}", r" \d{4}"],
    "amount": [None, None, None],
    "case_number": [None, None, r"-\d{4}", r"\d{4}"],
    "party": [None] * 6,
    "address": [None],
}
#: Patterns that begin with a digit at a word's boundary look for the digit first.
_DIGIT = r"\b(\d"
#: Types whose patterns have a group that is the value.
GROUPED = {"date", "case_number", "party"}


def plain_case(text: Column, ascii: Column | None = None) -> Column:
    """Lower case as patterns that ignore case see it: four letters equal ASCII ones for them."""
    ascii = is_ascii(text) if ascii is None else ascii
    return F.when(ascii, F.lower(text)).otherwise(F.lower(F.translate(text, "\u017f\u0130\u0131\u212a", "siik")))


def found(text: Column, kind: str, low: Column, ascii: Column | None = None) -> Column:
    """Values of a type, pattern by pattern, stripped, without empty ones; ``low`` is ``plain_case`` of the
    text, which a plain search of spares most patterns, and ``ascii`` says that it is ASCII: there Java's plain
    classes, which are cheaper, are those of Unicode, and a pattern that begins with a digit needs none before it."""
    group, none = 1 if kind in GROUPED else 0, F.array().cast("array<string>")
    ascii = is_ascii(text) if ascii is None else ascii
    either = lambda make: F.when(ascii, make("")).otherwise(make("U"))

    def one(pattern: str, needs: tuple[str, ...], before: str | None) -> Column:
        digit = pattern.startswith(_DIGIT)
        pattern = f"(?=\\d){pattern}" if digit else pattern
        values = F.transform(either(lambda u: F.regexp_extract_all(text, F.lit(f"(?i{u}){pattern}"), F.lit(group))), strip)
        has = ([reduce(or_, [F.contains(low, F.lit(x)) for x in needs])] if needs else []) + ([ascii | text.rlike(f"(?U){before}") if digit else either(lambda u: text.rlike(f"(?{u}){before}"))] if before else [])
        return F.when(reduce(and_, has), values).otherwise(none) if has else values

    return F.filter(F.concat(*[one(*each) for each in zip(PATTERNS[kind], NEEDS[kind], BEFORE[kind], strict=True)]), lambda v: v != "")


def amount_normal(value: Column) -> Column:
    """Dollars with two decimals, or the value itself where it is no number."""
    number = F.regexp_replace(value, r"[^\d.]", "").try_cast("double")
    return F.when(number.isNull(), value).otherwise(F.concat(F.lit("$"), F.format_number(number, 2)))


def extract(pages: DataFrame, kinds=tuple(PATTERNS), doc_col: str = "doc_id", page_col: str = "page_number", text_col: str = "cleaned_text", confidence_col: str | None = "confidence") -> DataFrame:
    """Entity mentions of the pages: doc, page, type, order of type and place, value, normalized,
    key, confidence; parties and addresses that are too short or generic are left out."""
    kinds_of = F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(name).alias("kind"), found(F.col("_text"), name, F.col("_low"), F.col("_ascii")).alias("values")) for k, name in enumerate(kinds)])
    rows = pages.select(F.col(doc_col).alias("doc_id"), F.col(page_col).alias("page"), (F.col(confidence_col) if confidence_col else F.lit(1.0)).alias("confidence"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.withColumn("_ascii", is_ascii(F.col("_text"))).withColumn("_low", plain_case(F.col("_text"), F.col("_ascii")))
    rows = rows.select("doc_id", "page", "confidence", F.explode(kinds_of).alias("k")).select("doc_id", "page", "confidence", F.col("k.kind").alias("entity_type"), F.col("k.ord").alias("kind_ord"), F.posexplode("k.values").alias("pos", "value"))
    kind, value = F.col("entity_type"), F.col("value")
    normal = F.when(kind == "amount", amount_normal(value)).when(kind.isin("date", "address"), value)
    key = F.when(kind == "amount", F.col("normalized")).when(kind.isin("party", "address"), F.lower(value)).otherwise(value)
    fits = ~((kind == "party") & ((F.length(value) <= 4) | F.lower(value).startswith("the "))) & ~((kind == "address") & (F.length(value) <= 10))
    return rows.where(fits).withColumn("normalized", normal).withColumn("key", key)


def first_of_each(mentions: DataFrame, parts: int | None = None) -> DataFrame:
    """One mention of each key of a document: the first by page, type, pattern and place. Mentions are
    shuffled once, by document, for both windows; ``parts`` beyond the session's number keep a task from
    growing with the input."""
    usual = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mentions = mentions.repartition(parts, "doc_id") if parts and parts > usual else mentions.repartition("doc_id")
    order = Window.partitionBy("doc_id", "entity_type", "key").orderBy("page", "kind_ord", "pos")
    numbered = Window.partitionBy("doc_id").orderBy("page", "kind_ord", "pos")
    kept = mentions.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return kept.withColumn("ord", F.row_number().over(numbered) - 1)
