"""Weighted keyword classification over a lexicon that is a parameter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import is_ascii, is_blank

#: Type, weight, keywords. Ties go to the earlier type.
DOMAIN_LEXICON = [
    ("lease_agreement", 1.5, ["lease", "tenant", "landlord", "lessor", "lessee", "monthly rent", "premises", "security deposit", "term of lease", "tenancy", "rent due", "sq ft", "square feet", "possession", "notice to quit"]),
    ("court_filing", 1.5, ["plaintiff", "defendant", "petitioner", "respondent", "case no", "case number", "docket", "court of", "superior court", "district court", "complaint", "motion", "affidavit", "declaration", "hereby ordered", "judgment", "verdict", "summons", "subpoena", "deposition"]),
    ("legal_notice", 1.2, ["notice", "hereby notified", "pursuant to", "demand", "default", "cure or quit", "notice of termination", "notice of default", "you are hereby", "within days"]),
    ("internal_memo", 1.0, ["memorandum", "memo", "to:", "from:", "re:", "subject:", "date:", "internal", "confidential", "please note", "please be advised", "as discussed", "action required", "for your review"]),
    ("contract", 1.3, ["agreement", "contract", "parties", "whereas", "consideration", "terms and conditions", "in witness whereof", "executed", "binding", "effective date", "obligations", "representations", "warranties", "indemnification", "governing law"]),
    ("title_document", 1.4, ["title", "deed", "grantor", "grantee", "convey", "property description", "metes and bounds", "parcel", "lot number", "assessor", "encumbrance", "lien", "easement", "chain of title", "abstract"]),
    ("correspondence", 0.9, ["dear", "sincerely", "yours truly", "regards", "please find", "enclosed", "attached", "in response to", "thank you for", "i am writing", "we are writing", "please contact"]),
]
#: Function words for the same scorer as a language guess.
LANGUAGE_LEXICON = [
    ("de", 1.0, ["der", "die", "das", "und", "zu", "ist", "nicht", "für", "den", "ein"]),
    ("en", 1.0, ["the", "of", "and", "in", "that", "is", "was", "for", "with", "on"]),
    ("es", 1.0, ["el", "que", "los", "una", "las", "del", "y", "se", "por", "con"]),
    ("fr", 1.0, ["le", "les", "des", "et", "une", "du", "pour", "dans", "pas", "au"]),
]


def _pattern(k: str) -> str:
    """A keyword between word boundaries. It begins with the keyword, which is cheap to look for, and looks
    back for the boundary before it."""
    return rf"(?U){k}(?<=\b{k})\b"


def _first(k: str) -> str | None:
    """The word that a keyword begins with, which is a whole word of a text wherever the keyword is; none where
    Python and Java might cut it differently."""
    m = re.match(r"\w+", k)
    plain = m and all(c.isalpha() or c.isascii() for c in m.group()) and k[m.end() : m.end() + 1].isascii()
    return m.group() if plain else None


def first_words(text: Column, keywords: list[str]) -> Column:
    """Words of the text that a keyword begins with, each once, between blanks."""
    words = F.when(is_ascii(text), F.regexp_extract_all(text, F.lit(r"\w+"), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)))
    own = F.array(*[F.lit(w) for w in sorted({_first(k) for k in keywords} - {None})]).cast("array<string>")
    return F.concat(F.lit(" "), F.array_join(F.array_intersect(words, own), " "), F.lit(" "))


def keyword_hits(text: Column, keywords: list[str], firsts: Column | None = None) -> Column:
    """Occurrences of all keywords between word boundaries; overlapping ones count each. Only texts that
    have a keyword at all, or its first word where ``firsts`` is ``first_words`` of the text, are matched with its
    pattern."""
    has = lambda k: F.contains(text, F.lit(k)) if firsts is None or not _first(k) else F.contains(firsts, F.lit(f" {_first(k)} "))
    parts = [F.when(has(k), F.regexp_count(text, F.lit(_pattern(re.sub(r"([^\w\s])", r"\\\1", k))))).otherwise(0) for k in keywords]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def classify(df: DataFrame, text_col: str = "text", lexicon=DOMAIN_LEXICON, unknown: str = "unknown", type_col: str = "doc_type", confidence_col: str = "doc_type_confidence") -> DataFrame:
    """Adds the best type and its confidence; no shuffle; a text is cut into words once, and a pattern runs for each
    keyword whose first word it has."""
    df = df.withColumn("_low", F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    score = lambda words, firsts: keyword_hits(F.col("_low"), words, firsts)
    each = lambda firsts: F.array(*[F.struct((score(words, firsts) * F.lit(weight)).cast("double").alias("score"), F.lit(-k).alias("ord"), F.lit(name).alias("type")) for k, (name, weight, words) in enumerate(lexicon)])
    # In a lambda, so that the scores are not one method of the generated code, too long to be compiled.
    scores = F.transform(F.array(first_words(F.col("_low"), [k for _, _, words in lexicon for k in words])), each)[0]
    df = df.withColumn("_scores", scores)
    best = F.array_max("_scores")
    total = F.aggregate("_scores", F.lit(0.0), lambda a, x: a + x["score"])
    none = is_blank(F.col(text_col)) | (best["score"] == 0)
    share = F.round(F.least(best["score"] / F.greatest(total, F.lit(1.0)) * 1.5, F.lit(1.0)), 3)
    return df.withColumns({type_col: F.when(none, unknown).otherwise(best["type"]), confidence_col: F.when(none, 0.0).otherwise(share)}).drop("_scores", "_low")
