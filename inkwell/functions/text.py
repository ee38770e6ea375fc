"""Text cleaning and text statistics as column expressions.

Patterns run in Java's Unicode mode, so that word, space and digit classes are those of Unicode.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
RULE_LINE = r"(?U)^\s*[_\-=]{4,}\s*$"
CONTROL_START = r"^[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: What ``\s`` is in Unicode mode.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: OCR corrections in order, then spacing at punctuation, then abbreviations. Each has, in
#: front, what a text must have for it to match; without that it is not tried. Patterns begin with what is
#: cheap to look for, and look back from there.
OCR_FIXES = [
    ("l", r"(?U)l(?<=\bl)\b", "I"),
    ("0", r"(?U)0(?<=\b0)\b", "O"),
    ("rn", None, "m"),
    ("|", None, "I"),
    ("-\n", r"-\n(?<=[a-z]-\n)(?=[a-z])", ""),
    ("\n", r"\n(?<!\n\n)(?!\n)", " "),
    ("\n\n\n", r"\n{3,}", "\n\n"),
    ("", r"[ \t]{2,}", " "),
    ("- ", r"([a-z])- ([A-Z])", "$1-$2"),
]
SPACING = [
    ("", r"(?U)\s++([.,;:!?)\]])", "$1"),
    ("", r"(?U)([.,;:!?)\]])\s+", "$1 "),
    ("(", r"(?U)\(\s+", "("),
    (")", r"(?U)\s+\)", ")"),
]
ABBREVIATIONS = [
    (r"(?iu)v \.", "v."),
    (r"(?iu)et al \.", "et al."),
    (r"(?iu)e \. g \.", "e.g."),
    (r"(?iu)i \. e \.", "i.e."),
    (r"(?iu)No \.", "No."),
    (r"(?iu)Sec \.", "Sec."),
    (r"(?iu)Art \.", "Art."),
]
#: Messages of the cleaner.
BLANK = "Empty or blank text — no content extracted"
SHORT = "Very little text extracted — page may be blank or image-only"
NOISY = "Low alpha ratio (%d%%) — output may contain OCR noise"
UPPER = "Text is mostly uppercase — may be a stylistic choice or OCR issue"


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    """The composed form of texts that are not in it; null for the others."""
    return texts.map(lambda t: None if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))


def nfc(c: Column) -> Column:
    """Canonical composition, which Spark has no function for. Only texts with other than ASCII characters
    go to Python, and only those that it changes come back."""
    return F.coalesce(_composed(F.when(~is_ascii(c), c)), c)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def replace_all(c: Column, steps) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def where_has(c: Column, part: str, change) -> Column:
    """``change`` of the texts that have ``part``, found by plain search; the others as they are. A lambda
    names the text, so that the expression does not grow with each use."""
    if not part:
        return change(c)
    return F.transform(F.array(c), lambda x: F.when(F.contains(x, F.lit(part)), change(x)).otherwise(x))[0]


def replace_where(c: Column, steps) -> Column:
    """Steps of a part, a pattern and what takes its place; without a pattern, that of the part."""
    for part, pattern, to in steps:
        c = F.replace(c, F.lit(part), F.lit(to)) if pattern is None else where_has(c, part, lambda x, p=pattern, t=to: F.regexp_replace(x, p, t))
    return c


def lookalikes(c: Column) -> Column:
    """Curly quotes, dashes, ellipsis, no-break space; soft hyphens go."""
    c = F.translate(c, "\u2018\u2019\u201c\u201d\u2013\u00a0\u00ad", "''\"\"- ")
    return F.replace(F.replace(c, F.lit("—"), F.lit("--")), F.lit("…"), F.lit("..."))


def without_noise_lines(c: Column) -> Column:
    """Drops rule lines and lines that begin with a control character."""
    lines = F.split(F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK, -1)
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(RULE_LINE) & ~x.rlike(CONTROL_START)), "\n")


def ocr_fixed(c: Column) -> Column:
    return replace_where(c, OCR_FIXES)


def spaced(c: Column) -> Column:
    return replace_where(c, SPACING)


def abbreviations(c: Column) -> Column:
    return where_has(c, " .", lambda x: replace_all(x, ABBREVIATIONS))


#: Letters with a capital of one letter that Spark's ``upper`` does not use, as it writes several.
_LOWER = "ß" + "".join(map(chr, [*range(0x1F80, 0x1F88), *range(0x1F90, 0x1F98), *range(0x1FA0, 0x1FA8), 0x1FB3, 0x1FC3, 0x1FF3]))
_CAPITAL = "ẞ" + "".join(map(str.title, _LOWER[1:]))


def upper(c: Column) -> Column:
    """Upper case letter by letter, so that a text keeps its length; letters without a capital of one letter stay."""
    each = lambda x: F.when(F.length(F.upper(x)) == F.length(x), F.upper(x)).otherwise(F.translate(x, _LOWER, _CAPITAL))
    c = F.translate(c, _LOWER[0], _CAPITAL[0])  # the frequent one
    return F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(F.array_join(F.transform(F.split(c, ""), each), ""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)\S")


def clean(c: Column, composed: bool = False) -> Column:
    """The whole cleaning; blank text becomes empty. ``composed`` says the text is in NFC already, so
    that no Python runs."""
    t = c if composed else nfc(c)
    t = abbreviations(spaced(ocr_fixed(without_noise_lines(lookalikes(t)))))
    return F.when(is_blank(c), "").otherwise(strip(where_has(t, "\n", lambda x: F.regexp_replace(x, r"(?U)[^\S\n]++(?=\n)", ""))))


def letters(c: Column) -> Column:
    return F.when(is_ascii(c), F.octet_length(F.regexp_replace(c, "[^A-Za-z]+", ""))).otherwise(F.length(F.regexp_replace(c, r"[^\p{L}]+", "")))


def alpha_ratio(c: Column) -> Column:
    return letters(c) / F.greatest(F.length(c), F.lit(1))


def upper_ratio(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{Lu}]+", "")) / F.greatest(letters(c), F.lit(1))


def space_ratio(c: Column) -> Column:
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))) / F.greatest(F.length(c), F.lit(1))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def clean_warnings(raw: Column, cleaned: Column) -> Column:
    """The cleaner's warnings, in order."""
    ratio = alpha_ratio(cleaned)
    found = [
        F.when(F.length(cleaned) < 50, SHORT),
        F.when(ratio < 0.4, F.format_string(NOISY, F.bround(ratio * 100).cast("int"))),
        F.when((upper_ratio(cleaned) > 0.85) & (F.length(cleaned) > 100), UPPER),
    ]
    return F.when(is_blank(raw), F.array(F.lit(BLANK))).otherwise(F.array_compact(F.array(*found)))


def text_confidence(cleaned: Column) -> Column:
    """0.6 of the letter ratio, and 0.4 where spaces are as frequent as in prose."""
    space = space_ratio(cleaned)
    score = alpha_ratio(cleaned) * 0.6 + F.when((space > 0.1) & (space < 0.25), 0.4).otherwise(0.0)
    return F.when(F.length(cleaned) == 0, 0.0).otherwise(F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3))


def is_scanned(c: Column, least: int = 100) -> Column:
    """A page whose native text is too short to be one."""
    return F.length(strip(F.coalesce(c, F.lit("")))) < least
