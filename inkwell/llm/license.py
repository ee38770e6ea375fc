"""License scans by canonical digest: whole texts, and whole lines, joined to known licences."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import bound_batches, column_of, sized
from inkwell.llm.license_data import FIRST_WORDS, LICENCES, LONG_LICENCES, SPELLINGS

BROADCAST_ROWS = 50_000
#: A copyright statement before a licence's first words goes up to these.
STATEMENT = r"(?:copyright\b|©|\(c\)).{0,200}?[0-9]{4}.{0,200}?\b(" + "|".join(FIRST_WORDS) + r")\b"
_STATEMENT = re.compile(STATEMENT)
#: Any other copyright line goes as a whole: it begins so and names a year or a mark.
_COPYRIGHT = re.compile(r"^[^\w©]*(?:copyright\b|©|\(c\)).*(?:©|\(c\)|\d{4}|copyright).*$|^all rights reserved\.?$")
_NO_WORD = re.compile(r"[^\w\n]+|_+")
_SPELLED = re.compile(r"\b(" + "|".join(re.escape(a) for a, _ in sorted(SPELLINGS, key=lambda x: -len(x[0]))) + r")\b")
_EQUAL = dict(SPELLINGS)


#: A text without any of these is spelled as it is.
_SIGNS = ("licence", "license", "infring", "commercial", "acknowledg", "commons", "attribution", "holder")
#: No spelling shrinks a text by more.
_SHRINK = max(len(a) / len(b) for a, b in SPELLINGS)


def _spell(text: str) -> str:
    return _SPELLED.sub(lambda m: _EQUAL[m[0]], text) if any(s in text for s in _SIGNS) else text


def canonical_lines(text: str) -> list[str]:
    """Each line in lower case, copyright lines empty, copyright statements on a licence's own line
    gone, runs of anything but letters and digits as one space."""
    text = text.lower()
    if "copyright" in text or "©" in text or "(c)" in text or "rights" in text:
        lines = (_STATEMENT.sub(r"\1", x, count=1) for x in text.split("\n"))
        text = "\n".join("" if _COPYRIGHT.match(x.strip()) else x for x in lines)
    return [" ".join(x.split()) for x in _NO_WORD.sub(" ", text).split("\n")]


def canonical(text: str) -> str:
    """All lines as one, equal spellings as one."""
    return _spell(" ".join(x for x in canonical_lines(text) if x))


def digest(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def built_in() -> list[tuple[str, int, str]]:
    """Name, canonical length and digest of the built-in texts, also as they are on a single line, and of
    the long licences, whose digests are all that is kept."""
    texts = {(name, canonical(t)) for name, text in LICENCES for t in (text, " ".join(text.split()))}
    return sorted({(name, len(t), hashlib.sha256(t.encode()).hexdigest()) for name, t in texts} | set(LONG_LICENCES))


def known_licences(spark) -> DataFrame:
    """license and digest of each known text, distinct."""
    return spark.createDataFrame([(name, d) for name, _, d in built_in()], "license string, digest string")


def _digests(id_type: str, sizes: frozenset):
    """Digests of the whole text and of its lines, where some licence has their canonical length."""
    longest = max(sizes, default=0) * _SHRINK

    def run(batches):
        for batch in batches:
            take, scope, place, found = [], [], [], []
            for i, text in enumerate(column_of(batch, "_text").to_pylist()):
                lines = canonical_lines(text or "")
                units = [("line", k, x) for k, x in enumerate(lines, 1) if 0 < len(x) <= longest] if len(lines) > 1 else []
                if sum(map(len, lines)) <= longest:
                    units.append(("document", 0, " ".join(x for x in lines if x)))
                for kind, k, x in units:
                    if len(x := _spell(x)) in sizes:
                        take.append(i)
                        scope.append(kind)
                        place.append(k)
                        found.append(hashlib.sha256(x.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([column_of(batch, "_id").take(pa.array(take, pa.int64())), pa.array(scope, pa.string()), pa.array(place, pa.int64()), pa.array(found, pa.string())], names=["_id", "scope", "line", "digest"])

    return run, f"_id {id_type}, scope string, line long, digest string"


def license_scan(docs: DataFrame, licences: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each known licence that a text is, or that a line of it is: id, scope, line, license.

    ``licences`` has columns ``license`` and ``text``; without it the built-in ones are taken. ``scope``
    is ``document`` (line 0) for entire texts and ``line`` (from 1) for lines of longer texts. Null and
    empty texts have none; null licence texts and those without a word match nothing; repeated rows
    give repeated results; ids may be null. Lengths of known texts are sent to tasks, so that few
    digests are joined; a licence in a large share of all texts is one row of the known side.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    if licences is None:
        known = known_licences(spark)
        sizes = frozenset(n for _, n, _ in built_in())
    else:
        def prepare(batches):
            for batch in batches:
                texts = [canonical(t or "") for t in column_of(batch, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([column_of(batch, "license"), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["license", "digest", "size"])

        known = licences.select(F.col("license").cast("string"), "text").mapInArrow(prepare, "license string, digest string, size long").where("size > 0").distinct()
        sizes = frozenset(r[0] for r in known.select("size").distinct().collect())
        known = known.drop("size")
    run, schema = _digests(docs.schema[id_col].dataType.simpleString(), sizes)
    units = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)
    return units.join(sized(known, known.count(), BROADCAST_ROWS), "digest").select(F.col("_id").alias(id_col), "scope", "line", "license")


def oracle() -> str:
    """The same scan of ``documents`` for the built-in licences, in DuckDB SQL."""
    def plain(x):
        x = f"trim(regexp_replace({x}, '[^\\pL\\pN]+', ' ', 'g'))"
        for a, b in sorted(SPELLINGS, key=lambda v: -len(v[0])):
            x = f"trim(regexp_replace({x}, '\\b{a}\\b', '{b}', 'g'))"
        return x

    values = ", ".join(f"('{name}', '{d}')" for name, _, d in built_in())
    said = STATEMENT.replace("'", "''")
    mark = "'^[^a-z0-9_©]*(?:copyright\\b|©|\\(c\\)).*(?:©|\\(c\\)|[0-9]{4}|copyright).*$|^all rights reserved\\.?$'"
    return f"""
        WITH known(license, digest) AS (VALUES {values}),
        parts AS (SELECT doc_id, string_split(lower(text), chr(10)) AS p FROM documents),
        lines AS (SELECT doc_id, len(p) AS n, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS t FROM parts),
        said AS (SELECT doc_id, n, line, regexp_replace(t, '{said}', '\\1') AS t FROM lines),
        clean AS (SELECT doc_id, n, line, CASE WHEN regexp_matches(trim(t), {mark}) THEN '' ELSE t END AS t FROM said),
        units AS (SELECT doc_id, 'line' AS scope, line, {plain("t")} AS u FROM clean WHERE n > 1
                  UNION ALL
                  SELECT doc_id, 'document', 0, {plain("string_agg(t, ' ' ORDER BY line)")} FROM clean GROUP BY doc_id)
        SELECT doc_id, scope, line, license FROM units JOIN known ON sha256(u) = digest"""
