"""The queries opN_<name> of the training-data operators, and DuckDB SQL where SQL can state them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from inkwell.llm import cohort, negatives
from inkwell.llm import license as licenses
from inkwell.llm.common import read
from inkwell.llm.decontam import decontamination_report
from inkwell.llm.exact_dedup import exact_dedup
from inkwell.llm.jaccard import near_duplicates
from inkwell.llm.langid import identify_languages
from inkwell.llm.lm import score_texts
from inkwell.llm.mixing import mix_sources
from inkwell.llm.quality import quality_scores
from inkwell.llm.sharding import shard_by_bytes
from inkwell.llm.substring import repeated_passages
from inkwell.llm.suffix import remove_repeats


def op1_decontamination(spark, sf_dir):
    report = decontamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_ngram_jaccard(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents"))


def op3_sharding(spark, sf_dir):
    return shard_by_bytes(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_substring_dedup(spark, sf_dir):
    return repeated_passages(read(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return licenses.license_scan(read(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_language_id(spark, sf_dir):
    return identify_languages(read(spark, sf_dir, "documents"))


def op10_lm_scoring(spark, sf_dir):
    return score_texts(read(spark, sf_dir, "documents"))


def op11_cohort_retention(spark, sf_dir):
    clicks = cohort.delayed(read(spark, sf_dir, "clicks"))
    return cohort.cohort_retention(clicks, read(spark, sf_dir, "clients"), dt.datetime(2024, 2, 15))


def op12_suffix_dedup(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(negatives.relabelled(read(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_sharding": op3_sharding,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_cohort_retention": op11_cohort_retention,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

#: Words of a text as the contract of op1 takes them; RE2 reads the class by code point.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = {
    "op1_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS n
              FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        win AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
                FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
        dg AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
        hit AS (SELECT doc_id, i, n, item FROM dg JOIN win USING (n, g)),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op4_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id,
               min(doc_id) OVER w AS keep_id,
               count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept,
               sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op7_license_scan": licenses.oracle(),
    "op11_cohort_retention": cohort.oracle(),
    "op13_hard_negatives": negatives.ORACLE,
}
