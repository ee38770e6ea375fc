"""Joins on a key that most rows have are split by adaptive execution, in the plans that ran. Rows of one
key are alike, so they are small when compressed: the key takes many of them to stand out in bytes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from inkwell.llm import langid, quality
from inkwell.llm.exact_dedup import exact_dedup
from inkwell.llm.substring import repeated_passages

LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "12",
}


@pytest.fixture
def low(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def plan_of(out):
    rows = out.collect()
    return rows, out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("operator", [exact_dedup, repeated_passages])
def test_copies_of_most_rows_are_split(low, operator):
    rng = random.Random(1)
    copy = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    rows = [(i, copy if i % 20 else " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(12000)]
    out, plan = plan_of(operator(low.createDataFrame(rows, "doc_id long, text string").repartition(16)))
    assert sum(r.kept for r in out if r.doc_id % 20) == 1 and sum(r.doc_id % 20 > 0 for r in out) == 11400
    assert "skew=true" in plan


def test_null_ids_and_repeated_rows_meet_no_rows_but_their_own(spark):
    """4,000 texts that two rows of null id have each, and 3,000 equal rows: joined by id these would be
    millions of pairs of texts."""
    rows = [(None, f"text {i} of many words") for i in range(4000) for _ in range(2)] + [(7, "the same row")] * 3000
    out = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert len(out) == 11000 and sum(r.kept for r in out) == 4001
    assert {(r.doc_id, r.keep_id, r.group_size) for r in out} == {(None, None, 2), (7, 7, 3000)}


def test_training_rows_are_bounded_where_ids_and_rows_repeat(spark, monkeypatch):
    """One id has a third of the rows in other texts, and one row stands for another third."""
    word = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    rows = [(7, f"good words number {word(i)}", "en") for i in range(900)] + [(8, "the same row", "de")] * 900 + [(100 + i, f"words {word(i)} of a text", "en" if i % 2 else "de") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1000)] + [(7, 1)] * 500, "doc_id long, quality int")
    taken = []
    monkeypatch.setattr(quality, "train", lambda texts, marks, epochs: taken.append((texts, marks.tolist())))
    for k in (40, 40, 4000):
        quality.train_quality(docs, labels, F.lit(True), rows=k)
    assert taken[0] == taken[1] and 0 < len(taken[0][0]) <= 50
    assert len(taken[2][0]) == 1801 and set(map(bytes, taken[2][0])) == {t.encode() for _, t, _ in rows}
    sizes = []
    monkeypatch.setattr(langid, "LanguageModel", lambda langs, x, y: sizes.append(len(x)))
    for k in (40, 4000):
        langid.train_languages(docs, F.lit(True), rows_per_language=k, train_rows=8000)
    assert 0 < sizes[0] <= 100 and sizes[1] == 1801
