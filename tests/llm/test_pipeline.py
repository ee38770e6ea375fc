from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline
from inkwell.llm.decontam import report_by_hand
from inkwell.llm.mixing import capped_targets
from inkwell.llm.quality import quality_scores
from tests.llm.test_jaccard import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_against_their_definitions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "sharding"]

    good = stages["quality classifier"](spark, docs, sf_dir).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    accepted = {r.doc_id for r in quality_scores(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == accepted and good.columns == columns

    single = stages["n-gram Jaccard join"](spark, good, sf_dir).cache()
    want = {c for _, c, _ in brute([(r.doc_id, r.text) for r in good.collect()])}
    assert {r.doc_id for r in single.collect()} == want and single.columns == columns and single.count() == len(want)

    clean = stages["benchmark decontamination"](spark, single, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in single.collect()]
    by_hand = report_by_hand(rows, [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows if not (by_hand[i][1] and 20 * by_hand[i][1] >= by_hand[i][0])}

    mixed = stages["mixing sources"](spark, clean, sf_dir).cache()
    assert mixed.columns == columns
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for r in clean.collect():
        sizes[r.source] = sizes.get(r.source, 0) + count(r.text)
    originals = {r.doc_id: r.text.split() for r in clean.collect()}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + count(r.text)
        assert r.n_chars == len(r.text) and " ".join(r.text.split()) in " ".join(originals[r.doc_id])
    names = sorted(sizes)
    for s, t in zip(names, capped_targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])):
        assert abs(taken.get(s, 0) - t) <= 0.01 * t + 20

    out = stages["sharding"](spark, mixed, sf_dir).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted((r.doc_id, r.text) for r in mixed.collect())
    for k in range(16):
        own = [r.slot for r in out if r.shard == k]
        assert sorted(own) == list(range(len(own)))


def test_rows_that_share_an_id_or_have_none_stay(spark, tmp_path):
    """Through the whole run: only copies go. Null and repeated ids name different texts."""
    rng = random.Random(4)
    text = lambda n=120: " ".join(f"w{rng.randrange(5000)}" for _ in range(n)) + "."
    near, same = text(), text()
    rows = [(None, text()) for _ in range(12)] + [(7, text()) for _ in range(5)] + [(8, near), (None, f"{near} end"), (9, same), (9, same), (10, same)]
    frames = {
        "documents": spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA),
        "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"),  # nothing to learn: all scores are 0.5 and all stay
        "benchmark": spark.createDataFrame([], "item_id long, text string"),
    }
    for t, frame in frames.items():
        frame.write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = {t for _, t in rows} - {f"{near} end"}
    assert len(whole) == 19
    assert sorted(r.text for r in out if r.text in whole) == sorted(whole) and len(out) == 19
    assert sum(r.doc_id is None for r in out) == 12 and sum(r.doc_id == 7 for r in out) == 5


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "some words", None, "s", 10)]])
def test_edges(spark, tmp_path, rows):
    for t, frame in {"documents": spark.createDataFrame(rows, SCHEMA), "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"), "benchmark": spark.createDataFrame([], "item_id long, text string")}.items():
        frame.write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 3 * len(rows)
