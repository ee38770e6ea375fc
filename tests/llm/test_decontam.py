from __future__ import annotations

from inkwell.llm.decontam import decontamination_report, drop_contaminated, report_by_hand

DOCS = "doc_id long, text string, n_hit string, items int"
ITEMS = "item_id long, text string, extra int"

LONG = " ".join(f"w{i}" for i in range(40))
CASES = [
    (1, f"before {LONG.upper()}. after"),
    (2, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"),  # one word short of a window
    (3, "x, w3;w4-w5 w6\nw7 w8 w9 w10 w11 w12 w13 w14 w15 y"),
    (4, None),
    (5, ""),
    (6, "Été à la plage! " * 30),
    (7, "a a a a a a a a a a a a a a a"),
    (None, "short item"),
    (8, "filler " * 3000 + "short item"),  # under a twentieth
    (9, "short item " * 2),
    (9, "short item " * 2),
    (10, "shortitem shorts item ©short item"),
]
BENCH = [(1, LONG), (2, "été À la"), (3, "short item"), (3, "short item"), (10, "Short, ITEM"), (4, None), (5, "!!"), (None, "a a a a a a a a a a a a a a"), (6, "never here at all")]


def run(spark, docs, items, **options):
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    return decontamination_report(frame, bench, **options), drop_contaminated(frame, bench, **options)


def test_against_brute_force(spark):
    want = report_by_hand(CASES, BENCH)
    for options in ({}, {"block_bytes": 30}):
        report, clean = run(spark, CASES, BENCH, **options)
        rows = report.collect()
        assert len(rows) == len(CASES)
        for r in rows:
            assert (r.n_words, r.n_hit, r.items_sha256, r.n_items) == want[r.doc_id], r
            assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
            assert sum(e - b for b, e in zip(r.spans[::2], r.spans[1::2])) == r.n_hit
        assert clean.columns == ["doc_id", "text", "n_hit", "items"]
        by_hand = sorted(i for i, _ in CASES if not (want[i][1] and 20 * want[i][1] >= want[i][0]))  # letters with and without accents differ; © is part of a word
        assert sorted(r.doc_id for r in clean.collect()) == by_hand == [2, 4, 5, 6, 8, 10]


def test_empty_tables(spark):
    report, clean = run(spark, [], BENCH)
    assert report.count() == 0 and clean.count() == 0
    report, clean = run(spark, CASES, [])
    assert report.where("n_hit > 0 or n_items > 0").count() == 0 and clean.count() == len(CASES)


def test_window_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    some = [tuple(r) for r in docs.select("doc_id", "text").limit(25).collect()]
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    want = report_by_hand(some, items)
    for r in decontamination_report(docs.join(spark.createDataFrame(some, "doc_id long, t string"), "doc_id"), bench).collect():
        assert (r.n_words, r.n_hit, r.items_sha256, r.n_items) == want[r.doc_id]
