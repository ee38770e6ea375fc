"""What keeps time and memory in proportion: small batches, patterns that are cheap to look for, keys that many ask for."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from inkwell.functions import classify as C
from inkwell.functions import entities as E
from inkwell.functions import text as T
from inkwell.operators import chunk as C2
from inkwell.plans import chunks
from inkwell.sources import readers
from tests.test_index import shuffled

ODD = ["".join(map(chr, [*range(1, 0x21), 0x85, 0xA0, 0x1680, 0x180E])) + "x" + "".join(map(chr, [*range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])), *[chr(c) + "x" + chr(c) for c in (0x85, 0xA0, 0x1680, 0x2005, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000)], "", " ", "l l", "ll l.l l", "al l_ 0 00 0é 0", "a-\nb-\nc-\nD é-\nf", "x\n\n\ny\nz\n", "\nq\n", "rnrn|", "ĺ l", "état l’l", "  l 　 ", "\x1c l\x1f", "notice notice_ notices unnotice notice", "to: to:x xto:y (to:a)", "für fürs für,für"]


def rows(spark, texts=ODD):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")


def test_batches_for_python_are_bounded(spark, sf_dir):
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.unset(name)
    readers.parquet(spark, sf_dir, "documents")
    assert spark.conf.get(name) == "4m"
    spark.conf.set(name, "1m")
    readers.parquet(spark, sf_dir, "documents")
    assert spark.conf.get(name) == "1m"
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_cleaning_patterns_begin_with_what_they_look_for(spark):
    assert not [p for _, p, _ in T.OCR_FIXES if p and re.match(r"(\(\?U\))?(\\b|\(\?<)", p)]
    plain = [(r"(?U)\bl\b", "I"), (r"(?U)\b0\b", "O"), ("rn", "m"), (r"\|", "I"), (r"(?<=[a-z])-\n(?=[a-z])", ""), (r"(?<!\n)\n(?!\n)", " "), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"([a-z])- ([A-Z])", "$1-$2")]
    out = rows(spark).select("text", T.ocr_fixed(F.col("text")).alias("a"), T.replace_all(F.col("text"), plain).alias("b"), T.strip(F.col("text")).alias("c"), T.replace_all(F.col("text"), [(r"(?U)\s+\z", ""), (r"(?U)\A\s+", "")]).alias("d")).collect()
    assert [(r.text, r.a, r.c) for r in out] == [(r.text, r.b, r.d) for r in out]


def test_keyword_patterns_begin_with_the_keyword(spark):
    words = ["notice", "to:", "für", "l"]
    assert all(C._pattern(w).startswith(f"(?U){w}") for w in words)
    for w in words:
        out = rows(spark).select("text", C.keyword_hits(F.col("text"), [w]).alias("a"), F.regexp_count("text", F.lit(rf"(?U)\b{w}\b")).alias("b")).collect()
        assert [(r.text, r.a) for r in out] == [(r.text, r.b) for r in out]


def test_cheap_patterns_are_found_wherever_entities_are(spark):
    texts = ["3 March 2024", "March 3, 2024 x", "1st day of May 1999", "٣ March ٢٠٢٤", "12/5/2020 2020-1-2", "24-CV-1234", "AB 12345 ab1234", "May  3, 2024", "a 3 b 2024c", "on 12 May 20245", "kſ 1234", "x12 May 2020", "5 été 2020"]
    for kind in ("date", "case_number"):
        group = 1
        plain = F.filter(F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(f"(?iU){p}"), F.lit(group)), T.strip) for p in E.PATTERNS[kind]]), lambda v: v != "")
        out = rows(spark, texts).select("text", E.found(F.col("text"), kind, E.plain_case(F.col("text"))).alias("a"), plain.alias("b")).collect()
        assert [(r.text, r.a) for r in out] == [(r.text, r.b) for r in out]
    assert all(E.BEFORE["date"])


def test_keys_that_many_lists_ask_for_do_not_meet(spark):
    lists = spark.range(2_000).select("id", F.array(F.lit(10**9).cast("long"), F.col("id") % 5).alias("ids"))
    docs = spark.range(100).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        got = []
        assert shuffled(spark, lambda: got.extend(readers.in_order_of(lists, docs, "ids", "key").collect())) < 1_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.id, r.pos, r.v) for r in got) == [(k, 1, k % 5 * 2) for k in range(2_000)]


def test_a_task_does_not_grow_with_a_table(spark):
    table = spark.range(0, 1_000, 1, 2)
    assert readers.spread(table, table).rdd.getNumPartitions() == 4
    assert readers.parts_of(table, 4, rows=100) == 10 and readers.parts_of(table, 4) == 4
    pages = spark.createDataFrame([(k, 1, "12/5/2020 and 12/5/2020 $3") for k in range(50)], "doc_id long, page_number int, cleaned_text string")
    many, few = (E.first_of_each(E.extract(pages, confidence_col=None), parts) for parts in (9, None))
    assert many.rdd.getNumPartitions() == 9
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))


def test_a_block_of_a_table_has_its_own_rows_only(spark, sf_dir):
    """Rows of a table are put in order by a flat struct, and no block carries the whole table."""
    tables = chunks.order_tables(spark, sf_dir, "l_suppkey")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in plan(tables) and "sort_array(" in plan(tables)
    blocks = [line for line in plan(C2.table_blocks(tables)).splitlines() if "posexplode(" in line]
    assert len(blocks) == 1 and "posexplode(begins" not in blocks[0]
    rows = spark.createDataFrame([(1, 1, 0, [["h"], *[["x" * n] for n in range(1, 40)]])], "doc_id int, page_number int, table_index int, rows array<array<string>>")
    out = C2.table_blocks(rows).orderBy("block").collect()
    assert [(r.block, r.table_row_start, r.table_row_end, r.table_row_count) for r in out] == [(0, 1, 12, 12), (1, 14, 25, 12), (2, 26, 37, 12), (3, 38, 40, 3)]
    assert "\n".join(r.text.split("h\n", 1)[1] for r in out).split("\n") == [f"Row {k + (k > 12)}: {'x' * k}" for k in range(1, 40)]


def test_only_long_texts_go_to_python_for_windows(spark):
    texts = [*ODD, "\x1c a \x1f", "  x y\u0085", "᠎", "a" * 1_999, " " * 1_999, "b c " * 600, " " * 2_000, "\n\nd" * 1_000, "é " * 999, "𝒳 " * 3, None]
    out = rows(spark, texts).select("text", C2.windows(F.col("text")).alias("a")).collect()
    assert [[(w.text, w.start) for w in r.a] for r in out] == [C2.split_text(t or "") for t in texts]
    seen = rows(spark, ["a b", "c" * 2_500]).select(C2.windows(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert "text_windows(CASE WHEN" in seen


def test_keywords_are_looked_for_by_their_first_words(spark):
    words = ["notice", "to:", "für", "l", "notice notice", "ź", "x²", "(to"]
    assert [C._first(w) for w in words] == ["notice", "to", "für", "l", "notice", None, None, None]
    texts = [*ODD, "ź źa z", "x² x", "a (to b) (to", "notice  notice notice notice notice"]
    for w in (w for w in words if not w.startswith("(")):
        hits = C.keyword_hits(F.col("text"), [w], C.first_words(F.col("text"), words))
        out = rows(spark, texts).select("text", hits.alias("a"), F.regexp_count("text", F.lit(rf"(?U)\b{w}\b")).alias("b")).collect()
        assert [(r.text, r.a) for r in out] == [(r.text, r.b) for r in out]


def test_plain_classes_find_the_same_in_ascii_texts(spark):
    controls = "".join(map(chr, range(1, 32)))
    texts = ["3 March 2024, 1st day of May 1999 12/5/2020", f"on{controls}3{controls}12 May 2020", "$ 1,200.50 USD\x1c3 4 dollars 5\x0bdollar", "Case No. 24-CV-1234 Docket # x-1 AB\x1f12345 ab 1234", "between A Bcd Efg and x, Plaintiff: Jo Doe\nTenant\x1dAnn Bell", "12 Oak Street Suite 4, Springfield, IL 62704", "é 3 March 2024 12 Oak Street"]
    for kind in E.PATTERNS:
        group = 1 if kind in E.GROUPED else 0
        plain = F.filter(F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(f"(?iU){p}"), F.lit(group)), T.strip) for p in E.PATTERNS[kind]]), lambda v: v != "")
        found = E.found(F.col("text"), kind, E.plain_case(F.col("text")))
        assert "(?i)" in str(found)
        out = rows(spark, texts).select("text", found.alias("a"), plain.alias("b")).collect()
        assert [(r.text, r.a) for r in out] == [(r.text, r.b) for r in out]
