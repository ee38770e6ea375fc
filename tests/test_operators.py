from __future__ import annotations

import datetime as dt
import io
import re
import unicodedata
import zipfile

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.entities import extract, first_of_each
from inkwell.functions.rules import block_diff, ratio
from inkwell.operators import documents
from inkwell.operators.chunk import SEPARATORS, split_text, table_blocks
from inkwell.operators.learning import best_match, control, fold_batch, fold_feedback
from inkwell.sources.readers import files, in_order_of, latest, read_workbook, sheet_pages, workbook_rows

BREAKS = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def clean_by_hand(text):
    """The cleaning rules, in order, as plain Python."""
    if not text or not text.strip():
        return ""
    t = unicodedata.normalize("NFC", text)
    for a, b in zip("‘’“”– ", "''\"\"- "):
        t = t.replace(a, b)
    t = t.replace("­", "").replace("—", "--").replace("…", "...")
    kept = [x for x in t.splitlines() if not re.match(r"^\s*[_\-=]{4,}\s*$", x) and not re.match(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", x)]
    t = "\n".join(kept)
    for a, b in ((r"\bl\b", "I"), (r"\b0\b", "O"), ("rn", "m"), (r"\|", "I"), (r"(?<=[a-z])-\n(?=[a-z])", ""), (r"(?<!\n)\n(?!\n)", " "), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " "), (r"([a-z])- ([A-Z])", r"\1-\2"), (r"\s+([.,;:!?)\]])", r"\1"), (r"([.,;:!?)\]])\s+", r"\1 "), (r"\(\s+", "("), (r"\s+\)", ")")):
        t = re.sub(a, b, t)
    return "\n".join(x.rstrip() for x in t.splitlines()).strip()


TEXTS = ["", "  \n ", None, "él l'été l x é0 0", "gover-\nning law | 1.0 rn", "====\nline one\n\n\n\nSECTION two .\n\nnext ( a ) -- b", "\x01gone\nkept\x0bsplit more\n", "a- B c- d\t\t e  f­“q” — …", "tail \n \n", "étude  v . No . 12"]


def test_cleaning_against_plain_python(spark, sf_dir):
    rows = TEXTS + [r.text.replace(". ", " .\n\n\n").replace(" de ", "-\nde 0 ") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, text string")
    got = {r.i: r.c for r in frame.select("i", T.clean(F.col("text")).alias("c")).collect()}
    assert got == {i: clean_by_hand(t) for i, t in enumerate(rows)}


def test_entities_by_hand(spark):
    pages = [(1, 2, "Paid $1,200.00 and $1200 on 2024-12-31, later 2024-12-31. Plaintiff: Bob. Case No. 24-CV-001234", 0.5), (1, 1, "Tenant: The Person; Landlord: Mary Major. $, in 2024", 0.9), (2, 1, "", 1.0), (2, 2, None, 1.0)]
    frame = spark.createDataFrame(pages, "doc_id int, page_number int, cleaned_text string, confidence double")
    out = [(r.entity_type, r.value, r.normalized, r.page) for r in first_of_each(extract(frame)).orderBy("ord").collect()]
    assert ("amount", "$,", "$,", 1) in out and ("amount", "$1,200.00", "$1,200.00", 2) in out
    assert sum(t == "amount" for t, *_ in out) == 2 and ("date", "2024-12-31", "2024-12-31", 2) in out
    assert ("case_number", "24-CV-001234", None, 2) in out and ("case_number", "in 2024", None, 1) in out
    assert [v for t, v, *_ in out if t == "party"] == ["Mary Major.", "Bob. Case No."]


@given(st.text(alphabet="ab .;\nSECTION", max_size=400), st.integers(10, 60))
@settings(max_examples=150, deadline=None)
def test_splitter_invariants(text, size):
    out = split_text(text, size, size // 5)
    covered = set()
    last = 0
    for window, start in out:
        assert len(window) <= size and text[start : start + len(window)] == window and start >= last
        covered |= set(range(start, start + len(window)))
        last = start
    assert all(i in covered for i, c in enumerate(text) if not c.isspace())


def test_splitter_prefers_sections():
    text = "intro " * 30 + "\n\nSECTION 1 " + "body " * 40
    assert any(w.startswith("SECTION 1") for w, _ in split_text(text, 200, 20)) and SEPARATORS[-1] == ""


def blocks_by_hand(rows, max_rows=12, max_chars=2000):
    rows = [[c.strip() for c in r if c and c.strip()] for r in rows]
    rows = [r for r in rows if r]
    if not rows:
        return []
    head = "Table block on page 3\nTable 1\nColumns: " + " | ".join(rows[0])
    render = lambda body, start: "\n".join([head, *(f"Row {start + i}: " + " | ".join(r) for i, r in enumerate(body))])
    if len(rows) == 1:
        return [(render(rows, 1), 1, 1)]
    out, block, start = [], [], 1
    for n, row in enumerate(rows[1:], 2):
        if block and (len(block) + 1 > max_rows or len(render([*block, row], start)) > max_chars):
            out.append((render(block, start), start, len(block)))
            block, start = [row], n
        else:
            block.append(row)
    return [*out, (render(block, start), start, len(block))]


def test_table_blocks(spark):
    tables = [[["h", "k"]], [["h", " "], ["", None]], [], [["a", "b"]] + [[str(i), "x" * (i * 7 % 300)] for i in range(40)], [["only", "head"], ["r", "1"]], [["c"]] + [["y" * 1990], ["z" * 2500], ["w"]]]
    frame = spark.createDataFrame([(i, 3, 0, t) for i, t in enumerate(tables)], "doc_id int, page_number int, table_index int, rows array<array<string>>")
    got = {}
    for r in table_blocks(frame).orderBy("doc_id", "block").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.table_row_start, r.table_row_count))
    assert got == {i: b for i, t in enumerate(tables) if (b := blocks_by_hand(t))}


def test_diff_and_similarity():
    assert block_diff("a\n\nb\n\nc", "a\n\nB\n\nc\n\nd") == [{"operation": "replace", "before": "b", "after": "B"}, {"operation": "insert", "before": "", "after": "d"}]
    assert block_diff(None, "") == [] and ratio("tide", "diet") == 0.25 and ratio("diet", "tide") == 0.5


def feedback(n, *candidates, applied=()):
    return {"user_id": "u", "feedback_id": f"f{n}", "draft_type": "internal_memo", "submitted_at": dt.datetime(2024, 1, 1 + n), "candidates": [{"description": d, "category": c, "confidence": x, "example_before": None, "example_after": None, "applicable_draft_types": []} for d, c, x in candidates], "applied_rule_ids": list(applied)}


def test_fold_by_hand(spark):
    rules = fold_feedback([], feedback(0, ("Use short sentences", "tone", 0.6), ("Use  short, sentences!", "tone", 0.5), ("Use short sentences", "other", 0.4), ("!!", "tone", 0.9)))
    assert [(r["category"], round(r["confidence"], 6), r["support_count"]) for r in rules] == [("tone", 0.7, 2), ("other", 0.4, 1)]
    tone, other = (r["rule_id"] for r in rules)
    rules = fold_feedback(rules, feedback(1, ("Use short sentences always", "tone", 0.3), applied=(tone, other)))
    assert [(round(r["confidence"], 6), r["support_count"], r["decay_count"]) for r in rules] == [(0.9, 4, 0), (0.35, 1, 1)]
    for k in range(2, 6):
        rules = fold_feedback(rules, feedback(k, applied=(other,)))
    assert [r["rule_id"] for r in rules] == [tone]
    rules = control(rules, {"rule_id": tone, "action": "disable", "submitted_at": None})
    assert fold_feedback(rules, feedback(9, ("Use short sentences", "tone", 0.2), applied=(tone,)))[0]["status"] == "disabled"
    assert best_match(rules, "tone", "nothing like it at all") is None
    frame = spark.createDataFrame([feedback(1, ("b rule", "tone", 0.2)), feedback(0, ("a first rule", "tone", 0.9), ("a first rule", "tone", 0.1))], "user_id string, feedback_id string, draft_type string, submitted_at timestamp, candidates array<struct<description:string,category:string,confidence:double,example_before:string,example_after:string,applicable_draft_types:array<string>>>, applied_rule_ids array<string>")
    out = [(r.normalized_key, round(r.confidence, 6), r.insert_seq) for r in fold_batch(frame).orderBy("insert_seq").collect()]
    assert out == [("a first rule", 1.0, 0), ("b rule", 0.2, 1)]


def test_processing_of_documents(spark):
    pages = spark.createDataFrame([("d", 1, "The lease between landlord and tenant sets the monthly rent in detail."), ("d", 2, ""), ("e", 1, None)], "doc_id string, page_number int, raw_text string")
    rows = {r.doc_id: r for r in documents.process(documents.clean_pages(pages)).collect()}
    assert rows["d"].doc_type == "lease_agreement" and rows["d"].total_pages == 2 and rows["d"].low_confidence_pages == [2]
    assert [w.code for w in rows["e"].warnings] == ["LOW_OVERALL_CONFIDENCE", "UNKNOWN_DOC_TYPE", "PAGE_WARNING", "NO_TEXT_EXTRACTED"]
    assert not rows["e"].is_usable and rows["e"].quality_score == 0.0


def workbook():
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="First" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>head</t></si><si><t> x </t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="B3" t="s"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files_and_sheets(spark, tmp_path):
    assert read_workbook(workbook()) == [(1, "First", [["head", "", "7"], [""], ["", "x"]])]
    for name, data in (("a.xlsx", workbook()), ("b.XLSX", b"broken"), ("c.exe", b"x")):
        (tmp_path / name).write_bytes(data)
    found, rejected = files(spark, str(tmp_path))
    assert [r.error for r in rejected.collect()] == ["Unsupported file type: .exe"] and found.count() == 2
    page = sheet_pages(workbook_rows(found)).collect()
    assert len(page) == 1 and page[0].raw_text == "Sheet: First\nhead | 7\nx" and page[0].tables == [[["head", "", "7"], ["", "x"]]]


def test_keyed_reads(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 2, "c", True)], "k int, v int, x string, gone boolean")
    assert [tuple(r) for r in latest(log, "k", "v", "gone").collect()] == [(1, 2, "b")]
    ids = spark.createDataFrame([("s", [3, 9, 1])], "s string, ids array<int>")
    rows = spark.createDataFrame([(1, "one"), (3, "three")], "k int, x string")
    assert [r.x for r in in_order_of(ids, rows, "ids", "k").orderBy("pos").collect()] == ["three", "one"]


def test_rule_match_best_takes_every_part(spark, sf_dir):
    from inkwell.operators.learning import best_match, normal_key
    from inkwell.plans.learning import rule_match_best

    got = {int(r.candidate_id): r.rule_id for r in rule_match_best(spark, sf_dir).collect()}
    want, rules = {}, {}
    for p in spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey").collect():
        key, own = normal_key(f"{p.p_name} {p.p_type}"), rules.setdefault(p.p_brand, [])
        best = best_match(own, p.p_type, key)
        want[p.p_partkey] = best and best["rule_id"]
        own.append({"category": p.p_type, "normalized_key": key, "rule_id": str(p.p_partkey)})
    assert got == want


def test_best_matches_lose_no_pair(spark):
    """Against the plain search, for short, long, empty, nested, reordered and nearly equal keys and null groups."""
    import random

    from inkwell.operators.learning import best_match, best_matches

    rng = random.Random(3)
    words = ["a", "b", "use", "short", "words", "name", "the", "grantor", "first", "2024", "always", "cite", "x1"]

    def key():
        own = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 60])))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(own) + 1)
            own = own[:at] + rng.choice(["", "z", "qq"]) + own[at + rng.choice([0, 1]) :]
        return " ".join(own[rng.choice([0, 0, 1]) :].split())

    rows = [(rng.choice(["u", "v", None]), n, rng.choice(["tone", None]), key()) for n in range(260)]
    rules = spark.createDataFrame([(u, c, k, str(n), n) for u, n, c, k in rows], "user_id string, category string, normalized_key string, rule_id string, insert_seq long")
    for own in (True, False):
        asked = [(u, str(n), c, k, n) for u, n, c, k in rows]
        frame = spark.createDataFrame(asked, "user_id string, candidate_id string, category string, key string, insert_seq long")
        got = {r.candidate_id: r.rule_id for r in best_matches(frame if own else frame.drop("insert_seq"), rules).collect()}
        for u, n, c, k, q in asked:
            mine = [{"category": d, "normalized_key": x, "rule_id": str(m)} for v, m, d, x in rows if v == u and (not own or m < q)]
            best = best_match(mine, c, k)
            assert got[n] == (best and best["rule_id"]), (k, got[n], best)


def test_upper_case_keeps_the_length(spark):
    import duckdb

    texts = ["Straße", "ǆ ŉ ﬁ ΐ und ß", "ᾳ ᾼ ᾂ", "a𐐨z\n", "", None]
    got = [r.u for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.upper(F.col("t")).alias("u")).orderBy("k").collect()]
    assert got == ["STRAẞE", "Ǆ ŉ ﬁ ΐ UND ẞ", "ᾼ ᾼ ᾊ", "A𐐀Z\n", "", None]
    assert got[:5] == [duckdb.execute("SELECT upper(?)", [t]).fetchall()[0][0] for t in texts[:5]]
