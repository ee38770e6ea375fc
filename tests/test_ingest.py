from __future__ import annotations

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from inkwell.engine import Engine
from inkwell.functions.rules import block_diff, diff_json
from inkwell.operators import draft, learning
from inkwell.operators.draft import OcrEngine
from inkwell.schemas import DRAFT_RUNS, JOBS, PAGES
from inkwell.sources.readers import as_json, files, observed, read_workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
OFFICE = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
AT = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def workbook(extra: str = "") -> bytes:
    """Two sheets, the first in the second part, and one without rows; dates, booleans and numbers."""
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} {OFFICE}><workbookPr {extra}/><sheets><sheet name="One" sheetId="5" r:id="b"/><sheet name="Two" sheetId="9" r:id="a"/><sheet name="None" sheetId="3" r:id="c"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/><Relationship Id="c" Target="worksheets/sheet3.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {MAIN}><sheetData><row><c t="inlineStr"><is><t>second </t></is></c><c t="b"><v>1</v></c><c t="str"><v>f</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {MAIN}><sheetData><row><c r="A1" s="1"><v>45292</v></c><c r="B1" s="2"><v>45292.5</v></c><c r="D1" s="3"><v>2.50</v></c><c r="E1"><v>7</v></c><c r="F1" s="1"><v>0.25</v></c></row><row/></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet3.xml", f"<worksheet {MAIN}><sheetData/></worksheet>")
    return data.getvalue()


def test_sheets_are_those_of_the_relationships():
    got = read_workbook(workbook())
    assert [(k, title) for k, title, _ in got] == [(1, "One"), (2, "Two"), (3, "None")]
    assert got[0][2] == [["2024-01-01 00:00:00", "2024-01-01 12:00:00", "", "2.5", "7", "06:00:00"], []]
    assert got[1][2] == [["second", "True", "f"]] and got[2][2] == []
    assert read_workbook(workbook('date1904="1"'))[0][2][0][0] == "2028-01-02 00:00:00"


class Reader(OcrEngine):
    def read(self, content):
        return content.decode(), 0.4 if content.startswith(b"weak") else 0.9


def extractor(content):
    """Pages by form feeds; a page that begins with IMAGE has only an image."""
    out = []
    for page in content.decode().split("\f"):
        out.append(("", [], page[5:].encode()) if page.startswith("IMAGE") else (page, [], None))
    return out


NOTICE = "NOTICE OF DEFAULT. You are hereby notified pursuant to law that by March 3, 2024 the tenant must pay $1,200.50 within days. Premises at 12 Oak Street, Springfield."


def test_files_to_documents_and_both_indexes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("b.xlsx", workbook()), ("a.pdf", f"{NOTICE}\fIMAGE{NOTICE}\fIMAGE".encode()), ("c.PNG", b"weak scan of a deed from grantor to grantee"), ("d.exe", b"x"), ("e.pdf", b"y" * 2_000_000)):
        (folder / name).write_bytes(data)
    from dataclasses import replace

    from inkwell.config import DEFAULT

    engine = Engine(spark, f"file://{tmp_path}/store", replace(DEFAULT, max_file_mb=1))
    session = engine.create_session("u", AT)
    with pytest.raises(KeyError):
        engine.ingest_files("none", f"file://{folder}")
    rows, rejected = engine.ingest_files(session, f"file://{folder}", extractor, Reader())
    got = {r.filename: r for r in rows.collect()}
    assert {r.filename: r.error for r in rejected.collect()} == {"d.exe": "Unsupported file type: .exe", "e.pdf": "File is larger than 1 MB"}
    assert set(got) == {"a.pdf", "b.xlsx", "c.PNG"} and all(r.status == "processed" for r in got.values())
    a, b, c = got["a.pdf"], got["b.xlsx"], got["c.PNG"]
    assert (a.doc_type, a.total_pages) == ("legal_notice", 3) and a.entity_count >= 3 and a.chunk_count >= 1
    assert any("very little text" in w and "Page 3" in w for w in a.warnings)
    assert b.total_pages == 3 and "Sheet 'None' is empty" in b.warnings and b.chunk_count >= 3
    assert c.avg_confidence == 0.4 and any("confidence is low (40%)" in w for w in c.warnings)
    ids = engine.session_documents(session)
    assert [r.filename for r in engine.documents(ids).collect()] == ["a.pdf", "b.xlsx", "c.PNG"]
    stored = engine.document(a.doc_id)
    assert stored["extraction_method"] == "hybrid" and stored["file_type"] == "pdf" and stored["file_size_bytes"] == (folder / "a.pdf").stat().st_size
    assert engine.document(c.doc_id)["extraction_method"] == "ocr_image" and engine.document(b.doc_id)["extraction_method"] == "native_text"
    with pytest.raises(KeyError):
        engine.document("none")
    found = engine.search(session, spark.createDataFrame([(0, "deed from grantor")], "query_id int, query string")).orderBy("rank").first()
    assert found.filename == "c.PNG"
    assert found.asDict().get("vector") is None and engine._index(session).count() == a.chunk_count + b.chunk_count + c.chunk_count
    (folder / "c.PNG").unlink()
    (folder / "a.pdf").unlink()
    engine.ingest_files(session, f"file://{folder}")
    assert engine.session_documents(session) == [*ids, b.doc_id]
    lines = as_json(observed(engine.documents(ids))).collect()
    assert len(lines) == 3 and '"filename":"a.pdf"' in lines[0].json
    seen = sorted((r.documents, r.pages) for r in engine.metrics().collect())
    assert seen == [(1, 3), (3, 7)]  # a row for each upload


class Breaks(OcrEngine):
    def read(self, content):
        if content.startswith(b"bad"):
            raise RuntimeError("engine is off")
        return content.decode(), 0.9


def breaks(content):
    if content.startswith(b"bad"):
        raise ValueError("not a PDF")
    return [] if content == b"empty" else extractor(content)


def test_every_file_has_an_answer(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, data in (("a.pdf", NOTICE.encode()), ("b.xlsx", b"PK broken"), ("c.png", b"bad"), ("d.txt", b"x"), ("e.png", NOTICE.encode()), ("f.pdf", b"bad"), ("g.pdf", b"empty"), ("h.pdf", f"{NOTICE}\fIMAGEbad".encode()), ("i x%.xlsx", b"")):
        (folder / name).write_bytes(data)
    engine = Engine(spark, f"file://{tmp_path}/store")
    session = engine.create_session("u", AT)
    rows, rejected = engine.ingest_files(session, f"file://{folder}", breaks, Breaks())
    got, why = {r.filename: r for r in rows.collect()}, {r.filename: r.error for r in rejected.collect()}
    assert set(got) == {"a.pdf", "e.png", "h.pdf"} and set(why) == {"b.xlsx", "c.png", "d.txt", "f.pdf", "g.pdf", "i x%.xlsx"}
    assert why["f.pdf"] == "File cannot be read: not a PDF" and why["c.png"] == "File cannot be read: engine is off" and why["g.pdf"] == "File has no pages" and "zip" in why["b.xlsx"] and why["i x%.xlsx"] == "File is empty"
    assert got["h.pdf"].total_pages == 2 and "Text recognition failed: engine is off" in got["h.pdf"].warnings
    other = engine.create_session("u", AT + dt.timedelta(days=1))
    rows, rejected = engine.ingest_files(other, f"file://{folder}")  # neither an extractor nor an engine
    why = {r.filename: r.error for r in rejected.collect()}
    assert {r.filename for r in rows.collect()} == {"c.png", "e.png"} and why["a.pdf"] == why["h.pdf"] == "No extractor for PDF files" and {"b.xlsx", "d.txt"} < set(why)


def test_vision_answers_replace_weak_pages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "c.png").write_bytes(b"weak scan")
    engine = Engine(spark, f"file://{tmp_path}/store")
    session = engine.create_session("u", AT)
    doc = files(spark, f"file://{tmp_path}/in")[0].first().doc_id
    answers = spark.createDataFrame([(doc, 1, NOTICE, 0.8, ["seen"])], "doc_id string, page_number int, raw_text string, confidence double, warnings array<string>")
    rows, _ = engine.ingest_files(session, f"file://{tmp_path}/in", None, Reader(), answers)
    row = rows.first()
    assert row.doc_type == "legal_notice" and "seen" in row.warnings and engine.document(doc)["extraction_method"] == "multimodal_llm"


class Vision(OcrEngine):
    def read(self, content):
        if content == b"broken":
            raise RuntimeError("no answer")
        return (f" {NOTICE} " if content == b"faint" else ""), 0.0


def test_a_vision_model_reads_weak_pages_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(f"{NOTICE}\fIMAGEfaint\fIMAGEbroken\fIMAGEblank".encode())
    engine = Engine(spark, f"file://{tmp_path}/store")
    session = engine.create_session("u", AT)
    rows, _ = engine.ingest_files(session, f"file://{tmp_path}/in", extractor, vision=Vision())
    warnings = rows.first().warnings
    assert "Multimodal fallback failed: no answer" in warnings and "Multimodal fallback returned no usable text" in warnings
    pages = {r.page_number: r for r in engine.store.load("pages", PAGES).collect()}
    assert [pages[k].extraction_method for k in (1, 2, 3, 4)] == ["native_text", "multimodal_llm", "ocr_scan", "ocr_scan"]
    assert pages[2].raw_text == NOTICE and pages[2].confidence > 0.6 and any("Used multimodal" in w for w in pages[2].warnings)


class Fails(draft.RuleExtractor):
    def extract(self, feedback):
        return super().extract(feedback).withColumn("candidates", F.raise_error(F.lit("no model")).cast("array<struct<description:string,category:string,example_before:string,example_after:string,applicable_draft_types:array<string>,confidence:double>>"))


def test_jobs_have_states_and_deleted_rules_come_back(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    session = engine.create_session("u", AT)
    pages = spark.createDataFrame([("d1", "deed.pdf", 1, "This deed conveys title from grantor to grantee.")], "doc_id string, filename string, page_number int, raw_text string")
    engine.ingest(session, pages)
    out = engine.draft(session, "internal_memo", at=AT)
    hours = lambda n: AT + dt.timedelta(hours=n)
    edit = out["draft"] + "\n\nAlways name the grantor first."
    one = engine.submit_feedback(out["draft_id"], edit, at=hours(1), process=False)
    assert engine.feedback_status(one)["status"] == "pending" and engine.rules("u").count() == 0
    assert engine.process_feedback() == 1 and engine.process_feedback() == 0
    assert engine.feedback_status(one)["status"] == "completed"
    rule = engine.rules("u").first()
    engine.set_rule_status("u", rule.rule_id, "disabled", hours(2))
    engine.delete_rule("u", rule.rule_id, hours(3))
    assert engine.rules("u").count() == 0
    engine.submit_feedback(out["draft_id"], edit, at=hours(4))
    again = engine.rules("u").first()
    assert again.description == rule.description and again.rule_id != rule.rule_id and again.status == "active"
    engine.rule_extractor = Fails()
    bad = engine.submit_feedback(out["draft_id"], edit + "\n\nMore.", at=hours(5))
    state = engine.feedback_status(bad)
    assert state["status"] == "failed" and "no model" in state["error_message"] and engine.rules("u").count() == 1
    jobs = lambda: engine.store.load("jobs", JOBS)
    assert jobs().count() == 6
    engine.compact()
    engine.compact()
    assert sorted(r.status for r in jobs().collect()) == ["completed", "completed", "failed"] and engine.rules("u").count() == 1
    with pytest.raises(KeyError):
        engine.feedback_status("none")
    with pytest.raises(ValueError):
        engine.control_rule("u", again.rule_id, "hide")


def test_a_worker_takes_feedback_up_in_the_background(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    run = ("d", "u", "s", "internal_memo", None, "q", "a", [], [], AT)
    engine.store.append("draft_runs", spark.createDataFrame([run], DRAFT_RUNS))
    first = engine.submit_feedback("d", "a\n\nName the grantor first.", at=AT, process=False)
    _, query = engine.feedback_worker(processingTime="1 second")
    try:
        second = engine.submit_feedback("d", "a\n\nCite the page.", at=AT + dt.timedelta(hours=1))  # by the worker
        assert {engine.feedback_status(f)["status"] for f in (first, second)} == {"completed"}
        assert engine.rules("u").count() == 2 and query.isActive and engine.process_feedback() == 0
    finally:
        query.stop()
    assert engine.process_feedback() == 0 and engine.rules("u").count() == 2


def test_fold_exact_counts_what_it_does_not_gather(spark):
    rows = [("u", "k", n, (n * 37 % 100) / 100) for n in range(40)] + [("u", "one", 1, 0.3), ("v", "k", 2, 0.9), ("v", "k", 3, 0.1)]
    got = {(r.user_id, r.key): (r.confidence, r.support) for r in learning.fold_exact(spark.createDataFrame(rows, "user_id string, key string, seq long, confidence double")).collect()}
    assert got == {("u", "k"): (1.0, 40), ("u", "one"): (0.3, 1), ("v", "k"): (1.0, 2)}


def test_diff_as_json_for_a_model(spark):
    diff = block_diff("a\n\nb", "a\n\nç")
    frame = spark.createDataFrame([("t", "q", None, "a\n\nb", "a\n\nç", diff)], "draft_type string, retrieval_query string, operator_notes string, original_draft string, edited_draft string, structured_diff array<struct<operation:string,before:string,after:string>>")
    import json

    assert json.loads(frame.select(diff_json(F.col("structured_diff")).alias("j")).first().j) == diff
    text = draft.rules_request(frame).first().rules_request
    assert "ç" in text and "Notes:\nNone" in text
