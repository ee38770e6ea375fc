from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from inkwell.engine import Engine

AT = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def test_a_session_from_files_to_rules(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    assert engine.health()["status"] == "ok"
    session = engine.create_session("u1", AT)
    with pytest.raises(ValueError):
        engine.draft(session, "internal_memo", at=AT)
    with pytest.raises(KeyError):
        engine.draft("none", "internal_memo", at=AT)
    pages = spark.createDataFrame([("d1", "lease.pdf", 1, "The lease between landlord and tenant. Rent is due monthly."), ("d2", "deed.pdf", 1, "This deed conveys title from grantor to grantee without lien.")], "doc_id string, filename string, page_number int, raw_text string")
    docs = {r.doc_id: r.doc_type for r in engine.ingest(session, pages).collect()}
    assert docs == {"d1": "lease_agreement", "d2": "title_document"}
    out = engine.draft(session, "title_review_summary", "deed title grantor", at=AT)
    assert out["evidence"][0]["doc_id"] == "d2" and "deed conveys" in out["draft"] and out["applied_rules"] == []
    job = engine.submit_feedback(out["draft_id"], out["draft"] + "\n\nAlways name the grantor first.", at=AT)
    state = engine.feedback_status(job)
    assert state["structured_diff"][0]["operation"] == "insert" and len(state["active_rules"]) == 1
    rule = engine.rules("u1").first()
    again = engine.draft(session, "title_review_summary", "deed", at=AT + dt.timedelta(days=1))
    assert [r["rule_id"] for r in again["applied_rules"]] == [rule.rule_id]
    engine.set_rule_status("u1", rule.rule_id, "disabled", AT)
    assert engine.rules("u1", include_disabled=False).count() == 0 and engine.rules("u1").first().status == "disabled"
    engine.delete_rule("u1", rule.rule_id)
    assert engine.rules("u1").count() == 0
    with pytest.raises(KeyError):
        engine.delete_rule("u2", rule.rule_id)
    with pytest.raises(KeyError):
        engine.submit_feedback("none", "x")
    other = engine.create_session("u1", AT + dt.timedelta(days=2))
    assert engine._index(other).count() == 0 and engine._index(session).where(F.col("vector").isNotNull()).count() == 2
    engine.delete_session(session)
    assert engine._index(session).count() == 0
