"""Every query with an oracle gives DuckDB's rows; those without are checked elsewhere by hand."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from inkwell.operators.documents import assemble
from inkwell.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canon(frame):
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None).values.tolist()
    return sorted(str([f"{x:.6g}" if isinstance(x, float) else str(x) for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want) and len(got)


def test_low_confidence_pages_counts_blank_pages(spark, tmp_path):
    texts = {0: "plain words of a page " * 9, 1: " \n", 2: "", 3: None, 4: "x 1 " * 30, 50: "", 51: "\u00a0", 100: None, 101: None, 150: "one", 199: "two", -1: "before"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {tuple(r) for r in catalogue.QUERIES["low_confidence_pages"](spark, str(tmp_path)).select("doc_id", "pages", "n_chars").collect()}
    assert got == set(con.execute(catalogue.ORACLE["low_confidence_pages"]).fetchall())
    assert {k: n for k, _, n in got} == {0: 198 + 2 + 120 + 4 * 2, 1: 1 + 2, 2: None, 3: 3 + 3 + 2, -1: 6}


def test_full_text_leaves_blank_pages_out(spark):
    pages = spark.createDataFrame([(1, 1, "one"), (1, 2, " "), (1, 3, None), (1, 4, "two"), (2, 1, None)], "doc_id long, page_number int, cleaned_text string").selectExpr("*", "0.5D AS confidence", "CAST(array() AS array<string>) AS warnings")
    assert {r.doc_id: r.full_text for r in assemble(pages).collect()} == {1: "one\n\ntwo", 2: ""}
    assert {r.doc_id: r.full_text for r in assemble(pages, blank_pages=True).collect()} == {1: "one\n\n \n\n\n\ntwo", 2: None}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())
