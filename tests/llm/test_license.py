from __future__ import annotations

from pathlib import Path

import duckdb

from inkwell.llm.license import canonical, license_scan, oracle
from inkwell.llm.license_data import LICENCES

SCHEMA = "doc_id long, text string, license string, digest int"


def scan(spark, rows, **options):
    return sorted(map(tuple, license_scan(spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA), **options).collect()), key=str)


def test_equivalent_texts_share_a_digest(spark):
    mit = next(t for n, t in LICENCES if n == "MIT" and len(t) > 500)
    rows = [
        (1, mit),
        (2, "Copyright (c) 2020 Some Body\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE").replace("COPYRIGHT HOLDERS", "Copyright Owners")),
        (3, mit + " or not"),
        (4, "text before\n  released UNDER the MIT licence\nafter"),
        (5, "Released under the MIT License!"),
        (6, None), (7, ""), (8, "© 1999"), (None, "Licensed under CC BY-NC 4.0."),
        (9, "long " * 50000), (10, "Released under the MIT Licence"), (10, "Released under the MIT Licence"),
    ]
    assert scan(spark, rows) == sorted(
        [(1, "document", 0, "MIT"), (2, "document", 0, "MIT"), (4, "line", 2, "MIT"), (5, "document", 0, "MIT"), (None, "document", 0, "CC-BY-NC-4.0"), (10, "document", 0, "MIT"), (10, "document", 0, "MIT")], key=str
    )
    assert scan(spark, []) == []


def test_own_licences(spark):
    own = spark.createDataFrame([("A", "Do as you like, non-commercial."), ("A", "do as you like noncommercial"), ("B", None), ("C", "!!"), (None, "No name")], "license string, text string")
    assert scan(spark, [(1, "DO AS YOU LIKE - NONCOMMERCIAL"), (2, "no name"), (3, "!!"), (4, "other")], licences=own) == [(1, "document", 0, "A"), (2, "document", 0, None)]


def test_canonical_keeps_sentences_that_only_mention_copyright():
    assert canonical("The above copyright notice shall stay.") == "the above copyright notice shall stay"
    assert canonical("Copyright (C) 2001-2003 X\nbody") == "body" and canonical("Ünder_score-1") == "ünder score 1"


def test_flattened_and_published_texts(spark):
    mit = next(t for n, t in LICENCES if n == "MIT" and t.startswith("Permission"))
    one = " ".join(mit.split())
    rows = [(1, one), (2, f"Copyright (c) 2020 Jane Roe {one}"), (3, f"MIT License Copyright © 2019, 2021 Acme Inc. All rights reserved. {one}"), (4, f"Copyright (c) 2020 Jane Roe\n{one}"), (5, "In 2020 the copyright office said: permission to use it")]
    want = [(1, "document", 0, "MIT"), (2, "document", 0, "MIT"), (3, "document", 0, "MIT"), (4, "document", 0, "MIT"), (4, "line", 2, "MIT")]
    for folder, found in (("GPL-3", "GPL-3.0"), ("Apache-2.0", "Apache-2.0"), ("MPL-2.0", "MPL-2.0"), ("LGPL-2.1", "LGPL-2.1")):
        path = Path("/usr/share/common-licenses") / folder
        if path.exists():
            text = path.read_text()
            k = 10 + len(rows)
            rows += [(k, text), (k + 100, " ".join(text.split()).upper()), (k + 200, text + " and more")]
            want += [(k, "document", 0, found), (k + 100, "document", 0, found)]
    assert [r for r in scan(spark, rows) if r[1] == "document" or r[0] < 10] == sorted(want, key=str)


def test_oracle_on_a_small_table(spark, tmp_path):
    mit = next(t for n, t in LICENCES if n == "MIT" and t.startswith("Permission"))
    bsd = next(t for n, t in LICENCES if n == "BSD-3-Clause")
    one = " ".join(mit.split())
    rows = [(1, mit), (2, f"Copyright (c) 2020 Jane Roe {one}"), (3, f"(C) 1999 X\n\n{bsd}"), (4, f"x\nLicensed under CC BY 4.0.\n{one}"), (5, None), (6, ""), (7, f"The MIT License (MIT) copyright 2001 Y {one} z"), (8, f"copyright 2001 Y {one}".upper())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = license_scan(spark.read.parquet(f"{tmp_path}/d")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(oracle()).fetchall(), key=str)
    assert {r.doc_id for r in got} == {1, 2, 3, 4, 8}
