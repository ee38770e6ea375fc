from __future__ import annotations

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import negatives as N
from inkwell.llm import queries

VECTORS = "vec_id long, embedding array<float>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=50):
    usable = [(i, [math.floor(256 * np.float32(x).item()) for x in v], c) for i, v, c in rows if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i)
    out = []
    for i, v, c in usable:
        if i is None or i % every:
            continue
        scored = sorted(((-sum(map(int.__mul__, v, w)), last(j), d) for j, w, d in usable if len(w) == len(v) and j != i), key=lambda x: x[:2])
        for p, j, _ in [x for x in scored if x[2] == c][:5]:
            fits = [(s, k) for s, k, d in scored if d != c and 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, j[1], n, k[1], -p, -s) for n, (s, k) in enumerate(fits, 1)]
    return sorted(out, key=str)


def made(seed, n, dims, spread):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = []
    for k in range(n):
        c = rng.randrange(4)
        rows.append((k, [spread * (x + rng.gauss(0, 0.7)) for x in centres[c]], rng.choice([c, c, rng.randrange(3)])))
    return rows


def got(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def test_against_brute_force(spark):
    for seed, n, dims, spread, every, block in ((1, 300, 8, 0.3, 50, 4096), (2, 200, 3, 0.01, 10, 8), (3, 120, 5, 1e6, 20, 4096), (4, 40, 4, 1e6, 10, 4096)):
        rows = made(seed, n, dims, spread)
        rows += rows[:7]  # repeated rows
        if seed == 1:
            rows += [(None, [0.5] * 8, 1), (900, None, 1), (950, [1.0] * 8, None), (1000, [1.0] * 7 + [None], 1), (1050, [float("nan")] * 8, 1), (1100, [float("inf")] * 8, 2), (1150, [0.3] * 5, 1), (1200, [], 1), (1201, [], 1), (1202, [], 2)]
        frame = spark.createDataFrame(rows, VECTORS).repartition(5).withColumn("extra", F.lit(1))
        found = got(N.hard_negatives(frame, F.col("vec_id") % every == 0, block=block))
        assert found == brute(rows, every) and found


def test_no_rows_and_few(spark):
    none = spark.createDataFrame([], VECTORS)
    assert N.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 2)], VECTORS)
    assert N.hard_negatives(one, F.col("vec_id") % 50 == 0).count() == 0  # no positive
    ties = [(0, [1.0], 1), (2, [1.0], 1), (1, [1.0], 1), *[(k, [0.75], 2) for k in range(9, 3, -1)]]
    assert [r[:4] for r in got(N.hard_negatives(spark.createDataFrame(ties, VECTORS), F.col("vec_id") % 50 == 0))] == [(0, p, k, k + 3) for p in (1, 2) for k in (1, 2, 3)]


@pytest.mark.parametrize("bits", [1, 4, 6, 8])
def test_bounds_hold_and_prune(bits):
    rng = np.random.default_rng(bits)
    rows, anchors = rng.integers(-300, 300, (500, 16)), rng.integers(-300, 300, (20, 16)).astype(np.int64)
    least, width, cells = N.approximate(rows, bits)
    lower, gap = N.bounds(anchors, least, width, cells, bits)
    exact = anchors @ rows.T
    assert (lower <= exact).all() and (exact <= lower + gap[:, None]).all()
    fifth = np.sort(exact, axis=1)[:, -5]
    may = lower + gap[:, None] >= np.sort(lower, axis=1)[:, -5, None]
    assert (may | (exact < fifth[:, None])).all()  # no row of the best five is left out
    if bits == 8:
        assert may.mean() < 0.05


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE['op13_hard_negatives']})").fetchall()
    out = queries.QUERIES["op13_hard_negatives"](spark, sf_dir)
    assert got(out) == sorted(want, key=str) and want
    assert dict(out.dtypes) == {c: "int" if c == "rank" else "bigint" for c in COLUMNS}
