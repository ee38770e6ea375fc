from __future__ import annotations

import datetime as dt
import random
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb

from inkwell.llm import queries
from inkwell.llm.cohort import cohort_retention, delayed

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CLIENTS = "client_id long, name string, segment string, ts string"
AS_OF = dt.datetime(2024, 2, 15)
COLUMNS = ("state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents")


def brute(clicks, clients, as_of=AS_OF, days=1):
    epoch, unit = dt.datetime(1970, 1, 1), dt.timedelta(days=days)
    rows = [r for r in set(clicks) if r[1] is not None and r[3] is not None]
    segment = {}
    for c, _, s, _ in clients:
        segment[c] = min((x for x in (segment.get(c), s) if x is not None), default=None)
    starts = [{}, {}]
    known = [[r for r in rows if r[2] is not None and r[2] < as_of], rows]
    for s in (0, 1):
        for r in known[s]:
            if r[4] == "signup":
                starts[s][r[3]] = min(starts[s].get(r[3], r[1]), r[1])
    cells = defaultdict(lambda: [set(), 0])
    cohort = lambda s, c: (starts[s][c] - epoch) // dt.timedelta(days=1)
    for s in (0, 1):
        for r in known[s]:
            c = r[3]
            if c in starts[s] and r[1] >= starts[s][c]:
                cell = cells[s, segment.get(c) or "", cohort(s, c), (r[1] - starts[s][c]) // unit]
                cell[0].add(c)
                v = r[5]
                cell[1] += int((100 * v + 0.5) // 1) if v is not None and v == v and abs(v) != float("inf") else 0
    both = lambda c: c in starts[0] and c in starts[1] and cohort(0, c) != cohort(1, c)
    return sorted((*k, len(u), sum(zlib.crc32(str(c).encode()) for c in u), sum(map(both, u)), cents) for k, (u, cents) in cells.items())


def made(seed, n, clients=12):
    rng = random.Random(seed)
    day = dt.datetime(2024, 2, 1)
    out = []
    for k in range(n):
        client = 7 if rng.random() < 0.33 else rng.choice([None, *range(clients)])
        ts = None if rng.random() < 0.03 else day + dt.timedelta(microseconds=rng.choice([0, 1, 86_399_999_999, 86_400_000_000, rng.randrange(20 * 86_400_000_000)]))
        arrived = None if rng.random() < 0.05 else (ts or day) + dt.timedelta(hours=rng.choice([0, 1, 400]))
        out.append((k, ts, arrived, client, rng.choice(["signup", "click", "view", None]), rng.choice([None, 0.005, -1.25, 3.0, float("nan"), float("inf"), 12.345]), rng.choice([None, "{}"])))
    out += rng.choices(out, k=n // 4)  # repeated rows
    return [(a, b, c, d, e, f if f is None or f == f else None, g) for a, b, c, d, e, f, g in out]  # NaN is not equal to itself in a set


def got(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.collect())


def test_against_brute_force(spark):
    clients = [(c, "x", s, "other") for c, s in ((0, "a"), (1, None), (2, "b"), (2, "a"), (7, "hot"), (99, "none"), (None, "c"))]
    people, moved = spark.createDataFrame(clients, CLIENTS), 0
    for seed, n, batch, least in ((1, 200, "10000", 1000), (2, 600, "7", 20), (3, 400, "1", 5)):
        rows = made(seed, n)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            for days in (1, 3):
                out = cohort_retention(spark.createDataFrame(rows, CLICKS), people, AS_OF, period_days=days, parts=16, least_rows=least)
                want = brute(rows, clients, days=days)
                assert got(out) == want
                moved += sum(r[6] for r in want)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert moved


def test_edges(spark):
    people = spark.createDataFrame([], CLIENTS)
    assert got(cohort_retention(spark.createDataFrame([], CLICKS), people, AS_OF)) == []
    at = dt.datetime(2024, 2, 14, 23, 59, 59, 999999)
    rows = [
        (1, at, at, 5, "view", 1.0, None), (2, at, AS_OF, 5, "signup", float("nan"), None),  # both at the start's time; the start arrives late
        (3, at - dt.timedelta(microseconds=1), at, 5, "click", 7.0, None), (4, at + dt.timedelta(days=1), at, 5, None, None, None),
        (5, at, None, 6, "signup", 2.0, None), (6, dt.datetime(1969, 12, 31, 23), at, 8, "signup", 0.0, None),
    ]
    day = (at - dt.datetime(1970, 1, 1)).days
    crc = lambda *c: sum(zlib.crc32(str(x).encode()) for x in c)
    want = [(0, "", -1, 0, 1, crc(8), 0, 0), (1, "", -1, 0, 1, crc(8), 0, 0), (1, "", day, 0, 2, crc(5, 6), 0, 300), (1, "", day, 1, 1, crc(5), 0, 0)]
    assert got(cohort_retention(spark.createDataFrame(rows, CLICKS), people, AS_OF)) == want
    wide = spark.createDataFrame(rows, CLICKS).selectExpr("*", "'x' as segment", "1 as _client", "'y' as state")
    assert got(cohort_retention(wide, people, AS_OF)) == want


def test_delays_and_sql(spark, sf_dir):
    clicks = spark.createDataFrame([(k, None, AS_OF, 1, "x", None, None) for k in range(300)], CLICKS)
    for r in delayed(clicks).collect():
        h = zlib.crc32(str(r.click_id).encode())
        assert r.arrived_at == AS_OF + dt.timedelta(days=h % 100 if h % 3 == 0 else 0)
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({queries.ORACLE['op11_cohort_retention']})").fetchall()
    out = queries.QUERIES["op11_cohort_retention"](spark, sf_dir)
    assert got(out) == sorted(want) and len(want) > 100
    assert [t for _, t in out.dtypes] == ["int", "string", *["bigint"] * 6]
