from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.llm import queries
from inkwell.llm.suffix import COVERS, cover, cover_places, digests, remove_repeats


def brute(rows, length=50):
    """By all strings of ``length`` bytes: id, bytes, removed, runs, digest of the rest."""
    order = lambda i: float("inf") if i is None else i
    least = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            least[w] = min(least.get(w, order(i)), order(i))
    out = []
    for i, t in data:
        gone = np.zeros(len(t) + 1, np.int64)
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < order(i):
                gone[k] += 1
                gone[k + length] -= 1 if k + length < len(gone) else 0
        gone = np.cumsum(gone)[: len(t)] > 0
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def made(seed, n, letters="abc é\n", pieces=12):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [text(rng.choice([30, 49, 50, 51, 62, 63, 64, 150])) for _ in range(pieces)]
    out = []
    for i in range(n):
        own = "".join(rng.choice([text(rng.randrange(40)), rng.choice(shared)]) for _ in range(rng.randrange(6)))
        out.append((rng.choice([None, i, i, i, i // 2]), rng.choice([None, own, own, own, own, own])))
    return out + rng.choices(out, k=n // 4)


def test_covers_make_every_difference():
    for period, members in COVERS:
        assert {(a - b) % period for a in members for b in members} == set(range(period))
    assert cover(50)[0] == 13 and cover(1) == (1, (0,))
    with pytest.raises(ValueError):
        cover(0)
    ends = np.array([0, 5, 60, 120, 400])
    at, text = cover_places(ends, 50)
    want = [(p, k) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)) for p in range(a, b - 37) if (p - a) % 13 in (0, 1, 3, 9)]
    assert list(zip(at.tolist(), text.tolist())) == want


def test_digests_are_those_of_strings():
    body = np.random.default_rng(1).integers(0, 3, 5_000_000).astype(np.uint8)
    body[4_000_000:4_000_040] = body[10:50] = 7
    a = np.array([10, 4_000_000, 0, 2_097_151, 4_999_960])
    d = digests(body, a, a + 40)
    assert d[0] == d[1] and len(set(d.tolist())) == 4


@pytest.mark.parametrize("length,block,region,bucket", [(50, 1 << 20, 1 << 15, 1 << 21), (50, 300, 7, 50), (20, 1000, 100, 1 << 21), (3, 500, 1 << 15, 400), (1, 200, 1 << 15, 1 << 21)])
def test_against_all_strings(spark, length, block, region, bucket):
    rows = made(length + block, 60)
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_text", F.lit("other")).repartition(3)
    assert got(remove_repeats(frame, length=length, block=block, region=region, bucket=bucket)) == brute(rows, length)


def test_edges(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    same = "x" * 200
    rows = [(3, same), (1, same[:60]), (2, same[:49]), (1, "é" * 25), (5, "a" + "é" * 25), (None, ""), (None, None), (7, "é" * 25), (None, "q" * 50), (None, "q" * 50)]
    assert got(remove_repeats(spark.createDataFrame(rows, "doc_id int, text string"))) == brute(rows)
    kept = {r.doc_id: bytes(r.kept) for r in remove_repeats(spark.createDataFrame(rows[:5], "doc_id int, text string"), texts=True).where("doc_id = 5 or doc_id = 3").collect()}
    assert kept == {3: b"", 5: b"a"}
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_a_long_text_and_a_common_one(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400_000))
    rows = [(1, long), (2, long[1000:200_000] + "!"), (3, "?" + long[-300:]), *[(k, long[5:90] + str(k)) for k in range(10, 400)]]
    assert got(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block=1 << 16)) == brute(rows)


def test_query_over_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = queries.QUERIES["op12_suffix_dedup"](spark, sf_dir)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got(out) == want and any(0 < w[2] < w[1] for w in want)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
