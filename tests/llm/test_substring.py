from __future__ import annotations

import random
import re

import numpy as np
import pytest

from inkwell.llm import substring
from inkwell.llm.substring import boundaries, chunk_window, drop_repeats, gear_hashes, repeated_passages

SCHEMA = "doc_id long, text string, kept string, _key int, _cut int, n_words int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(rng, n, letters="abcdefghijklmnopqrstuvwxyzé", most=9):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0, 1, 2) for i, t in rows], SCHEMA).repartition(3)


def brute(rows, m=50):
    """{(id, first byte, byte after, words, whether other texts lead no window)} by all windows."""
    texts = {}
    for i, t in rows:
        texts.setdefault((t or "").encode(), set()).add(i)
    at = {t: [w.span() for w in WORD.finditer(t)] for t in texts}
    owners = {}
    for t, spans in at.items():
        w = [t[a:b] for a, b in spans]
        for k in range(len(w) - m + 1):
            owners.setdefault(tuple(w[k : k + m]), set()).add(t)
    out = set()
    for t, ids in texts.items():
        spans = at[t]
        if len(ids) > 1:
            if len(spans) >= m:
                out |= {(i, spans[0][0], spans[-1][1], len(spans)) for i in ids}
            continue
        w = [t[a:b] for a, b in spans]
        hit = [len(owners[tuple(w[k : k + m])]) > 1 for k in range(len(w) - m + 1)]
        for k in np.flatnonzero(hit):
            if k == 0 or not hit[k - 1]:
                e = k
                while e + 1 < len(hit) and hit[e + 1]:
                    e += 1
                out |= {(i, spans[k][0], spans[e + m - 1][1], e - k + m) for i in ids}
    return out


def found(spark, rows, **options):
    out = repeated_passages(frame(spark, rows), **options).collect()
    got = {(r.doc_id, r.span_start, r.span_end, r.n_words) for r in out}
    assert len(got) == len(out)
    return got, out


def test_gear_is_the_rolling_hash_and_chunks_resist_shifts():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    h, slow = 0, []
    for x in w.tolist():
        h = ((h << 13) + x) % 2**64
        slow.append(h >> 32)
    assert gear_hashes(w, 5).tolist() == slow
    gear, window = chunk_window(50)
    cut = boundaries(gear_hashes(w, gear), np.array([0, len(w)]), gear, window)
    assert np.diff(cut).max() <= window and 3 * window <= 50 - gear + 1
    longer = np.concatenate([w[:500], w[:3], w[500:]])
    moved = boundaries(gear_hashes(longer, gear), np.array([0, len(longer)]), gear, window)
    assert {c - 3 for c in moved if c > 540} == {c for c in cut if c > 537}
    short = boundaries(gear_hashes(w[:7], gear), np.array([0, 4, 7]), gear, window)
    assert len(short) == 0


@pytest.mark.parametrize("kind", ["words", "letters", "one word", "numbers"])
def test_every_passage_of_every_kind_is_found_exactly(spark, kind):
    rng = random.Random(kind)
    make = {"words": lambda n: words(rng, n), "letters": lambda n: words(rng, n, "abcd", 1), "one word": lambda n: " ".join(["so"] * n), "numbers": lambda n: " ".join(str(rng.randint(1, 99)) for _ in range(n))}[kind]
    rows, line = [], words(rng, 12)
    for i in range(60):
        passage = make(rng.choice([49, 50, 51, 55, 60, 120]))
        for k in range(2 + 3 * (i % 10 == 0)):
            rows.append((10 * i + k, f"{line}\n{words(rng, rng.randint(0, 60))} {passage}\t{words(rng, rng.randint(0, 60))} {line}"))
    got, out = found(spark, rows)
    want = brute(rows)
    assert got == want and len(want) > 60
    text = {i: t.encode().split() for i, t in rows}
    raw = {i: t.encode() for i, t in rows}
    for r in out[:80]:  # the first window is in the document named
        one, own = raw[r.doc_id][r.span_start : r.span_end].split()[:50], text[r.other_doc_id]
        assert r.other_doc_id != r.doc_id and any(own[k : k + 50] == one for k in range(len(own) - 49))


def test_tables_copies_and_edges_against_brute_force(spark, sf_dir):
    rng = random.Random(9)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    text, inner = words(rng, 200), words(rng, 70)
    more = [(9003, text), (9003, text), (9009, text), (None, text), (9004, None), (9005, ""), (9006, " "), (9007, f"{inner} {words(rng, 20)} {inner}"), (9008, words(rng, 30000)), (9010, text[300:])]
    got, out = found(spark, docs + more)
    want = brute(docs + more)
    assert got == want and want
    assert sum(r.kept for r in out if r.n_words == 200 and r.doc_id in (9003, 9009, None)) <= 1
    assert repeated_passages(frame(spark, [(3, text), (3, text)])).count() == 0
    assert repeated_passages(frame(spark, []).limit(0)).count() == 0
    assert found(spark, docs[:60] + more, min_words=7)[0] == brute(docs[:60] + more, 7)


def test_keys_that_clash_are_parted(spark, monkeypatch):
    rng = random.Random(2)
    passage = words(rng, 60)
    rows = [(i, f"{words(rng, 20)} {passage} {words(rng, 20)}") for i in range(6)]
    keyed = substring._keyed
    monkeypatch.setattr(substring, "_keyed", lambda *a: keyed(*a).withColumn("_key", substring.F.lit(7).cast("long")))
    assert found(spark, rows)[0] == brute(rows)


def test_what_is_dropped_stays_somewhere(spark):
    rng = random.Random(5)
    passages = [words(rng, n) for n in (51, 60, 80, 120, 300)]
    rows = []
    for i in range(120):
        body = words(rng, rng.randint(30, 200)).split()
        at = rng.randint(0, len(body))
        rows.append((i, " ".join([*body[:at], passages[i // 3 % 5], *body[at:]]) if i % 3 == 0 else " ".join(body)))
    copy = words(rng, 90)
    rows += [(200, copy), (201, copy), (None, copy), (202, None), (202, ""), (203, "short")]
    docs = frame(spark, rows)
    cut = drop_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    left = [r.text or "" for r in cut.collect()]
    for p in [*passages, copy]:
        assert sum(p in t for t in left) == 1
        assert sum(p[100:160] in t for t in left) == 1
    touched = {i for i, _, _, _ in brute(rows)}
    own = {r.doc_id: r.text for r in cut.collect()}
    assert all(own[i] == t for i, t in rows if i not in touched and i != 202) and own[200] == copy
    assert repeated_passages(cut).count() == 0
    total = {w for _, t in rows for w in (t or "").split()}
    assert total == {w for t in left for w in t.split()}
