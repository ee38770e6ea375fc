from __future__ import annotations

import hashlib
import re

from hypothesis import given
from hypothesis import strategies as st

from inkwell.llm.exact_dedup import BASES, MODULI, combine, exact_dedup, fingerprint, normalise

SCHEMA = "doc_id long, text string, keep_id string, kept int"


def brute(rows):
    key = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(key(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[key(t)] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[key(t)]), hashlib.sha256(key(t).encode()).hexdigest()))
    return sorted(out, key=str)


@given(st.binary(max_size=80), st.binary(max_size=80), st.integers(1, 9))
def test_fingerprints_compose(left, right, chunk):
    whole = fingerprint(left + right, chunk)
    hashes = [[fingerprint(x, chunk, (m,), (b,)) for x in (left, right)] for m, b in zip(MODULI, BASES)]
    parts = [combine(*h, len(right), b, m) for h, m, b in zip(hashes, MODULI, BASES)]
    assert whole == parts[0] << 31 | parts[1] == fingerprint(left + right, 64)


@given(st.text(alphabet=" \t\n\x0b\x0c\rab\xa0\x85é", max_size=30))
def test_normalise_is_the_pattern(text):
    assert normalise(text.encode()).decode() == re.sub(r"[\x20\x09-\x0D]+", " ", text)


def check(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    out = exact_dedup(frame, **options).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out], key=str) == brute(rows)
    for sha in {r.text_sha256 for r in out}:
        kept = [r for r in out if r.text_sha256 == sha and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (None, "a b"), (None, None), (1, ""), (2, "long " * 9000), (8, "long\n" * 9000), (4, "long " * 8999 + "lone "), (6, "x"), (6, "x"), (7, None)]


def test_edges(spark):
    check(spark, ROWS)
    check(spark, [(None, None), (None, "")])
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_colliding_fingerprints_are_told_apart(spark):
    rows = [(i, f"{i % 7} {'y' * (i % 3)}") for i in range(120)]
    check(spark, rows, moduli=(2, 1), chunk=2)


def test_hot_group_is_split(spark):
    check(spark, [(i, "copy of one text") for i in range(1500)] + [(9000 + i, f"own {i}") for i in range(50)], chunk=4)
