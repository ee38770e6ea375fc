from __future__ import annotations

import random
import re

import numpy as np

from inkwell.llm.jaccard import _common, choose_bands, keep_one_of_each, near_duplicates

SCHEMA = "doc_id long, text string, class_id string, lead int"


def test_bands_reach_the_recall():
    bands, rows = choose_bands()
    assert bands * rows <= 320 and 1 - (1 - 0.8**rows) ** bands >= 0.999 and 1 - (1 - 0.4**rows) ** bands < 0.03


def test_common_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, 40)) for _ in range(30)]
    listed = lambda x: (len(x), np.repeat(np.arange(len(x)), [len(v) for v in x]), np.concatenate(x))
    got = _common(listed(sets[:12]), listed(sets[12:]))
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[12 + j])) for i in range(12) for j in range(18))


def brute(rows, threshold=0.8):
    grams = []
    for _, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            both = len(grams[i] & grams[j])
            if both and both >= threshold * len(grams[i] | grams[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    best = {}
    for i in range(n):
        if rows[i][0] is not None:
            best[root(i)] = min(best.get(root(i), rows[i][0]), rows[i][0])
    return sorted([(r[0], best.get(root(i)), links[i]) for i, r in enumerate(rows)], key=str)


def check(spark, rows):
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    out = near_duplicates(frame).collect()
    got, want = sorted([(r.doc_id, r.class_id, r.n_links) for r in out], key=str), brute(rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for (_, _, g), (_, _, w) in zip(sorted(got, key=str), sorted(want, key=str)):  # banding may miss pairs at the threshold
        assert g <= w
    assert sum(g[2] for g in got) >= 0.998 * sum(w[2] for w in want)
    return frame


def variants(rng, base, n, edits):
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        yield " ".join(words)


def test_against_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    rows = []
    for base, n, edits in ((text(150), 90, 3), (text(300), 25, 9), (text(60), 12, 1), (text(2000), 3, 20)):
        rows += [(len(rows) + k, v) for k, v in enumerate(variants(rng, base, n, edits))]
    rows += [(1000 + k, text(rng.randint(5, 80))) for k in range(80)]
    rows += [(2000, None), (2001, ""), (2002, "!!"), (2003, "two words"), (2004, "Two, words."), (2005, "a a a a a a a a a"), (2006, "a a a a a"), (None, "two words"), (2007, rows[0][1]), (2007, rows[0][1])]
    frame = check(spark, rows)
    kept = keep_one_of_each(frame)
    assert kept.columns == frame.columns
    ids = [r.doc_id for r in kept.collect()]
    want = brute(rows)
    assert sorted(map(str, ids)) == sorted({str(c) for i, c, _ in want if i == c})


def test_whole_small_table(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()])


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    check(spark, [(1, None)])
    check(spark, [(1, "alone in here")])


def test_one_row_of_each_class_stays_whatever_the_ids(spark):
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(60))
    lone = [text() for _ in range(20)]
    near, unique, twice = text(), text(), text()
    rows = [(None, t) for t in lone] + [(3, near), (7, f"{near} end"), (7, unique), (9, twice), (9, twice), (None, f"{twice} more")]
    rows += [(None, None), (None, ""), (5, "!!"), (5, "??")]
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)
    for f in (frame, frame.repartition(7)):
        got = sorted([(r.doc_id, r.text) for r in keep_one_of_each(f).collect()], key=str)
        assert got == sorted([*((None, t) for t in lone), (3, near), (7, unique), (9, twice), (None, None), (None, ""), (5, "!!"), (5, "??")], key=str)
