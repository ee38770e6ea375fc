from __future__ import annotations

import zlib

import numpy as np

from inkwell.llm.common import fold_of
from inkwell.llm.langid import family_of, identify_languages, train_languages, trigram_features

SCHEMA = "doc_id long, text string, lang string, held_out string, score int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, v, "x", 1) for i, t, v in rows], SCHEMA)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = identify_languages(docs)
    again = {r.doc_id: r for r in identify_languages(docs.repartition(5)).collect()}
    rows = out.join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(again[r.doc_id].lang_pred == r.lang_pred for r in rows) >= 999


def test_edges(spark):
    train = [(i, f"der die das und ist {i}" if i % 2 else f"the and of is it {i}", "de" if i % 2 else "en") for i in range(60)]
    train += [(100 + i, "que el la de los una", "es") for i in range(30)] + [(200 + i, "слово и дело", "ru") for i in range(30)]
    odd = [(900, None, "en"), (901, "", None), (902, "123 !!! ...", "en"), (903, "una " * 40000, None), (None, "the and of it", None), (905, "слово", None), (905, "слово", None)]
    got = {}
    for r in identify_languages(rows_of(spark, train + odd)).collect():
        got.setdefault(r.doc_id, r)
    assert got[900].lang_pred == got[901].lang_pred == got[902].lang_pred == "und" and got[900].score == 0
    assert got[903].lang_pred == "es" and got[905].lang_pred == "ru" and got[None].lang_pred == "en"
    assert identify_languages(rows_of(spark, [])).count() == 0
    untrained = identify_languages(rows_of(spark, [(1, "words", None)])).collect()
    assert untrained[0].lang_pred == "und" and untrained[0].score == 0
    single = identify_languages(rows_of(spark, [(i, "words of one", "en") for i in range(9)])).collect()
    assert {r.lang_pred for r in single} == {"en"}


def test_families():
    assert family_of("en") == family_of("de") != family_of("fr") == family_of("es") and family_of("xx") == "only xx"


def plain_features(text, features=1 << 13):
    """Features of the letter trigrams of a text, byte by byte."""
    data = [b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in text.encode()]
    out = []
    for k, b in enumerate(data):
        if b:
            code = (data[k - 1] if k else 0) << 16 | b << 8 | (data[k + 1] if k + 1 < len(data) else 0)
            code = (code * 0x9E3779B1) % 2**32 ^ (code >> 7)
            out.append((code * 0x85EBCA6B) % 2**32 >> (32 - 13))
    return out


def test_margins_and_votes_recomputed_plainly(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = train_languages(docs, fold_of("doc_id", 3) != 1)
    texts = [r.text for r in docs.limit(60).collect()] + ["Ünï 12 cödé", "a"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    margins = model.margins(*trigram_features(buf, offs))
    names, scores = model.predict(margins)
    for t, m, name in zip(texts, margins, names):
        code = plain_features(t)
        want = [sum(float(model.weights[c, k]) for c in code) / len(code) + float(model.bias[k]) for k in range(model.weights.shape[1])]
        assert np.allclose(m, want, atol=1e-4)
        family = max(range(len(model.families)), key=lambda f: want[f])
        own = model.members[family]
        wins = {i: sum((want[len(model.families) + k] > 0) == (a == i) for k, (a, b) in enumerate(model.pairs) if i in (a, b)) for i in own}
        assert wins[model.langs.index(name)] == max(wins.values())
    assert all(0 <= s <= 1 for s in scores)
    few = train_languages(docs, fold_of("doc_id", 3) != 1, languages=2, train_rows=20)
    assert len(few.langs) == 2
