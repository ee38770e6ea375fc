"""Queries without SQL against plain versions of what they mean."""

from __future__ import annotations

from inkwell.operators.learning import best_match
from inkwell.plans import catalogue


def blocks(a, b):
    """Matching blocks: the longest common run, the earliest in a and then in b, and so on at either side."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[2]:
                best = (i, j, n)
    i, j, n = best
    if not n:
        return []
    return [*blocks(a[:i], b[:j]), (i, j, n), *[(x + i + n, y + j + n, k) for x, y, k in blocks(a[i + n :], b[j + n :])]]


def plain_ratio(a, b):
    return 2 * sum(n for _, _, n in blocks(a, b)) / (len(a) + len(b)) if a or b else 1.0


def plain_diff(before, after):
    one, two = ([x.strip() for x in t.split("\n\n") if x.strip()] for t in (before, after))
    out, i, j = [], 0, 0
    for x, y, n in [*blocks(one, two), (len(one), len(two), 0)]:
        if x > i or y > j:
            kind = "replace" if x > i and y > j else "delete" if x > i else "insert"
            out.append((kind, "\n\n".join(one[i:x]), "\n\n".join(two[j:y])))
        i, j = x + n, y + n
    return out


def parts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey").collect()
    key = lambda r: " ".join("".join(c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in f"{r.p_name} {r.p_type}".lower()).split())
    return [(r.p_partkey, r.p_brand, r.p_type, key(r)) for r in rows]


def test_sequence_ratio(spark, sf_dir):
    got = {r.p_partkey: r.ratio for r in catalogue.QUERIES["rule_sequence_ratio"](spark, sf_dir).collect()}
    brands = {}
    for k, brand, _, key in parts(spark, sf_dir):
        brands.setdefault(brand, []).append((k, key))
    pairs = [(k, a, b) for own in brands.values() for (k, a), (_, b) in zip(own, own[1:])]
    assert set(got) == {k for k, _, _ in pairs} and len(got) > 100
    for k, a, b in pairs:
        assert abs(got[k] - plain_ratio(a, b)) < 1e-6, (a, b)


def test_structured_diff(spark, sf_dir):
    got = {}
    for r in catalogue.QUERIES["structured_diff"](spark, sf_dir).orderBy("conv_id", "turn", "pos").collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.operation, r.before, r.after))
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, (r.text or "").replace("\n", "\n\n")))
    want = {(c, t): plain_diff(a, b) for c, own in turns.items() for (t, a), (_, b) in zip(own, own[1:])}
    assert got == {k: v for k, v in want.items() if v} and got
    assert plain_diff("a\n\nb\n\nc", "a\n\nx\n\nc\n\nd") == [("replace", "b", "x"), ("insert", "", "d")]


def test_rule_match_best(spark, sf_dir):
    """Equal keys first; else the best of ratio, overlap and containment over its bound, ties to the earlier."""
    got = {int(r.candidate_id): r.rule_id and int(r.rule_id) for r in catalogue.QUERIES["rule_match_best"](spark, sf_dir).collect()}
    rows = parts(spark, sf_dir)
    assert set(got) == {k for k, _, _, _ in rows}
    for k, brand, kind, key in rows:
        earlier = [(i, x) for i, b, c, x in rows if i < k and b == brand and c == kind]
        equal = [i for i, x in earlier if x == key]
        best, top = (equal[0] if equal else None), 0.0
        for i, x in () if equal else earlier:
            one, two = set(x.split()), set(key.split())
            shared = len(one & two) / len(one | two)
            score = max(plain_ratio(x, key), shared, 0.92 if key in x or x in key else 0)
            if score > top and (score >= 0.86 or shared >= 0.6):
                best, top = i, score
        assert got[k] == best
    assert best_match([{"category": "a", "normalized_key": "use short words", "rule_id": 1}], "b", "use short words") is None


def test_text_chunks_by_lateral_join(spark, sf_dir):
    rows = lambda name: sorted(tuple(r) for r in catalogue.QUERIES[name](spark, sf_dir).collect())
    assert rows("text_chunks_udtf") == rows("text_chunks")


def test_text_chunks(spark, sf_dir):
    """Every chunk stands where it says, within the size, with the overlap at most, and nothing but white
    space falls between them."""
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = {}
    for r in catalogue.QUERIES["text_chunks"](spark, sf_dir).orderBy("doc_id", "chunk_index").collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert set(rows) == {i for i, t in texts.items() if t and t.strip()}
    for i, own in rows.items():
        text = texts[i]
        assert [r.chunk_index for r in own] == list(range(len(own)))
        for r in own:
            assert text[r.char_start : r.char_end] == r.text == r.text.strip() and len(r.text) <= 2000 and (r.page_start, r.page_end) == (1, 1)
        assert not text[: own[0].char_start].strip() and not text[own[-1].char_end :].strip()
        for a, b in zip(own, own[1:]):
            assert a.char_start < b.char_start and a.char_end - b.char_start <= 400 and not text[a.char_end : max(a.char_end, b.char_start)].strip()
            assert a.char_end < b.char_end
