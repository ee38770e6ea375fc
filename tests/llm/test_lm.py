from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm.lm import CLASSES, _class_profiles, _forward_one, _profiles, discounts, expected_pieces, find_classes, lattice_table, load_pieces, score_texts, spelled, word_scores

SCHEMA = "doc_id long, text string, score string, word int"
PIECES = [b" ", b"a", b"b", b" a", b"ab", b"ba", b"bab", b"abab"]
WEIGHTS = np.array([0.2, 0.1, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1])


def segmentations(word):
    if not word:
        yield ()
    for k in range(1, len(word) + 1):
        if word[:k] in PIECES:
            for rest in segmentations(word[k:]):
                yield (word[:k], *rest)


@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=9), min_size=1, max_size=6))
@settings(max_examples=40, deadline=None)
def test_lattice_is_the_sum_over_segmentations(words):
    table = lattice_table(PIECES, np.array([WEIGHTS[::-1] * 0.5, WEIGHTS * 0.8]), np.array([0.5, 0.2]))
    words = [w.encode() for w in words]
    weight = dict(zip(PIECES, WEIGHTS * 0.8))
    expected = Counter()
    for w, got in zip(words, spelled(table, words)[:, 1]):
        ways = [(math.prod(weight[p] for p in s), s) for s in segmentations(b" " + w)]
        total = sum(p for p, _ in ways)
        assert abs(got - math.log(total * 0.2)) < 1e-9
        assert abs(_forward_one(table, b" " + w, 1) - math.log(total)) < 1e-9
        for p, s in ways:
            for piece in s:
                expected[piece] += p / total
    assert np.allclose(expected_pieces(table, words, np.ones(len(words), np.int64), np.ones(len(words)))[1], [expected[p] for p in PIECES])


def test_vocabulary_covers_every_byte():
    pieces, weights = load_pieces()
    assert all(bytes([b]) in set(pieces) for b in range(256)) and abs(weights.sum() - 1) < 1e-9 and len(pieces) > 10_000


def brute_base(rows):
    tokens = lambda t: [*"".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split(), b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = counts.total(), len(counts)
    return [(i, held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t))) for i, t in rows]


def check(spark, rows, **options):
    out = score_texts(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), **options).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    want = sorted(brute_base(rows), key=key)
    got = sorted(map(tuple, out), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-6 and g[6] < 0
    return got


ROWS = [(i, f"Common words here {i % 7} und so weiter n{i}") for i in range(50)] + [(60, None), (61, ""), (62, "x" * 3000 + " Ünïcode ünïcode\x0bZ"), (None, "common"), (63, "common"), (63, "common"), (64, "only held " * 5)]


def brute_score(rows, words_as_edges, kinds, classes, rounds=2):
    """log10 probabilities by enumerated segmentations; ``kinds`` has the class of each row's text."""
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    train = [(tokens(t), z) for (i, t), z in zip(rows, kinds) if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    counts = Counter(w for t, _ in train for w in t)
    by_class = [Counter(w for t, y in train if y == z for w in t) for z in range(classes)]
    pieces, first = load_pieces()
    prior = dict(zip(pieces, first))
    if words_as_edges:
        more = [b" " + w for w in counts if 0 < len(w) < 16 and b" " + w not in prior]
        prior = {p: v * 0.9 for p, v in prior.items()} | {p: 0.1 / len(more) for p in more}

    def ways(word):
        if not word:
            yield ()
        for k in range(1, len(word) + 1):
            if word[:k] in prior:
                for rest in ways(word[k:]):
                    yield (word[:k], *rest)

    n, v, once, twice = counts.total(), sum(w != b"" for w in counts), sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
    texts = [c[b""] for c in by_class]
    chances = []
    for z, own in enumerate(by_class):
        weight, end = {p: x * 0.75 for p, x in prior.items()}, 0.25
        for _ in range(rounds):
            uses, many = Counter({p: 10 * x for p, x in prior.items()}), 0
            for w in counts:
                if w and max(range(classes), key=lambda y: by_class[y][w]) == z:
                    often = 1 if words_as_edges else counts[w]
                    many += often
                    found = [(math.prod(weight[p] for p in s), s) for s in ways(b" " + w)]
                    whole = sum(p for p, _ in found)
                    for p, s in found:
                        for piece in s:
                            uses[piece] += p / whole * often
            total = uses.total() + many + 1
            weight, end = {p: x / total for p, x in uses.items()}, (many + 1) / total
        spell = lambda w, weight=weight, end=end: end * sum(math.prod(weight[p] for p in s) for s in ways(b" " + w))
        mix = lambda c, all_, own=own: 0.97 * c / (own.total() + 1) + 0.03 * all_ / (n + 1)
        d = (once + 1) / (once + 2 * twice + 2)
        left = 1 - sum(mix(own[w] * (1 - d / c), c - d) for w, c in counts.items() if w) - mix(own[b""] + 1 - d, counts[b""] + 1 - d)
        share = (len(train) + 1) / (n + 2)

        def chance(w, own=own, spell=spell, mix=mix, left=left):
            if not words_as_edges:
                return (1 - share) * spell(w) if w else share
            if not w:
                return mix(own[w] + 1 - d, counts[w] + 1 - d)
            c = counts[w]
            return (mix(own[w] * (1 - d / c), c - d) if c else 0) + left * spell(w)

        chances.append(chance)
    return [math.log10(sum((texts[z] + 1) / (sum(texts) + classes) * math.prod(chances[z](w) for w in tokens(t)) for z in range(classes))) for _, t in rows]


TEXTS = ["the cat sat", "The dog sat on", "a cat", None, "", "zzz qx the", "é cat", "the the the", "new dog", "on a mat", "sat zq", "a cat.", "dog, cat"]


def test_score_against_enumerated_segmentations(spark):
    rows = list(enumerate(TEXTS))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    profiles = frame.where("crc32(cast(string(doc_id) as binary)) % 7 != 2").select("text").mapInArrow(_class_profiles, "x array<float>").checkpoint()
    raw = [(t or "").encode() for _, t in rows]
    mine = _profiles(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for options in ({}, {"classes": 1}, {"classes": 1, "words_as_edges": False}, {"words_as_edges": False}):
        classes = options.get("classes", CLASSES)
        kinds = (mine @ find_classes(profiles, classes).T).argmax(axis=1).tolist() if classes > 1 else [0] * len(rows)
        assert len(set(kinds)) > 1 or classes == 1
        got = {r.doc_id: r.score for r in score_texts(frame, **options).collect()}
        for (i, _), want in zip(rows, brute_score(rows, options.get("words_as_edges", True), kinds, classes)):
            assert abs(got[i] - want) < 1e-6, (i, options)


def test_chances_of_all_words_sum_to_one():
    """Edges of words and what is left for spellings, of every class, for any counts."""
    rng = np.random.default_rng(5)
    table = lattice_table(PIECES, np.array([WEIGHTS] * 3), np.full(3, 0.2))
    for words in (0, 1, 2, 50):
        counts = rng.integers(0, 4, (words + 1, 3))
        counts[np.arange(words + 1), rng.integers(0, 3, words + 1)] += words > 0
        n = counts.sum(axis=1)
        totals = {"words_as_edges": True, "tokens": n.sum() if words else 0, "distinct": words, "once": (n == 1).sum(), "twice": (n == 2).sum(), "spelt": words, "texts": 0.0}
        if not words:
            counts[:], n[:] = 0, 0
        totals |= {"by_class": counts.sum(axis=0), "parts": (counts[1:] / np.maximum(n[1:], 1)[:, None]).sum(axis=0)}
        names = [b"", *(b"ab" * (k // 2 + 1) + b"a" * (k % 2) for k in range(words))]
        chance = 10 ** word_scores(table, totals, names, np.column_stack([n, counts]).astype(float))[1]
        _, left = discounts(totals)
        edges = chance.sum(axis=0) - left * np.exp(spelled(table, names[1:])).sum(axis=0)
        assert np.allclose(edges + left, 1) and (left > 0).all()


def test_scores_do_not_depend_on_the_head(spark):
    whole = check(spark, ROWS)
    for head in (0, 5):
        part = check(spark, ROWS, head_words=head)
        assert all(a[:5] == b[:5] and abs(a[6] - b[6]) < 1e-6 for a, b in zip(whole, part))


def test_edges(spark):
    assert score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    check(spark, [(held, "nothing to train on"), (held, None)])


def test_beats_the_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = check(spark, [(r.doc_id, r.text) for r in docs.collect()])
    held = [r for r in rows if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
    print("log10 a token:", sum(r[6] for r in held) / sum(r[2] for r in held), "base", sum(r[5] for r in held) / sum(r[2] for r in held))


def test_long_words_train_their_pieces():
    words = [b"ab" * 45 + b"bab", b"ba" * 40]
    weights = np.array([WEIGHTS, WEIGHTS])
    got = expected_pieces(lattice_table(PIECES, weights, np.array([0.5, 0.2])), words, np.ones(2, np.int64), np.ones(2))[1]
    total = lambda w: sum(_forward_one(lattice_table(PIECES, np.array([w, w]), np.array([0.5, 0.2])), b" " + x, 1) for x in words)
    for p in range(len(PIECES)):  # expected uses are the slope of the log sum by the log weight
        up, down = WEIGHTS.copy(), WEIGHTS.copy()
        up[p], down[p] = up[p] * math.exp(1e-5), down[p] * math.exp(-1e-5)
        assert abs(got[p] - (total(up) - total(down)) / 2e-5) < 1e-3
    assert got.sum() > 40
