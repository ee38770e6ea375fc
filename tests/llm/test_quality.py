from __future__ import annotations

import zlib

import numpy as np

from inkwell.llm.quality import CHUNK, STEP, chunks_of, first_weights, gradients, keep_good, predict, quality_scores, train

SCHEMA = "doc_id long, text string, score string, quality int"


def block(texts):
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    return np.concatenate([*data, np.zeros(0, np.uint8)]).astype(np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def test_chunks_cover_every_byte_of_every_text():
    texts = ["", "a", "b" * CHUNK, "c" * (CHUNK + 1), "xyz" * 3000, ""]
    buf, offs = block(texts)
    x, owner = chunks_of(buf, offs)
    for r, t in enumerate(texts):
        own = [bytes(c) for c, o in zip(x, owner) if o == r]
        assert own and own[0].rstrip(b"\0") == t.encode()[:CHUNK]
        joined = b"".join(c[:STEP] for c in own[:-1]) + own[-1].rstrip(b"\0")
        assert joined == t.encode()
        if len(t) > CHUNK:
            assert all(a[STEP:] == b[: CHUNK - STEP] for a, b in zip(own[:-1], own[1:]))


def test_gradients_are_those_of_the_loss():
    net = {k: v.astype(np.float64) for k, v in first_weights(3).items()}
    net["shift"] = net["shift"] + 0.013  # at 0 the responses of padding stand on the kink, where no slope is
    buf, offs = block(["Some Words, and more " * 90, "!!! ### " * 30, "kurz"])
    x, owner = chunks_of(buf, offs)
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])

    def loss(n):
        p = predict(n, buf, offs)
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    got = gradients(net, x, owner, y, weight)
    rng = np.random.default_rng(0)
    for name in net:
        flat = np.abs(got[name]).reshape(-1)
        for at in {int(flat.argmax()), int(rng.choice(np.flatnonzero(flat)))} if flat.any() else ():
            up, down = ({k: v.copy() for k, v in net.items()} for _ in range(2))
            up[name].reshape(-1)[at] += 1e-5
            down[name].reshape(-1)[at] -= 1e-5
            slope = (loss(up) - loss(down)) / 2e-5
            assert abs(slope - got[name].reshape(-1)[at]) < 2e-3 * max(1, abs(slope)) + 1e-4, name


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id")
    rows = quality_scores(some, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r.predicted for r in held if r.quality == 1], [r.predicted for r in held if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.15


def test_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, None, 1), (None, 1, 1)], "doc_id long, quality int, text int")
    rows = [(i, "fine words here " * (i + 1) if i % 2 else "$$$ %%% " * (i + 1), "s", 0) for i in range(40)]
    rows += [(50, None, None, None), (51, "", "s", 0), (52, "long text " * 30000, "s", 0), (None, "fine words", "s", 0), (53, "x", "s", 0), (53, "x", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = quality_scores(docs, labels, epochs=2).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in out if r.doc_id == 50} == {r.score for r in out if r.doc_id == 51}
    kept = keep_good(docs, labels, epochs=2)
    assert kept.columns == docs.columns
    assert quality_scores(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert quality_scores(docs, labels.limit(0)).count() == len(rows)


def test_training_is_repeatable():
    texts, y = [b"good words " * 9, b"### $$$ " * 9] * 12, np.array([1, 0] * 12)
    one, two = train(texts, y, 1), train(texts, y, 1)
    assert all((one[k] == two[k]).all() for k in one)


def plain_probability(net, text):
    """The network by loops over chunks, places and filters."""
    data = text.encode()
    chunks = [data[k : k + CHUNK] for k in range(0, max(1, len(data) - CHUNK + STEP if len(data) > CHUNK else 1), STEP)]
    hidden = []
    for chunk in chunks:
        row = chunk + bytes(CHUNK - len(chunk))
        vectors = [net["bytes"][b].astype(float) for b in row]
        best = np.full(net["filters"].shape[1], -np.inf)
        for at in range(0, CHUNK - 8 + 1, 2):
            best = np.maximum(best, np.concatenate(vectors[at : at + 8]) @ net["filters"].astype(float))
        features = [*np.maximum(0, best + net["shift"]), sum(b != 0 for b in row) / CHUNK]
        hidden.append(np.maximum(0, np.array(features) @ net["hidden"].astype(float) + net["hidden_shift"]))
    both = np.concatenate([np.mean(hidden, axis=0), np.max(hidden, axis=0)])
    return 1 / (1 + np.exp(-(both @ net["out"].astype(float) + net["out_shift"][0])))


def test_probabilities_recomputed_plainly():
    rng = np.random.default_rng(4)
    net = train([b"good words " * 30, b"### $$$ " * 40] * 12, np.array([1, 0] * 12), 1)
    texts = ["", "a", "x y z " * 100, "Größe " * 128, "mixed ### words " * 300, "".join(chr(c) for c in rng.integers(32, 500, 3000))]
    for t, p in zip(texts, predict(net, *block(texts))):
        assert abs(p - plain_probability(net, t)) < 1e-4
