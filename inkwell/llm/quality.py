"""Quality classifier: a byte-level convolutional network, trained and run in numpy.

A text is cut into overlapping chunks that cover all of it. In a chunk, bytes become short vectors,
filters slide over them, and each filter's largest response is kept. A chunk's responses give a few
hidden features; the mean and the maximum of these over all chunks give one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import bound_batches, column_of, fold_of, text_blocks

CHUNK, STEP = 768, 640  # bytes; neighbours share 128
WIDTH, STRIDE = 8, 2
BYTE_SIZE, FILTERS, HIDDEN = 6, 32, 16
#: Labelled rows that train, at most (about; chosen by hash), and their longest text in bytes.
TRAIN_ROWS, TRAIN_BYTES = 2400, 1 << 15
EPOCHS, BATCH, RATE = 7, 24, 4e-3
THRESHOLD = 0.3
BLOCK = 1 << 17
_PLACES = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the rows of a block as rows of bytes, 0 after a text's end, and the row of each."""
    sizes = np.diff(offs)
    counts = 1 + np.maximum(0, -(-(sizes - CHUNK) // STEP))
    owner = np.repeat(np.arange(len(sizes)), counts)
    begin = offs[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STEP
    at = begin[:, None] + np.arange(CHUNK)
    inside = at < offs[owner + 1][:, None]
    padded = np.append(buf, np.uint8(0))
    return padded[np.where(inside, at, len(buf))], owner


def first_weights(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    kinds = np.zeros((256, BYTE_SIZE), np.float32)
    b = np.arange(256)
    kinds[(b >= 97) & (b <= 122), 0] = 1
    kinds[(b >= 65) & (b <= 90), 1] = 1
    kinds[(b >= 33) & (b <= 47) | (b >= 58) & (b <= 64) | (b >= 91) & (b <= 96) | (b >= 123) & (b <= 126), 2] = 1
    kinds[(b == 32) | (b >= 9) & (b <= 13), 3] = 1
    kinds[(b >= 48) & (b <= 57), 4] = 1
    kinds[b >= 128, 5] = 1
    table = kinds + rng.normal(0, 0.35, kinds.shape).astype(np.float32)
    table[0] = 0
    return {
        "bytes": table,
        "filters": rng.normal(0, 0.3, (WIDTH * BYTE_SIZE, FILTERS)).astype(np.float32),
        "shift": np.zeros(FILTERS, np.float32),
        "hidden": rng.normal(0, 0.25, (FILTERS + 1, HIDDEN)).astype(np.float32),
        "hidden_shift": np.full(HIDDEN, 0.1, np.float32),
        "out": rng.normal(0, 0.2, 2 * HIDDEN).astype(np.float32),
        "out_shift": np.zeros(1, np.float32),
    }


def _windows(net, x):
    vectors = np.ascontiguousarray(net["bytes"][x])
    n = len(x)
    row, place, item = vectors.strides
    view = np.lib.stride_tricks.as_strided(vectors, (n, _PLACES, WIDTH * BYTE_SIZE), (row, place * STRIDE, item), writeable=False)
    return view.reshape(n * _PLACES, WIDTH * BYTE_SIZE)


def _pooled(net, x):
    """Each filter's largest response in each chunk, and the chunk's share of bytes that are text."""
    response = (_windows(net, x) @ net["filters"]).reshape(len(x), _PLACES, FILTERS)
    best = np.maximum(0, response.max(axis=1) + net["shift"])
    full = (x != 0).mean(axis=1, dtype=np.float32)
    return response, np.hstack([best, full[:, None]])


def _combine(net, features, owner, rows):
    """Mean and maximum of the chunks' hidden features in each row, and the row's logit."""
    hidden = np.maximum(0, features @ net["hidden"] + net["hidden_shift"])
    starts = np.searchsorted(owner, np.arange(rows))
    total = np.add.reduceat(hidden, starts, axis=0)
    count = np.bincount(owner, minlength=rows)[:, None].astype(np.float32)
    mean, top = total / count, np.maximum.reduceat(hidden, starts, axis=0)
    return hidden, mean, top, np.hstack([mean, top]) @ net["out"] + net["out_shift"][0]


def predict(net, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The probability of label 1 for each row of a block; chunks are run 64 at a time."""
    x, owner = chunks_of(buf, offs)
    features = np.vstack([_pooled(net, x[k : k + 64])[1] for k in range(0, len(x), 64)])
    logit = _combine(net, features, owner, len(offs) - 1)[3]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))


def gradients(net, x, owner, y, weight):
    """Loss gradients of a batch of rows; through the maxima only their own places count."""
    rows = len(y)
    response, features = _pooled(net, x)
    hidden, mean, top, logit = _combine(net, features, owner, rows)
    p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    g = ((p - y) * weight / rows).astype(np.float32)
    both = np.hstack([mean, top])
    out = {"out": both.T @ g, "out_shift": np.array([g.sum()], np.float32)}
    count = np.bincount(owner, minlength=rows).astype(np.float32)
    g_mean, g_top = g[:, None] * net["out"][:HIDDEN], g[:, None] * net["out"][HIDDEN:]
    at_top = hidden == top[owner]
    ties = np.add.reduceat(at_top.astype(np.float32), np.searchsorted(owner, np.arange(rows)), axis=0)
    g_hidden = (g_mean / count[:, None])[owner] + np.where(at_top, (g_top / ties)[owner], 0)
    g_hidden = np.where(hidden > 0, g_hidden, 0).astype(np.float32)
    out |= {"hidden": features.T @ g_hidden, "hidden_shift": g_hidden.sum(axis=0)}
    g_best = np.where(features[:, :FILTERS] > 0, g_hidden @ net["hidden"][:FILTERS].T, 0).astype(np.float32)
    out["shift"] = g_best.sum(axis=0)
    place = response.argmax(axis=1)  # chunk, filter
    own = x[np.arange(len(x))[:, None, None], (place * STRIDE)[:, :, None] + np.arange(WIDTH)]  # chunk, filter, width
    vectors = net["bytes"][own].reshape(len(x), FILTERS, WIDTH * BYTE_SIZE)
    out["filters"] = np.einsum("cf,cfk->kf", g_best, vectors)
    g_vectors = (g_best[:, :, None] * net["filters"].T[None]).reshape(-1, BYTE_SIZE)
    table = np.zeros((256, BYTE_SIZE), np.float32)
    for k in range(BYTE_SIZE):
        table[:, k] = np.bincount(own.reshape(-1), g_vectors[:, k], minlength=256)
    table[0] = 0
    return out | {"bytes": table}


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on batches of whole texts, the rarer label weighing up to four times as much."""
    net = first_weights(seed)
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():  # one label: nothing to tell apart
        net["out"][:] = 0
        net["out_shift"][:] = 0 if not len(y) else (4 if y[0] else -4)
        return net
    rare = np.float32(y.mean() > 0.5)
    ratio = min(4.0, max(1.0, (y != 1 - rare).sum() / max(1, (y == 1 - rare).sum())))
    first, second = {k: np.zeros_like(v) for k, v in net.items()}, {k: np.zeros_like(v) for k, v in net.items()}
    step, total = 0, epochs * -(-len(y) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            own = order[lo : lo + BATCH]
            data = [np.frombuffer(texts[i], np.uint8) for i in own]
            x, owner = chunks_of(np.concatenate(data), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
            got = gradients(net, x, owner, y[own], np.where(y[own] == 1 - rare, ratio, 1).astype(np.float32))
            step += 1
            rate = RATE * min(1.0, step / 20) * (1 - step / (total + 1))
            for k, g in got.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net[k] = (net[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def train_quality(docs: DataFrame, labels: DataFrame, may_train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> dict[str, np.ndarray]:
    """Fit on a bounded sample of labelled rows: by hash, about half of them of each label if there
    are enough, of texts of up to ``TRAIN_BYTES`` bytes. Conflicting labels of one id count each, equal
    rows once; however often an id repeats, a quarter more than ``rows`` is the most that is taken."""
    most = rows + rows // 4
    marks = labels.select(F.col(id_col).alias("_label_id"), F.col(label_col).alias("_y")).where("_y is not null")
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(may_train & F.col("_text").isNotNull() & (F.octet_length("_text") <= TRAIN_BYTES))
    sizes = {r[0]: r[1] for r in marks.groupBy("_y").count().collect()}
    chance = F.lit(0.0)
    for y, n in sizes.items():
        chance = F.when(F.col("_y") == y, F.lit(min(1.0, rows / 2 / n))).otherwise(chance)
    chosen = marks.where(F.pmod(F.xxhash64(F.lit(5), "_label_id"), F.lit(1_000_000)) < chance * 1_000_000).distinct().orderBy(F.xxhash64("_label_id", "_y"), "_label_id", "_y").limit(most)
    got = known.join(F.broadcast(chosen), F.col("_id") == F.col("_label_id")).select("_id", "_y", "_text").dropDuplicates()
    got = got.orderBy(F.xxhash64("_text", "_id", "_y"), "_id", "_y", "_text").limit(most).toArrow().sort_by([(c, "ascending") for c in ("_id", "_text", "_y")])
    texts = got["_text"].combine_chunks().cast(pa.binary()).to_pylist() if got.num_rows else []
    return train(texts, (np.array(got["_y"].to_pylist(), np.float64) > 0).astype(np.float32), epochs)


def _score(shared, text_col: str):
    def run(batches):
        net = shared.value
        for batch in batches:
            scores = [predict(net, buf, offs) for _, _, buf, offs in text_blocks(column_of(batch, text_col), BLOCK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*scores, np.zeros(0)]))], names=[*batch.schema.names, "_q_score"])

    return run


def with_quality(docs: DataFrame, net: dict, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and _q_score, which they must not have; null reads as empty. No row is shuffled."""
    if "_q_score" in docs.columns:
        raise ValueError("docs has a column _q_score already")
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.select("*", F.lit(0.0).alias("_q_score")).schema
    return docs.mapInArrow(_score(shared, text_col), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, threshold: float = THRESHOLD, **options) -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Labels of the held-out fold (crc32 of the id) train nothing; null labels neither. Only the text
    is scored, all of it. Null and empty texts get the network's score of no bytes. With one label or
    none the score is constant. Ids may be null or repeat; empty tables give no rows.
    """
    net = train_quality(docs, labels, fold_of("_id", folds) != held_fold, id_col, text_col, label_col, **options)
    rows = docs.select(F.col(id_col).alias("_id"), (fold_of(id_col, folds) == held_fold).alias("_held"), F.col(text_col).alias("_text"))
    return with_quality(rows, net, "_text").select(F.col("_id").alias(id_col), F.col("_held").alias("held_out"), F.col("_q_score").alias("score"), (F.col("_q_score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    net = train_quality(docs, labels, fold_of("_id", folds) != held_fold, id_col, text_col, label_col, **options)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # the names of docs may be any
    kept = with_quality(plain, net, plain.columns[docs.columns.index(text_col)]).where(F.col("_q_score") >= threshold)
    return kept.select(*[F.col(c).alias(n) for c, n in zip(plain.columns, docs.columns, strict=True)])
