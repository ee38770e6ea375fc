"""Hard-negative mining over a vector-approximation file.

Every vector is approximated by the cell that each of its components falls into; cells are written in
chunks, with the vectors beside them. For an anchor a table has the least value that a cell can add to
its inner product, so a lookup for each dimension gives a lower bound of the score, and the width of the
cells the upper one. Only rows whose bounds say that they may enter a list or a window are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import bound_batches, column_of, materialise

#: Bits of a cell's number, for each dimension.
BITS = 6
#: Anchors that are sent to all tasks at once, at most; there is a pass over the file for each block.
ANCHORS = 4096
#: Pairs of an anchor and a row whose bounds are held at once.
PAIRS = 1 << 21
_LAST = np.iinfo(np.int64).max


def whole(values: np.ndarray) -> np.ndarray:
    """Floored components as integers; Python's own where 64 bits may not hold them."""
    if not values.size or np.abs(values).max() < 2.0**62:
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def _room(a: np.ndarray, b: np.ndarray):
    """The integer type that holds all inner products of rows of a and b, and twice as much."""
    most = (int(np.abs(a).max()) if a.size else 0) * (int(np.abs(b).max()) if b.size else 0) * max(1, a.shape[1]) * 4
    return np.int32 if most < 2**31 else np.int64 if most < 2**63 else object


def approximate(vectors: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least value and width of each dimension's cells, and the cells of all vectors, by dimension."""
    least = vectors.min(axis=0)
    width = (vectors.max(axis=0) - least) // (1 << bits) + 1
    return least, width, ((vectors - least) // width).astype(np.uint8).T.copy()


def bounds(anchors: np.ndarray, least: np.ndarray, width: np.ndarray, cells: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (anchors x rows) of inner products by table lookup, and what the upper ones add."""
    from_, step = least[:, None] + np.arange(1 << bits) * width[:, None], (width - 1)[:, None]
    out = np.zeros((len(anchors), cells.shape[1]), anchors.dtype)
    for d in range(anchors.shape[1]):
        a = anchors[:, d, None]
        table = np.minimum(a * from_[d].astype(anchors.dtype), a * (from_[d] + step[d]).astype(anchors.dtype))
        out += table[:, cells[d]]
    return out, (np.abs(anchors) * (width - 1).astype(anchors.dtype)).sum(axis=1)


def _file(bits: int):
    """Chunks of the file: rows of a batch that have the same number of dimensions."""

    def run(batches):
        for batch in batches:
            vectors = column_of(batch, "_vector")
            lengths = vectors.value_lengths().to_numpy()
            for n in np.unique(lengths):
                own = pa.array(np.flatnonzero(lengths == n))
                part = np.floor(vectors.take(own).flatten().to_numpy(zero_copy_only=False)).reshape(len(own), n)
                least, width, cells = approximate(whole(part), bits)
                text = lambda x: [str(v) for v in x]
                columns = [[int(n)], [column_of(batch, "_id").take(own).to_pylist()], [column_of(batch, "_label").take(own).to_pylist()], [text(least)], [text(width)], [cells.tobytes()], [part.tobytes()]]
                kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["n", "ids", "labels", "least", "width", "cells", "vectors"])

    return run, "n int, ids array<long>, labels array<long>, least array<string>, width array<string>, cells binary, vectors binary"


def _chunks(batches, bits: int):
    """Of each chunk: dimensions, ids (null last), which are null, labels, vectors and approximation."""
    for batch in batches:
        for r in batch.to_pylist():
            n = r["n"]
            ids = np.array([_LAST if x is None else x for x in r["ids"]], np.int64)
            numbers = [whole(np.array([float(x) for x in r[c]])) if n else np.zeros(0, np.int64) for c in ("least", "width")]
            yield n, ids, np.array(r["labels"], np.int64), whole(np.frombuffer(r["vectors"]).reshape(len(ids), n)), *numbers, np.frombuffer(r["cells"], np.uint8).reshape(n, len(ids))


def _blocks(anchors: dict, chunk, bits: int):
    """For anchors of the chunk's dimensions, some at a time: their numbers, vectors, lower bounds and gaps."""
    n, ids, _, vectors, least, width, cells = chunk
    if n not in anchors:
        return
    at, values = anchors[n]
    room = _room(values, vectors)
    for lo in range(0, len(at), max(1, PAIRS // len(ids))):
        some = slice(lo, lo + max(1, PAIRS // len(ids)))
        a = values[some].astype(room)
        yield at[some], a, vectors.astype(room), *bounds(a, least, width, cells, bits)


def _kth(lower: np.ndarray, of: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest lower bound of the rows ``of`` for each anchor, or the least number."""
    if lower.dtype == object:
        return np.array([sorted(x[m], reverse=True)[k - 1] if m.sum() >= k else -(1 << 2000) for x, m in zip(lower, of, strict=True)], object)
    none = np.iinfo(lower.dtype).min
    if lower.shape[1] < k:
        return np.full(len(lower), none, lower.dtype)
    return np.partition(np.where(of, lower, none), lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]


def _best(a: np.ndarray, r: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """Of pairs (anchor, row) the k of greatest score for each anchor, ties by id."""
    order = np.array(sorted(range(len(a)), key=lambda i: (a[i], -scores[i], ids[r[i]])), np.int64) if scores.dtype == object else np.lexsort((ids[r], -scores, a))
    a, r, scores = a[order], r[order], scores[order]
    first = np.searchsorted(a, a)
    keep = np.arange(len(a)) - first < k
    return a[keep], r[keep], scores[keep]


def _scores(a: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [(a[i[k : k + 65536]] * v[j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _positives(anchors: dict, ids_of: np.ndarray, labels_of: np.ndarray, k: int, bits: int):
    """Of each chunk the k best rows of an anchor's label, but for those of its own id."""

    def run(batches):
        for chunk in _chunks(batches, bits):
            ids, labels = chunk[1], chunk[2]
            for at, a, v, lower, gap in _blocks(anchors, chunk, bits):
                same = (labels_of[at][:, None] == labels) & (ids_of[at][:, None] != ids)
                may = same & (lower + gap[:, None] >= _kth(lower, same, k)[:, None])
                i, j = np.nonzero(may)
                i, j, s = _best(i, j, _scores(a, v, i, j), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(at[i].astype(np.int32)), pa.array([None if x == _LAST else x for x in ids[j].tolist()], pa.int64()), pa.array(s.tolist(), pa.int64())], names=["a", "id", "score"])

    return run, "a int, id long, score long"


def _negatives(anchors: dict, ids_of: np.ndarray, labels_of: np.ndarray, positives: list, k: int, low: int, high: int, bits: int):
    """Of each chunk the k best rows of other labels in the window of each positive. ``positives`` has
    for each anchor the scores and ids of its positives."""
    deepest = max((len(p) for p in positives), default=0)

    def run(batches):
        for chunk in _chunks(batches, bits):
            ids, labels = chunk[1], chunk[2]
            for at, a, v, lower, gap in _blocks(anchors, chunk, bits):
                other, upper = labels_of[at][:, None] != labels, lower + gap[:, None]
                for n in range(deepest):
                    score = [positives[x][n][0] if n < len(positives[x]) else -1 for x in at]  # below 0 no score fits
                    kind = lower.dtype if lower.dtype == object or max(score) < 2**31 else np.int64
                    least, most = (np.array([f(s) if s >= 0 else e for s in score], kind)[:, None] for f, e in ((lambda s: -(-low * s // 100), 1), (lambda s: high * s // 100, 0)))
                    sure = other & (lower >= least) & (upper <= most)
                    may = other & (lower <= most) & (upper >= least) & (upper >= _kth(lower, sure, k)[:, None]) & (least <= most)
                    i, j = np.nonzero(may)
                    s = _scores(a, v, i, j)
                    fits = ((s >= least[i, 0]) & (s <= most[i, 0])).astype(np.bool_)
                    i, j, s = _best(i[fits], j[fits], s[fits], ids, k)
                    null = lambda x: None if x == _LAST else x
                    whose = at[i]
                    columns = [(whose.tolist(), pa.int32()), ([n] * len(i), pa.int32()), ([null(x) for x in ids_of[whose].tolist()], pa.int64()), ([positives[x][n][1] for x in whose], pa.int64()), ([positives[x][n][0] for x in whose], pa.int64()), ([null(x) for x in ids[j].tolist()], pa.int64()), (s.tolist(), pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["a", "k", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run, "a int, k int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"


def _first(rows: DataFrame, by: tuple[str, ...], score: str, id_col: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(id_col))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, bits: int = BITS, block: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Components become floor(scale * x); a score is the inner product of integers, greater is better, ties
    go to the smaller id. The positives of an anchor are the best rows of its label, for each of which the
    best rows of other labels are given whose score is ``low`` to ``high`` per cent of the positive's.

    Rows with a null label or vector, or with a component that is null or no finite number, take no part.
    Every row counts, also repeated ones; rows of the anchor's own id are not its positives. A null id is
    no anchor unless ``anchors`` says so and comes last among ties. Rows of different numbers of dimensions
    have no score. An anchor or positive with no row to give has none. Scores must fit 64 bits. Ids and
    labels are integers; other columns are not read; an empty table gives no rows.

    The search is exact: all anchors against all rows, in blocks of ``block`` anchors, which are what is
    sent to every task; no row is shuffled, only the best of each chunk of rows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = vectors.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    scaled = F.transform(vector_col, lambda x: x.cast("double") * scale)
    rows = usable.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"), scaled.alias("_vector"), F.coalesce(anchors, F.lit(False)).alias("_anchor"))
    run, schema = _file(bits)
    file = materialise(rows.select("_id", "_label", "_vector").mapInArrow(run, schema), "cells")
    asked = materialise(rows.where("_anchor").select(F.monotonically_increasing_id().alias("_n"), "_id", "_label", "_vector"), "anchors")
    count = asked.count()
    parts = 1 if count <= block else -(-2 * count // block)  # by hash, so half a block each on average
    out = None
    for part in range(parts):
        some = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("_n"), F.lit(parts)) == part)).orderBy("_n").collect()
        ids_of = np.array([_LAST if r._id is None else r._id for r in some], np.int64)
        labels_of = np.array([r._label for r in some], np.int64)
        by_size: dict = {}
        for k, r in enumerate(some):
            by_size.setdefault(len(r._vector), []).append(k)
        sent = {n: (np.array(at), whole(np.floor(np.array([some[k]._vector for k in at], np.float64)).reshape(len(at), n))) for n, at in by_size.items()}
        run, schema = _positives(sent, ids_of, labels_of, positives, bits)
        found: list = [[] for _ in some]
        for r in _first(file.mapInArrow(run, schema), ("a",), "score", "id", positives).orderBy("a", "rank").collect():
            found[r.a].append((r.score, r.id))
        run, schema = _negatives(sent, ids_of, labels_of, found, negatives, low, high, bits)
        mined = _first(file.mapInArrow(run, schema), ("a", "k"), "negative_score", "negative_id", negatives)
        mined = mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        out = mined if out is None else out.unionByName(mined)
    return out


def relabelled(vectors: DataFrame) -> DataFrame:
    """The query's table: where the id is divisible by 7 a row has the next label."""
    label = F.col("label")
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))


ORACLE = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
        FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
