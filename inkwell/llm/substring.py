"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last ``GEAR_WORDS`` words has a value at each word; a chunk begins where
the value is the least of some window of words (local minima), so boundaries depend on what stands
there and not on the offset, and after an insertion the same chunks come back. Pairs of neighbouring
chunks are deduplicated by digest across texts. The windows of ``min_words`` words in and around runs
of repeated pairs are then looked up by digest themselves, so what is reported is exact.

Why no window is missed: a gear value depends on GEAR_WORDS words, and every stretch of w values has
a boundary that depends on them alone. A window of M words has M - g + 1 whole values; between its
first and its last boundary of that kind all boundaries are the same wherever the window stands, and
with 3 w <= M - g + 1 there are three at least, which is a pair of chunks. So a window that two texts
share has a pair that both have, all pairs between its first and its last boundary are repeated, and
it begins g + w - 2 words before a run of repeated pairs at most and ends w words after it at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import _TABLE, column_of, materialise, mix64, powers, text_blocks

MIN_WORDS = 50
#: Words that a gear value depends on.
GEAR_WORDS = 5
_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def chunk_window(min_words: int = MIN_WORDS) -> tuple[int, int]:
    """Words of a gear value, and of the window whose least value begins a chunk."""
    if min_words < 3:
        raise ValueError("a passage has three words at least")
    gear = min(GEAR_WORDS, min_words - 2)
    return gear, min(127, (min_words - gear + 1) // 3)


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the words between white space, and the number of each row's first."""
    inside = np.zeros(len(buf) + 2, np.bool_)
    inside[1:-1] = ~_SPACE[buf]
    before, after = inside[:-2].copy(), inside[2:].copy()
    joints = offs[1:-1]
    joints = joints[(joints > 0) & (joints < len(buf))]
    before[joints] = False
    after[joints - 1] = False
    starts, ends = np.flatnonzero(inside[1:-1] & ~before), np.flatnonzero(inside[1:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes_of(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


def gear_hashes(words: np.ndarray, gear: int = GEAR_WORDS) -> np.ndarray:
    """The gear hash, h = h * 2**s + word modulo 2**64, at each word; with gear * s >= 64 it depends on
    the last ``gear`` words. The upper half counts."""
    shift = np.uint64(-(-64 // gear))
    h = words.copy()
    for _ in range(gear - 1):
        h[1:] = words[1:] + (h[:-1] << shift)
    return (h >> np.uint64(32)).astype(np.uint32)


def boundaries(h: np.ndarray, first: np.ndarray, gear: int, window: int) -> np.ndarray:
    """Where chunks begin: the last least value of any ``window`` values in a row's words."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1].argmin(axis=1)
    at = np.arange(len(least))
    row = np.searchsorted(first, at, "right") - 1
    whole = (at - first[row] >= gear - 1) & (at + window <= first[row + 1])
    return np.unique((at + window - 1 - least)[whole])


def prefix_sums(words: np.ndarray):
    """A function of (from, to) that gives digests of runs of words."""
    up, down = powers(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return lambda a, b: (sums[b] - sums[a]) * down[a]


def chunk_pairs(words: np.ndarray, first: np.ndarray, gear: int, window: int):
    """First word, middle, end and digest of all pairs of neighbouring chunks of a block's rows."""
    cut = boundaries(gear_hashes(words, gear), first, gear, window)
    row = np.searchsorted(first, cut, "right") - 1
    at = np.flatnonzero(row[:-2] == row[2:]) if len(cut) > 2 else np.zeros(0, np.int64)
    a, b, c = cut[at], cut[at + 1], cut[at + 2]
    digest = prefix_sums(words)
    return a, b, c, mix64(digest(a, c)) ^ mix64(digest(a, b) + (c - a).astype(np.uint64)), row[at]


def _chunked(id_type: str, min_words: int):
    """A row for each document: its key, words and their bytes, and digests and places of its pairs; a
    place is the first word and in a byte each the two lengths."""
    gear, window = chunk_window(min_words)

    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in text_blocks(column_of(batch, "_text")):
                starts, ends, first = words_of(buf, offs)
                a, b, c, digest, row = chunk_pairs(hashes_of(buf, starts, ends), first, gear, window)
                place = (a - first[row]) << 16 | (b - a) << 8 | (c - b)
                cuts = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
                some = np.diff(first) > 0
                edge = lambda v, at: np.where(some, v[np.clip(at, 0, max(0, len(v) - 1))] - offs[:-1], 0) if len(v) else np.zeros(hi - lo, np.int64)  # noqa: E731, B023
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(column_of(part, x) for x in ("_key", "_more", "_id")), pa.array(np.diff(first).astype(np.int64)), pa.array(edge(starts, first[:-1])), pa.array(edge(ends, first[1:] - 1)), pa.ListArray.from_arrays(cuts, pa.array(digest.view(np.int64))), pa.ListArray.from_arrays(cuts, pa.array(place))],
                    names=["_key", "_more", "_id", "n", "begin", "end", "digests", "places"],
                )

    return run, f"_key long, _more long, _id {id_type}, n long, begin long, end long, digests array<long>, places array<long>"


def merged(regions: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(regions):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _windows(min_words: int):
    """For each region of a text its windows: two digests, the first byte and the byte after the last."""

    def run(batches):
        for batch in batches:
            keys, texts, regions = column_of(batch, "_key").to_numpy(), column_of(batch, "_text"), column_of(batch, "_regions")
            for i in range(batch.num_rows):
                rows = []
                for _, _, buf, offs in text_blocks(texts.slice(i, 1)):
                    starts, ends, _ = words_of(buf, offs)
                    words = hashes_of(buf, starts, ends)
                    one, two = prefix_sums(words), prefix_sums(mix64(words ^ _OTHER))
                    for lo, hi in merged([(max(0, r["lo"]), min(len(words), r["hi"])) for r in regions[i].as_py()]):
                        a = np.arange(lo, hi - min_words + 1)
                        if len(a):
                            b = a + min_words
                            rows.append((lo, mix64(one(a, b)).view(np.int64), (mix64(two(a, b)) >> np.uint64(33)).astype(np.int32), starts[a], ends[b - 1]))
                lists = [pa.array([r[k] for r in rows], pa.list_(t)) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), keys[i])), pa.array([r[0] for r in rows], pa.int64()), *lists], names=["_key", "lo", "d", "x", "begins", "ends"])

    return run, "_key long, lo long, d array<long>, x array<int>, begins array<long>, ends array<long>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with a key of their text, and a second hash that shows whether two texts share a key; texts
    whose key another text has too get one of their own."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    key, more = F.xxhash64(F.lit(1), "_text"), F.xxhash64(F.lit(2), "_text")
    return rows.select(key.alias("_key"), more.alias("_more"), "_id", "_text")


def _apart(rows: DataFrame, clashing: list[int]) -> DataFrame:
    return rows.withColumn("_key", F.when(F.col("_key").isin(clashing), F.xxhash64(F.lit(3), "_key", "_more")).otherwise(F.col("_key"))) if clashing else rows


def _texts(rows: DataFrame, id_type: str, min_words: int) -> tuple[DataFrame, DataFrame, list[int]]:
    """The chunked rows; a row for each text with its documents' least and greatest id and the row that
    stands for it; and the keys that had to be parted. Their number is n * n / 2**65 for n texts."""
    run, schema = _chunked(id_type, min_words)
    chunked = materialise(rows.mapInArrow(run, schema).withColumn("_rid", F.monotonically_increasing_id()), "chunked")
    texts = chunked.groupBy("_key", "_more").agg(F.min("_rid").alias("_first"), F.count("*").alias("rows"), *[f(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"))).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))], *[F.first(c).alias(c) for c in ("n", "begin", "end")])
    texts = materialise(texts, "texts")
    clashing = [r[0] for r in texts.groupBy("_key").agg(F.count("*").alias("k")).where("k > 1").select("_key").collect()]
    parted = lambda df: _apart(df, clashing).drop("_more")
    return parted(chunked), parted(texts), clashing


def _repeats(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """Rows (key, id), texts, the repeated windows of texts (key, pos, begin, end, the least key that has
    it, another), and the keys that were parted."""
    gear, window = chunk_window(min_words)
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _keyed(docs, id_col, text_col)
    chunked, texts, clashing = _texts(rows, id_type, min_words)
    copied = materialise(texts.where("rows > 1").select(F.col("_key").alias("_k"), "_first"), "copied")
    once = chunked.join(copied, F.col("_key") == F.col("_k"), "left").where("_first is null or _first = _rid")
    pairs = materialise(once.where(F.size("digests") > 0).select("_key", "digests", "places"), "pairs")
    repeated = pairs.select("_key", F.explode("digests").alias("_d")).groupBy("_d").agg(F.min("_key").alias("a"), F.max("_key").alias("b")).where("a <> b").select("_d")
    repeated = materialise(repeated, "repeated")
    hits = pairs.select("_key", F.explode(F.arrays_zip("digests", "places")).alias("p")).select("_key", F.col("p.digests").alias("_d"), F.col("p.places").alias("_at")).join(repeated, "_d")
    start = F.shiftright("_at", 16)
    middle = start + F.shiftright("_at", 8).bitwiseAND(F.lit(255))
    hits = hits.select("_key", start.alias("s"), middle.alias("m"), (middle + F.col("_at").bitwiseAND(F.lit(255))).alias("e"))
    in_text = Window.partitionBy("_key").orderBy("s")
    hits = hits.withColumn("_new", F.coalesce((F.lag("m").over(in_text) != F.col("s")).cast("long"), F.lit(1)))
    runs = hits.withColumn("_run", F.sum("_new").over(in_text)).groupBy("_key", "_run").agg((F.min("s") - (gear + window - 2)).alias("lo"), (F.max("e") + window).alias("hi"))
    regions = runs.where(F.col("hi") - F.col("lo") >= min_words).groupBy("_key").agg(F.collect_list(F.struct("lo", "hi")).alias("_regions"))
    regions = materialise(regions.join(texts.select("_key", F.col("low.id").alias("_i")), "_key").withColumnRenamed("_key", "_k"), "regions")

    again = _apart(rows, clashing).join(regions, (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_i"))).select("_key", "_text", "_regions")
    run, schema = _windows(min_words)
    windows = materialise(again.mapInArrow(run, schema), "windows")
    each = windows.select("_key", "lo", F.posexplode(F.arrays_zip("d", "x", "begins", "ends")).alias("_n", "w")).select("_key", (F.col("lo") + F.col("_n")).alias("pos"), F.col("w.d").alias("d"), F.col("w.x").alias("x"), F.col("w.begins").alias("begin"), F.col("w.ends").alias("end"))
    shared = materialise(each.groupBy("d", "x").agg(F.min("_key").alias("a"), F.max("_key").alias("b")).where("a <> b"), "shared")
    found = each.join(shared, ["d", "x"]).select("_key", "pos", "begin", "end", (F.col("a") != F.col("_key")).alias("_later"), F.when(F.col("a") == F.col("_key"), F.col("b")).otherwise(F.col("a")).alias("_other"))
    found = found.repartition("_key").dropDuplicates(["_key", "pos"])  # repeated rows are one document
    along = Window.partitionBy("_key").orderBy("pos")
    found = found.withColumn("_new", F.coalesce((F.lag("pos").over(along) + 1 != F.col("pos")).cast("long"), F.lit(1)))
    found = found.withColumn("_span", F.sum("_new").over(along)).drop("_new")
    return chunked.select("_key", "_id"), texts, materialise(found, "found"), clashing


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each passage of a document that others have too: id, span_start, span_end (bytes of
    the UTF-8 text), n_words, other_<id> and kept.

    A passage is a stretch of words, as long as possible, all of whose windows of ``min_words`` words
    occur in other documents, whatever white space stands between the words; so it has ``min_words``
    at least. Its windows may be those of several documents; ``other_<id>`` is one that has the first.
    Of texts with a window the one of the least key leads, and of copies of a text the document of
    the least id (null last); ``kept`` says that no window of the passage is led by another document.
    A text that several ids have is one passage as a whole. Rows of one id and text are one document;
    a passage repeated only inside it is none. Null and empty texts have no passages; ids may be null;
    empty tables give no rows; other columns are not read.

    Chunks and windows are shuffled as digests with map-side combining, so what every text has is
    one row a task; copies take part once; joins on digests are of written tables, so they can be split.
    Windows are compared by 95 bits of two hashes.
    """
    rows, texts, found, _ = _repeats(docs, id_col, text_col, min_words)
    spans = found.groupBy("_key", "_span").agg(F.min("begin").alias("span_start"), F.max("end").alias("span_end"), (F.count("*") + min_words - 1).alias("n_words"), F.min_by("_other", "pos").alias("_other"), (~F.bool_or("_later")).alias("kept"))
    names = texts.select(F.col("_key").alias("_other"), F.col("low.id").alias("_name"))
    spans = spans.join(names, "_other").select("_key", "span_start", "span_end", "n_words", F.col("_name").alias("other"), "kept")
    copied = (F.col("n") >= min_words) & (~F.col("low.id").eqNullSafe(F.col("high.id")))
    whole = texts.where(copied).select("_key", F.col("begin").alias("span_start"), F.col("end").alias("span_end"), F.col("n").alias("n_words"), F.lit(None).cast(texts.schema["low"].dataType["id"].dataType).alias("other"), F.lit(None).cast("boolean").alias("kept"), "low", "high")
    alone = spans.join(whole.select("_key"), "_key", "left_anti")
    led = found.groupBy("_key").agg(F.bool_or("_later").alias("_led"))
    passages = alone.unionByName(whole, allowMissingColumns=True).join(led, "_key", "left")
    passages = materialise(passages.withColumnRenamed("_key", "_k"), "spans")  # a written side: copies of one text can be split
    out = rows.distinct().join(passages, F.col("_key") == F.col("_k"))
    first = F.col("low").isNotNull() & F.col("_id").eqNullSafe(F.col("low.id"))
    other = F.when(F.col("low").isNull(), F.col("other")).when(first, F.col("high.id")).otherwise(F.col("low.id"))
    kept = F.when(F.col("low").isNull(), F.col("kept")).otherwise(first & ~F.coalesce("_led", F.lit(False)))
    return out.select(F.col("_id").alias(id_col), "span_start", "span_end", "n_words", other.alias(f"other_{id_col}"), kept.alias("kept"))


def _cut_texts(names: list[str], text_at: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column(text_at).cast(pa.binary()).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                parts, at = [], 0
                for a, b in merged([(c["a"], c["b"]) for c in cuts or ()]):
                    parts.append(text[at:a])
                    at = b
                out.append(None if text is None else b"".join([*parts, text[at:]]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if k == text_at else batch.column(k) for k in range(len(names))], names=names)

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the windows that another document leads: their words go, with the white space
    between them. Whatever goes is in a document of a smaller key, so it stays somewhere; of copies
    the document of the least id stays. The columns are those of ``docs``; other rows are as they were.
    """
    _, texts, found, clashing = _repeats(docs, id_col, text_col, min_words)
    later = found.where("_later").groupBy("_key").agg(F.collect_list(F.struct(F.col("begin").alias("a"), F.col("end").alias("b"))).alias("part"))
    copied = texts.where((F.col("n") >= min_words) & (~F.col("low.id").eqNullSafe(F.col("high.id")))).select("_key", F.col("low.id").alias("stays"), F.array(F.struct(F.col("begin").alias("a"), F.col("end").alias("b"))).alias("whole"))
    cuts = materialise(later.join(copied, "_key", "full").select(F.struct("_key", "part", "stays", "whole").alias("_x")), "cuts")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # the names of docs may be any
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    text = F.coalesce(f"c{text_at}", F.lit(""))
    key = F.xxhash64(F.lit(1), text)
    if clashing:
        key = F.when(key.isin(clashing), F.xxhash64(F.lit(3), key, F.xxhash64(F.lit(2), text))).otherwise(key)
    here = plain.withColumn("k", key).join(cuts, F.col("k") == F.col("_x._key"), "left")
    cut = F.when(F.col("_x.whole").isNotNull() & ~F.col(f"c{id_at}").eqNullSafe(F.col("_x.stays")), F.col("_x.whole")).otherwise(F.col("_x.part"))
    return here.select(*plain.columns, cut.alias("cut")).mapInArrow(_cut_texts(docs.columns, text_at), docs.schema)
