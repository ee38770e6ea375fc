"""Suffix-array deduplication, built block by block over a difference cover.

A suffix counts up to its first ``length`` bytes. The cover has the positions of a document that are, by
its period v, in a set of which every difference modulo v is one of two members: so of any two suffixes
one offset below v brings both to the cover. First the cover's strings of length - v + 1 bytes are sorted,
bucket by bucket, which ranks them; a suffix whose cover strings occur nowhere else is equal to no other,
and is not looked at again. The suffixes that are left are sorted bucket by bucket, some buckets at a time:
where they tie, the ranks at the common offset decide, with the few bytes before and after. For that a
suffix has a key for each cover string in it, made of the offset, the rank and those bytes: two suffixes
are equal when they have a key in common. A bucket's task holds keys, never texts.

Order is by fingerprints of 64 bits, not by letters: only equality counts here. With the bits of a
bucket and a pass they are those of a key; cover strings are named by all 64.
"""

from __future__ import annotations

import contextlib
import hashlib
import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import _TABLE, bound_batches, column_of, discard, materialise, mix64, powers, text_blocks

LENGTH = 50
#: Periods and difference covers, each difference made once.
COVERS = ((13, (0, 1, 3, 9)), (7, (0, 1, 3)), (3, (0, 1)), (1, (0,)))
#: Bytes of texts that are worked on together.
BLOCK = 1 << 20
#: Cover strings of a region, and entries of a bucket on average.
REGION = 1 << 15
BUCKET = 1 << 20
LEAST_BUCKETS = 64
#: Passes over the texts for cover strings; each shuffles its part of them only, in four bytes each.
PASSES = 1
_LAST = np.iinfo(np.int64).max
_SLICE = 1 << 21
#: Rows of blocks are large, so row groups have few of them.
_STORED = {"parquet.block.size": 16 << 20, "compression": "zstd"}
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cover(length: int) -> tuple[int, tuple[int, ...]]:
    """The period and the members of the cover for strings of ``length`` bytes."""
    if length < 1:
        raise ValueError("a repeated string has a byte at least")
    return next(c for c in COVERS if 2 * c[0] <= length or c[0] == 1)


def digests(body: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of each of the strings body[a:b], none of which is longer than half a slice."""
    out = np.zeros(len(a), np.uint64)
    for lo in range(0, max(1, len(body)), _SLICE):
        own = slice(None) if len(body) <= _SLICE else (a >= lo) & (a < lo + _SLICE)
        part = body[lo : lo + _SLICE + _SLICE // 2]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * up[: len(part)], out=sums[1:])
        out[own] = (sums[b[own] - lo] - sums[a[own] - lo]) * down[a[own] - lo]
    return out


def cover_places(ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all cover strings of a block's texts, in order, and the texts they are in."""
    period, members = cover(length)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    room = ends - begins - (length - period + 1)
    places, texts = [], []
    for member in members:
        count = np.maximum(0, (room - member) // period + 1)
        text = np.repeat(np.arange(len(ends)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        places.append(begins[text] + member + period * nth)
        texts.append(text)
    at = np.concatenate(places)
    order = np.argsort(at, kind="stable")
    return at[order], np.concatenate(texts)[order]


def _order(h: np.ndarray) -> np.ndarray:
    """What sorts 64-bit values: their upper bits are sorted with their places in the lower ones, which is
    quicker than to sort places; where that is not enough to tell values apart, places are."""
    mask = np.uint64((1 << max(1, (len(h) - 1).bit_length())) - 1) if len(h) else np.uint64(1)
    packed = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    packed.sort()
    order = (packed & mask).astype(np.int64)
    there = h[order]
    return order if (there[1:] >= there[:-1]).all() else np.argsort(h)


def _groups(h: np.ndarray, of: np.ndarray):
    """Distinct values in order, each one's place among them, and the least and greatest ``of`` of each."""
    order = _order(h)
    new = np.ones(len(h), np.bool_)
    new[1:] = h[order][1:] != h[order][:-1]
    group = np.empty(len(h), np.int64)
    group[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    least, most = (f.reduceat(of[order], first) if len(h) else of for f in (np.minimum, np.maximum))
    return h[order][first], group, least, most


def _passed(h: np.ndarray, n: int, passes: int) -> np.ndarray:
    """Where the values of the n-th pass are."""
    return np.flatnonzero(((h & np.uint64(0xFF)) * np.uint64(passes)) >> np.uint64(8) == n)


def _slices(u: np.ndarray, buckets: int):
    """Buckets of sorted values, and from where to where they are."""
    b = ((u >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else np.zeros(0, np.int64)
    return list(zip(b[at].tolist(), at.tolist(), [*at[1:].tolist(), len(u)], strict=True)) if len(b) else []


def _replied(u: np.ndarray, buckets: int, replies: dict) -> np.ndarray:
    """Of a block's distinct values those that the buckets' answers name."""
    out = np.zeros(len(u), np.bool_)
    for bucket, lo, hi in _slices(u, buckets):
        if bucket in replies:
            out[lo:hi] = np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=hi - lo)
    return out


def _answers(batch: pa.RecordBatch, i: int) -> dict:
    """Answers to a row by pass and bucket."""
    out: dict = {}
    for r in column_of(batch, "_replies")[i].as_py() or ():
        out.setdefault(r["pass"], {})[r["bucket"]] = r["bits"]
    return out


def _body(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return np.frombuffer(column_of(batch, "body")[i].as_buffer(), np.uint8)


def _numbers(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
    return column_of(batch, name)[i].values.to_numpy(zero_copy_only=False)


def _blocks(id_type: pa.DataType, length: int, block: int):
    """Texts of about ``block`` bytes as one row, and with them the documents that are copies."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 50_000):
                part = batch.slice(lo, 50_000)
                copies = column_of(part, "_copy")
                dead, live = part.filter(copies), part.filter(pa.compute.invert(copies))
                rows = [(a, b, body, ends[1:]) for a, b, body, ends in text_blocks(column_of(live, "_text"), block)] or [(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.int64))]
                for k, (a, b, body, ends) in enumerate(rows):
                    some, gone = live.slice(a, b - a), dead if k == 0 else dead.slice(0, 0)
                    values = [[secrets.randbits(62)], [len(body)], [column_of(some, "_id").to_pylist()], [column_of(some, "_ord").to_pylist()], [ends.tolist()], [body.tobytes()], [column_of(gone, "_id").to_pylist()], [column_of(gone, "_size").to_pylist()]]
                    kinds = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(id_type), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["block", "size", "ids", "ords", "ends", "body", "copies", "sizes"])

    return run


def _cover_values(body: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    return mix64(digests(body, at, at + length - cover(length)[0] + 1))


def _sample(length: int, n: int, passes: int, buckets: int):
    """The n-th part of the cover strings: a row for each bucket of a block, with 32 bits of each distinct one."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                at, text = cover_places(_numbers(batch, "ends", i), length)
                h = _cover_values(_body(batch, i), at, length)
                mine = _passed(h, n, passes)
                u = np.unique(h[mine])
                tags = (u >> np.uint64(8)).astype(np.uint32)
                rows = [(b, tags[lo:hi].tobytes()) for b, lo, hi in _slices(u, buckets)]
                block = column_of(batch, "block")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([t for _, t in rows], pa.binary())], names=["bucket", "owner", "tags"])

    return run, "bucket int, owner long, tags binary"


_REPLY = "owner long, pass int, bucket int, bits binary"


def _reply(table: pa.Table, n: int, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    """Of a bucket's entries those that are flagged, as bits for each row they came in; rows without any go."""
    owners, buckets = table.column("owner").to_pylist(), table.column("bucket").to_pylist()
    rows, at = [], 0
    for owner, bucket, size in zip(owners, buckets, sizes, strict=True):
        own = flags[at : at + size]
        at += size
        if own.any():
            rows.append((owner, n, bucket, np.packbits(own).tobytes()))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["owner", "pass", "bucket", "bits"])


def _ranked(n: int):
    """Sort a bucket of cover strings: those that several blocks have share a rank."""

    def run(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, np.uint32) for x in table.column("tags").to_pylist()]
        tags = np.concatenate(each)
        order = _order(tags.astype(np.uint64) << np.uint64(32))
        same = tags[order][1:] == tags[order][:-1]
        tied = np.zeros(len(tags), np.bool_)
        tied[order[1:]] = same
        tied[order[:-1]] |= same
        return _reply(table, n, tied, [len(x) for x in each])

    return run


def _regions(length: int, passes: int, buckets: int, region: int):
    """What is left of each block: its shared cover strings and the bytes around them, in rows of ``region`` at most."""
    period = cover(length)[0]
    wide = length - period + 1

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                body, ends, ords = _body(batch, i), _numbers(batch, "ends", i), _numbers(batch, "ords", i)
                at, text = cover_places(ends, length)
                h, replies = _cover_values(body, at, length), _answers(batch, i)
                shared = np.zeros(len(h), np.bool_)
                for n in range(passes):
                    mine = _passed(h, n, passes)
                    u, group, least, most = _groups(h[mine], text[mine])
                    shared[mine] = ((least != most) | _replied(u, buckets, replies.get(n, {})))[group]
                at, text = at[shared], text[shared]
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                for lo in range(0, len(at), region):
                    q, k = at[lo : lo + region], text[lo : lo + region]
                    back, ahead = np.minimum(period - 1, q - begins[k]), np.minimum(period - 1, ends[k] - q - wide)
                    low, high = int((q - back).min()), int((q + wide + ahead).max())
                    edge = np.bincount(q - back - low, minlength=high - low + 1) - np.bincount(q + wide + ahead - low, minlength=high - low + 1)
                    kept = np.cumsum(edge[:-1]) > 0
                    moved = np.cumsum(kept) - 1
                    columns = [[secrets.randbits(62)], [column_of(batch, "block")[i].as_py()], [len(q)], [body[low:high][kept].tobytes()]]
                    lists = [q, moved[q - low], k, ords[k], back, ahead]
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)), *(pa.array([x.astype(t)], pa.list_(pa.from_numpy_dtype(t))) for x, t in zip(lists, (np.int32, np.int32, np.int32, np.int64, np.int8, np.int8), strict=True))],
                        names=["owner", "block", "n", "body", "place", "at", "text", "ord", "back", "ahead"],
                    )

    return run, "owner long, block long, n long, body binary, place array<int>, at array<int>, text array<int>, ord array<long>, back array<tinyint>, ahead array<tinyint>"


def _keys(batch: pa.RecordBatch, i: int, length: int, passes: int):
    """The keys of a region's suffixes, one for each cover string in them; which string and offset each is
    of. A function of the pass, which is that of the string's rank, so a pass makes its own keys only."""
    period = cover(length)[0]
    wide = length - period + 1
    body = _body(batch, i)
    at, back, ahead = (_numbers(batch, c, i).astype(np.int64) for c in ("at", "back", "ahead"))
    offset = np.arange(period)
    up, down = powers(len(body) + 1)
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_TABLE[body] * up[: len(body)], out=sums[1:])
    string = lambda a, b: (sums[b] - sums[a]) * down[a]
    rank = mix64(string(at, at + wide))

    def of(n: int):
        mine = _passed(rank, n, passes)
        which, t = np.nonzero((offset <= back[mine, None]) & (period - 1 - offset <= ahead[mine, None]))
        which = mine[which]
        q = at[which]
        first = q - t
        head, tail = string(first, q), string(q + wide, first + length)
        return mix64(rank[which] + mix64(head + t.astype(np.uint64)) + mix64(tail ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(3)), which, t

    return of


def _suffixes(length: int, n: int, passes: int, buckets: int):
    """The n-th part of the suffixes: a row for each bucket of a region, with each distinct key and the
    least document that has it there."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, which, _ = _keys(batch, i, length, passes)(n)
                u, _, least, _ = _groups(keys, _numbers(batch, "ord", i)[which])
                rows = []
                for b, lo, hi in _slices(u, buckets):
                    names, number = np.unique(least[lo:hi], return_inverse=True)
                    rows.append((b, u[lo:hi].tobytes(), names.tobytes(), number.astype(np.uint16).tobytes()))
                owner = column_of(batch, "owner")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([owner] * len(rows), pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["bucket", "owner", "keys", "names", "number"])

    return run, "bucket int, owner long, keys binary, names binary, number binary"


def _sorted(n: int):
    """Sort a bucket of suffixes: of equal ones those whose document is not the least are to go."""

    def run(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        names = [np.frombuffer(x, np.int64) for x in table.column("names").to_pylist()]
        ords = np.concatenate([x[np.frombuffer(k, np.uint16)] for x, k in zip(names, table.column("number").to_pylist(), strict=True)])
        _, group, least, _ = _groups(np.concatenate(keys), ords)
        return _reply(table, n, ords > least[group], [len(x) for x in keys])

    return run


def _spans(length: int, passes: int, buckets: int):
    """Of each region the bytes to remove, as runs of places in the block."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                of, replies, found = _keys(batch, i, length, passes), _answers(batch, i), []
                places, texts, ords = (_numbers(batch, c, i) for c in ("place", "text", "ord"))
                for n in range(passes):
                    keys, which, t = of(n)
                    u, group, least, _ = _groups(keys, ords[which])
                    gone = _replied(u, buckets, replies.get(n, {}))[group] | (ords[which] > least[group])
                    found.append((places[which[gone]].astype(np.int64) - t[gone], texts[which[gone]]))
                place, text = (np.concatenate(x) for x in zip(*found, strict=True))
                first, kept = np.unique(place, return_index=True)
                if len(first):
                    text = text[kept]
                    new = np.flatnonzero(np.concatenate([[True], (first[1:] > first[:-1] + length) | (text[1:] != text[:-1])]))
                    lo, hi = first[new], first[np.append(new[1:], len(first)) - 1] + length
                    yield pa.RecordBatch.from_arrays([pa.array([column_of(batch, "block")[i].as_py()]), pa.array([lo]), pa.array([hi])], names=["block", "lo", "hi"])

    return run, "block long, lo array<long>, hi array<long>"


def removed_runs(begin: int, end: int, lo: np.ndarray, hi: np.ndarray) -> list[tuple[int, int]]:
    """Runs of places that are removed from a text of a block, as long as they can be."""
    out: list[list[int]] = []
    for a, b in zip(lo, hi, strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a - begin, b - begin) for a, b in out if begin <= a and b <= end]


def _results(id_type: pa.DataType, texts: bool):
    """A row for each document: its bytes, what is removed of them, and the rest or its digest."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                body, ends = column_of(batch, "body")[i].as_py(), _numbers(batch, "ends", i).tolist()
                parts = column_of(batch, "_spans")[i].as_py() or ()
                lo, hi = (np.array([x for p in parts for x in p[c]], np.int64) for c in ("lo", "hi"))
                order = np.argsort(lo, kind="stable")
                lo, hi = lo[order], hi[order]
                rows, begin = [], 0
                for end in ends:
                    a, b = np.searchsorted(lo, (begin, end))
                    runs = removed_runs(begin, end, lo[a:b].tolist(), hi[a:b].tolist())
                    rest, at = [], begin
                    for x, y in runs:
                        rest.append(body[at : begin + x])
                        at = begin + y
                    rest.append(body[at:end])
                    rows.append((end - begin, sum(y - x for x, y in runs), len(runs), b"".join(rest)))
                    begin = end
                sizes = _numbers(batch, "sizes", i).tolist()
                rows += [(n, n, 1, b"") for n in sizes]
                ids = pa.concat_arrays([column_of(batch, c)[i].values for c in ("ids", "copies")])
                last = pa.array([r[3] for r in rows], pa.binary()) if texts else pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1, 2)), last], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


@contextlib.contextmanager
def _lean(spark: SparkSession):
    """Let the shuffle files of what is written inside go when it is written."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def _answered(rows: DataFrame, replies: list[DataFrame], by: str) -> DataFrame:
    """Rows with the answers to them."""
    every = replies[0]
    for more in replies[1:]:
        every = every.unionByName(more)
    listed = every.groupBy(F.col("owner").alias("_owner")).agg(F.collect_list(F.struct("pass", "bucket", "bits")).alias("_replies"))
    return rows.join(listed, F.col(by) == F.col("_owner"), "left").drop("_owner")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block: int = BLOCK, region: int = REGION, bucket: int = BUCKET, passes: int = PASSES, texts: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans and kept_sha256, or with ``texts`` the
    remaining bytes as ``kept`` (they may end within a character).

    A byte of a document is removed when a string of ``length`` bytes that covers it also starts in a
    document with a smaller id; all strings are those of the input, so what is removed does not depend on
    what else is. Texts are read as UTF-8, null as empty; a string lies in one document. Ids are integers;
    a null id is greater than all others. Rows of the same id remove nothing from each other, so repeated
    rows have equal results. Of equal texts all but those of the smallest id are removed whole, without a
    look at their strings (a text is known by 128 bits). Empty tables give no rows; other columns are not read.

    Texts are written in blocks of about ``block`` bytes, and a block's distinct strings leave it once, so
    what every document has is one entry for a block. Buckets have about ``bucket`` entries, whatever the
    input. Cover strings go in ``passes`` passes and suffixes, of whom each pass has those of its ranks, in
    as many as keep a pass's entries below the size of the texts; a pass's files go when it is done. One
    long text is one block.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError("ids are integers")
    bound_batches(spark)
    period, members = cover(length)
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind.simpleString()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("_ord"), text.alias("_text"), F.octet_length(text).cast("long").alias("_size"), F.xxhash64(F.lit(1), text).alias("_k"), F.xxhash64(F.lit(2), text).alias("_l"))
    with _lean(spark):
        copied = rows.where(F.col("_size") >= length).groupBy("_k", "_l").agg(F.min("_ord").alias("_lead"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        copied = materialise(copied, "copied")
        marked = rows.join(copied, ["_k", "_l"], "left").select("_id", "_ord", "_text", "_size", F.coalesce(F.col("_lead") < F.col("_ord"), F.lit(False)).alias("_copy"))
        name = kind.simpleString()
        blocks = materialise(marked.mapInArrow(_blocks(id_type, length, block), f"block long, size long, ids array<{name}>, ords array<long>, ends array<long>, body binary, copies array<{name}>, sizes array<long>"), "blocks", **_STORED)
        discard(copied)
        size = blocks.agg(F.sum("size")).first()[0] or 0

        buckets = max(LEAST_BUCKETS, size * len(members) // period // passes // (4 * bucket))
        ranks = []
        for n in range(passes):
            run, schema = _sample(length, n, passes, buckets)
            ranks.append(materialise(blocks.select("block", "ends", "body").mapInArrow(run, schema).groupBy("bucket").applyInArrow(_ranked(n), _REPLY), f"ranks{n}"))
        run, schema = _regions(length, passes, buckets, region)
        regions = materialise(_answered(blocks.select("block", "ords", "ends", "body"), ranks, "block").mapInArrow(run, schema), "regions", **_STORED)
        discard(*ranks)

        keys = (regions.agg(F.sum("n")).first()[0] or 0) * period
        turns = min(64, max(1, -(-10 * keys // max(1, size))))
        buckets = max(LEAST_BUCKETS, keys // turns // bucket)
        lost = []
        for n in range(turns):
            run, schema = _suffixes(length, n, turns, buckets)
            lost.append(materialise(regions.select("owner", "body", "at", "back", "ahead", "ord").mapInArrow(run, schema).groupBy("bucket").applyInArrow(_sorted(n), _REPLY), f"lost{n}"))
        run, schema = _spans(length, turns, buckets)
        spans = _answered(regions, lost, "owner").mapInArrow(run, schema).groupBy(F.col("block").alias("_block")).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
        spans = materialise(spans, "spans")
        discard(regions, *lost)
    out = blocks.join(spans, F.col("block") == F.col("_block"), "left").select("ids", "ends", "body", "copies", "sizes", "_spans")
    out = out.mapInArrow(_results(id_type, texts), f"id {name}, n_bytes long, n_removed long, n_spans long, kept {'binary' if texts else 'string'}")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", F.col("kept").alias("kept" if texts else "kept_sha256"))
