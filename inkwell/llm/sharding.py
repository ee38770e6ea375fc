"""Byte-balanced sharding by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkwell.llm.common import materialise

#: Units of work a shard on the driver, at most twice; smaller groups travel in bundles.
UNITS_PER_SHARD = 512
#: Rows that one numbering task takes.
ROWS_PER_BUCKET = 8_000


def karmarkar_karp(sizes: list[int], ways: int) -> list[int]:
    """A way for each size, by the differencing method.

    Each size starts as a partial partition of its own. The two with the largest spread are joined,
    largest part with smallest, until one is left. Ties go by position, so reruns agree.
    """
    heap: list = []
    for i, size in enumerate(sizes):
        heap.append((-size, i, [(size, i)] + [(0, -1)] * (ways - 1)))
    heapq.heapify(heap)
    left: list[int] = []
    right: list[int] = []
    n = len(sizes)
    while len(heap) > 1:
        _, i, one = heapq.heappop(heap)
        _, j, two = heapq.heappop(heap)
        parts = []
        for (a, p), (b, q) in zip(one, reversed(two), strict=True):
            if p < 0 or q < 0:
                node = max(p, q)
            else:
                node = n + len(left)
                left.append(p)
                right.append(q)
            parts.append((a + b, node))
        parts.sort(key=lambda x: (-x[0], x[1]))
        low = parts[-1][0]
        if low:
            parts = [(a - low, p) for a, p in parts]
        heapq.heappush(heap, (-parts[0][0], min(i, j), parts))
    out = [0] * n
    for way, (_, node) in enumerate(heap[0][2] if heap else []):
        todo = [node] if node >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                out[x] = way
            else:
                todo += (left[x - n], right[x - n])
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", units_per_shard: int = UNITS_PER_SHARD, rows_per_bucket: int = ROWS_PER_BUCKET, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard, and the columns of
    ``carry``, which are read and shuffled once, when rows are dealt.

    Size is the text's UTF-8 bytes plus 1; null has none and is no copy of the empty text. Rows of equal text
    form a group that stays in one shard. Groups of at least a ``units_per_shard``-th of a shard are
    units; the others are dealt by hash into ``shards * units_per_shard`` bundles. So the driver sees
    at most twice that many sizes, whatever the input, and differencing works on all bytes. Slots are
    gapless from 0 in each shard. ``grown_shard`` is null: this law balances anew for another count.
    An empty table gives no rows; ids may be null or repeat.
    """
    spark = docs.sparkSession
    bundles = shards * units_per_shard
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("_size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("_crc"),
        F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)).alias("_group"),
        text.isNull().alias("_null"),
        *[F.col(f"`{c}`").alias(f"_carry{k}") for k, c in enumerate(carry)],
    ).withColumn("_group", F.when(F.col("_null"), F.lit(b"")).otherwise(F.col("_group"))).drop("_null")
    carried = [f"_carry{k}" for k in range(len(carry))]
    whole = rows
    rows = materialise(rows.drop(*carried), "sizes")
    whole = whole if carry else rows
    total, count = rows.agg(F.sum("_size"), F.count("*")).first()
    cut = max(1, (total or 0) // bundles)
    bundle = F.pmod(F.xxhash64("_group"), F.lit(bundles)).cast("int")
    groups = rows.groupBy("_group").agg(F.sum("_size").alias("bytes"))
    units = (
        groups.select("bytes", F.when(F.col("bytes") >= cut, F.col("_group")).alias("big"), F.when(F.col("bytes") < cut, bundle).alias("bundle"))
        .groupBy("big", "bundle")
        .agg(F.sum("bytes").alias("bytes"))
        .collect()
    )
    units.sort(key=lambda u: (-u.bytes, u.bundle if u.bundle is not None else -1, bytes(u.big or b"")))
    ways = karmarkar_karp([u.bytes for u in units], shards)
    big = [(u.big, w) for u, w in zip(units, ways, strict=True) if u.bundle is None]
    packed = [(u.bundle, w) for u, w in zip(units, ways, strict=True) if u.bundle is not None]
    big_map = spark.createDataFrame(big, T.StructType([T.StructField("_group", T.BinaryType()), T.StructField("_big", T.IntegerType())]))
    packed_map = spark.createDataFrame(packed, T.StructType([T.StructField("_bundle", T.IntegerType()), T.StructField("_packed", T.IntegerType())]))
    buckets = max(1, -(-count // (shards * rows_per_bucket)))
    dealt = (
        whole.withColumn("_bundle", bundle)
        .join(F.broadcast(big_map), "_group", "left")
        .join(F.broadcast(packed_map), "_bundle", "left")
        .select("_id", "_size", "_crc", "_group", F.coalesce("_big", "_packed").alias("_shard"), F.pmod(F.xxhash64("_id", "_group"), F.lit(buckets)).alias("_bucket"), *carried)
    )
    counts = dealt.groupBy("_shard", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_shard", "_bucket").orderBy("_id", "_group")
    return dealt.join(starts, ["_shard", "_bucket"]).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_start") + F.row_number().over(inside) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *[F.col(f"_carry{k}").alias(c) for k, c in enumerate(carry)],
    )
