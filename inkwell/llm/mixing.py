"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkwell.llm.common import NOT_SPACES, materialise, sized

WEIGHTS = (5, 2, 1)
#: No source and no document is repeated more often.
MOST_REPEATS = 3
SEED = 20240611
#: Blocks that a shard's quotas of a source share out; they set the size of the source's blocks.
BLOCKS_PER_SHARD = 4096
ROWS_PER_SHARD = 50_000
LEAST_SHARDS = 16
BROADCAST_ROWS = 100_000


def capped_targets(sizes: list[int], weights: list[int], most: int = MOST_REPEATS) -> list[float]:
    """Shares of all words by weight; none above ``most`` times its source, the excess reshared."""
    out = [0.0] * len(sizes)
    left, free = float(sum(sizes)), set(range(len(sizes)))
    while free:
        share = left / sum(weights[i] for i in free)
        over = {i for i in free if share * weights[i] > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = share * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
        left -= sum(most * sizes[i] for i in over)
        free -= over
    return out


def sainte_lague(votes: list[float], seats: int) -> list[int]:
    """Seats by highest quotient votes / (2 k + 1); ties go to the earlier entry.

    It starts from the rounded share of each, from which the highest quotients differ by few seats,
    and moves single seats until no quotient that got none exceeds one that got a seat.
    """
    total = sum(votes)
    if not seats or total <= 0:
        return [0] * len(votes)
    out = [max(0, int(v * seats / total)) if v > 0 else 0 for v in votes]
    add = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, out, strict=True)) if v > 0]
    heapq.heapify(add)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(add)
        out[i] += 1
        heapq.heappush(add, (-votes[i] / (2 * out[i] + 1), i))
    while True:  # a seat whose quotient is below the best one without a seat moves there
        best, i = min((-votes[i] / (2 * out[i] + 1), i) for i in range(len(votes)) if votes[i] > 0)
        worst, j = max((-votes[i] / (2 * out[i] - 1), i) for i in range(len(votes)) if out[i])
        if (best, i) >= (worst, j) or i == j:
            return out
        out[i] += 1
        out[j] -= 1


def quotas_in_words(words: list[int], goal: int, block: int, most: int = MOST_REPEATS) -> list[int]:
    """Words of each shard that together make ``goal``: seats of whole blocks, none above ``most`` times
    the shard's words; what that cuts, and the last part of a block, go where most room is."""
    out = [min(q * block, most * w) for q, w in zip(sainte_lague(list(map(float, words)), goal // block), words, strict=True)]
    rest = goal - sum(out)
    for i in sorted(range(len(words)), key=lambda i: (out[i] - most * words[i], i)):
        step = max(-out[i], min(rest, most * words[i] - out[i]))
        out[i] += step
        rest -= step
    return out


def mix_sources(docs: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False, least_shards: int = LEAST_SHARDS, blocks_per_shard: int = BLOCKS_PER_SHARD) -> DataFrame:
    """What a mixture takes of each row: id, size, source_size, target, taken, and the parts taken.

    Size is the number of words between white space; null has none. Sources by code point, null
    last, get ``weights`` in turn; ``capped_targets`` gives their words. Rows are dealt by seeded
    hash into shards and ordered there by it, so each source is, in each shard, a seeded stream of
    words cut into blocks of equal length, which is bounded by the source's own target. Apportionment by
    highest quotients gives every source its number of words and, within the source, every shard its
    quota of blocks; the quotas of a source add up to its words. A shard takes its quota as whole
    passes over the stream and a run of blocks from a seeded start: ``passes`` of the row, and its
    words ``[cut_from, cut_to)`` and ``[0, wrap_to)`` once more.

    The driver holds a row for each source (their number is taken to be small); quotas of a source
    are found in one task from a row for each shard. Shards grow with the rows, so a source of a
    third of all rows is split. With ``carry`` all columns of ``docs`` are kept, in ``doc``.
    Empty tables give no rows; texts without words get taken = 0.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(NOT_SPACES)), F.lit(0)).cast("long")
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    slim = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), size.alias("_size"), order.alias("_order"))
    slim = materialise(slim, "words")
    per_source = slim.groupBy("_source").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()
    per_source.sort(key=lambda r: (r._source is None, (r._source or "").encode("utf-8", "surrogatepass")))
    sizes = [r["size"] for r in per_source]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    shards = max(least_shards, -(-sum(r.n for r in per_source) // ROWS_PER_SHARD))
    goals = [min(q, most * n) for q, n in zip(sainte_lague(targets, round(sum(targets))), sizes, strict=True)]
    blocks = [max(1, g // (shards * blocks_per_shard)) for g in goals]
    named = T.StructType([T.StructField("_s", slim.schema["_source"].dataType), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("_goal", T.LongType()), T.StructField("_block", T.LongType())])
    plan = spark.createDataFrame([(r._source, r["size"], t, g, b) for r, t, g, b in zip(per_source, targets, goals, blocks, strict=True)], named)

    shard = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_order")), F.lit(shards)).cast("int")
    dealt = slim.groupBy("_source", shard.alias("_shard")).agg(F.sum("_size").alias("_words"))
    dealt = dealt.join(sized(plan, len(per_source), BROADCAST_ROWS), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")

    def quotas(_, frame):
        frame = frame.sort_values("_shard", kind="stable")
        frame["_take"] = quotas_in_words([int(x) for x in frame["_words"]], int(frame["_goal"].iloc[0]), int(frame["_block"].iloc[0]), most)
        return frame[["_source", "_shard", "_words", "source_size", "target", "_block", "_take"]]

    kind = slim.schema["_source"].dataType.simpleString()
    quota = dealt.groupBy("_source").applyInPandas(quotas, f"_source {kind}, _shard int, _words long, source_size long, target double, _block long, _take long")
    start = F.pmod(F.xxhash64(F.lit(seed + 2), F.col("_source"), F.col("_shard")), F.greatest(F.lit(1), F.ceil(F.col("_words") / F.col("_block")))) * F.col("_block")
    quota = quota.select(
        F.col("_source").alias("_s"), F.col("_shard").alias("_h"), "_words", "source_size", "target",
        F.when(F.col("_words") > 0, F.floor(F.col("_take") / F.col("_words"))).otherwise(0).cast("long").alias("passes"),
        F.when(F.col("_words") > 0, F.col("_take") % F.col("_words")).otherwise(0).cast("long").alias("_rest"),
        start.cast("long").alias("_from"),
    )
    quota = materialise(quota, "quotas")

    if carry:
        rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
        here = lambda c: F.col("doc").getField(c)
        rows = rows.select("doc", here(id_col).alias("_id"), here(source_col).alias("_source"), F.coalesce(F.regexp_count(here(text_col), F.lit(NOT_SPACES)), F.lit(0)).cast("long").alias("_size"), F.xxhash64(F.lit(seed), here(id_col), here(text_col)).alias("_order"))
    else:
        rows = slim
    rows = rows.withColumn("_shard", shard)
    run = Window.partitionBy("_source", "_shard").orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum("_size").over(run))
    rows = rows.join(quota, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h")))
    begin, end = F.col("_end") - F.col("_size"), F.col("_end")
    stop = F.col("_from") + F.col("_rest")
    inside = lambda at: F.greatest(F.lit(0), F.least(F.col("_size"), at - begin))
    cut_from, cut_to = inside(F.col("_from")), inside(F.least(stop, F.col("_words")))
    return rows.select(
        *(["doc"] if carry else []),
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("passes") * F.col("_size") + (cut_to - cut_from) + inside(stop - F.col("_words"))).cast("long").alias("taken"),
        "passes",
        cut_from.cast("long").alias("cut_from"),
        cut_to.cast("long").alias("cut_to"),
        inside(stop - F.col("_words")).cast("long").alias("wrap_to"),
    )


def taken_texts(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: a row for each pass and each part taken.

    A part of a text is its words, joined by single spaces; ``n_chars``, if there, is renewed.
    """
    mixed = mix_sources(docs, text_col=text_col, carry=True, **options)
    words = F.regexp_extract_all(F.col("doc").getField(text_col), F.lit(NOT_SPACES), F.lit(0))
    whole = F.struct(F.lit(-1).cast("long").alias("a"), F.lit(-1).cast("long").alias("b"))
    part = lambda a, b: F.when(b > a, F.array(F.when((a == 0) & (b == F.col("size")), whole).otherwise(F.struct(a.alias("a"), b.alias("b"))))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    copies = F.when((F.col("passes") > 0) & (F.col("size") > 0), F.array_repeat(whole, F.col("passes").cast("int"))).otherwise(F.array().cast("array<struct<a:bigint,b:bigint>>"))
    rows = mixed.withColumn("_part", F.explode(F.concat(copies, part(F.col("cut_from"), F.col("cut_to")), part(F.lit(0).cast("long"), F.col("wrap_to")))))
    text = F.when(F.col("_part.a") < 0, F.col("doc").getField(text_col)).otherwise(F.array_join(F.slice(words, (F.col("_part.a") + 1).cast("int"), (F.col("_part.b") - F.col("_part.a")).cast("int")), " "))
    rows = rows.select("doc", text.alias("_text"))
    renewed = {text_col: F.col("_text")} | ({"n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[renewed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])
