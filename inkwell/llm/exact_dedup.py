"""Exact deduplication by composable polynomial fingerprints.

A text's fingerprint is its bytes read as digits of a polynomial, modulo two primes. Chunks are
hashed side by side and combined by length-shifted arithmetic, H(xy) = H(x) * B**len(y) + H(y), so
a document of any length costs one pass and no state beyond a chunk. Rows of equal fingerprint and
length are then compared chunk by chunk with the row that stays, so the result is exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import column_of, materialise, sized

#: Primes below 2**31 and a base for each.
MODULI = (2147483629, 2147483587)
BASES = (1103515245, 1664525003)
CHUNK = 1 << 16
#: Members of a group that one copy of the group's lead is compared with.
PER_LEAD = 256
BROADCAST_ROWS = 100_000
_TABLES: dict = {}


def normalise(data: bytes) -> bytes:
    """Each run of white space as one space."""
    words = data.split()
    if not words:
        return b" " if data else b""
    return (b" " if data[0] in b" \t\n\r\x0b\x0c" else b"") + b" ".join(words) + (b" " if data[-1] in b" \t\n\r\x0b\x0c" else b"")


def _digits(chunk: int, base: int, modulus: int) -> np.ndarray:
    """base**(chunk-1) ... base**0 modulo modulus."""
    key = (chunk, base, modulus)
    if key not in _TABLES:
        out = [1]
        for _ in range(chunk - 1):
            out.append(out[-1] * base % modulus)
        _TABLES[key] = np.array(out[::-1], np.int64)
    return _TABLES[key]


def combine(left: int, right: int, right_len: int, base: int, modulus: int) -> int:
    """The hash of xy from those of x and y."""
    return (left * pow(base, right_len, modulus) + right) % modulus


def fingerprint(data: bytes, chunk: int = CHUNK, moduli=MODULI, bases=BASES) -> int:
    """All chunks are hashed at once, then folded from the left."""
    digits = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    whole = len(digits) // chunk
    rest = len(digits) - whole * chunk
    out = 0
    for base, modulus in zip(bases, moduli, strict=True):
        table = _digits(chunk, base, modulus)
        h = 0
        if whole:
            for x in digits[: whole * chunk].reshape(whole, chunk) @ table % modulus:
                h = combine(h, int(x), chunk, base, modulus)
        if rest:
            h = combine(h, int(digits[whole * chunk :] @ table[chunk - rest :]) % modulus, rest, base, modulus)
        out = out << 31 | h
    return out


def _fingerprints(id_type: str, chunk: int, moduli):
    def run(batches):
        for batch in batches:
            fps, lens, shas = [], [], []
            for text in column_of(batch, "_text").cast(pa.binary()).to_pylist():
                data = normalise(text or b"")
                fps.append(fingerprint(data, chunk, moduli))
                lens.append(len(data))
                shas.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(column_of(batch, c) for c in ("_rid", "_row", "_id")), pa.array(fps, pa.int64()), pa.array(lens, pa.int64()), pa.array(shas, pa.string())],
                names=["_rid", "_row", "_id", "_fp", "_len", "_sha"],
            )

    return run, f"_rid long, _row long, _id {id_type}, _fp long, _len long, _sha string"


def _chunks(chunk: int, moduli):
    """Chunks of the rows that are in a group of equal fingerprints; one document's at a time."""

    def run(batches):
        for batch in batches:
            texts = column_of(batch, "_text").cast(pa.binary())
            for i in range(batch.num_rows):
                data = normalise(texts[i].as_py() or b"")
                row = batch.slice(i, 1)
                if fingerprint(data, chunk, moduli) != column_of(row, "_fp")[0].as_py() or len(data) != column_of(row, "_len")[0].as_py():
                    continue  # another text of the same key
                parts = [data[k : k + chunk] for k in range(0, len(data), chunk)] or [b""]
                take = pa.array([0] * len(parts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(column_of(row, c).take(take) for c in ("_row", "_fp", "_len", "_sha", "_lead", "_salts")), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())],
                    names=["_row", "_fp", "_len", "_sha", "_lead", "_salts", "_part", "_bytes"],
                )

    return run, "_row long, _fp long, _len long, _sha string, _lead boolean, _salts long, _part long, _bytes binary"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, moduli=MODULI) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null counts as
    empty. The row of the smallest id stays (null ids come last); of rows that repeat an id and its
    text one is kept. Empty tables give no rows; other columns of ``docs`` are not read.

    Only fingerprints, lengths and digests are shuffled for all rows; texts only of rows whose
    fingerprint repeats, found again by a key of id and text, then in chunks, with one copy of the lead for
    every ``PER_LEAD`` members.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).withColumn("_row", F.xxhash64("_id", "_text"))
    run, schema = _fingerprints(id_type, chunk, moduli)
    prints = materialise(source.withColumn("_rid", F.monotonically_increasing_id()).select("_rid", "_row", "_id", "_text").mapInArrow(run, schema), "prints")

    first = F.min(F.struct(F.col("_id").isNull().alias("last"), "_id", "_rid", "_sha")).alias("first")
    groups = prints.groupBy("_fp", "_len").agg(first, F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups.select("_fp", "_len", F.col("first._id").alias("lead_id"), F.col("first._sha").alias("lead_sha"), "n"), "groups")  # a written side: the join can split a large group
    members = materialise(
        prints.join(groups, ["_fp", "_len"])
        .select("_row", "_fp", "_len", "_sha", (F.col("_id").eqNullSafe(F.col("lead_id")) & (F.col("_sha") == F.col("lead_sha"))).alias("_lead"), F.ceil(F.col("n") / PER_LEAD).alias("_salts"))
        .distinct(),
        "members",
    )
    named = members.withColumnRenamed("_row", "_member")
    run, schema = _chunks(chunk, moduli)
    texts = source.join(sized(named, members.count(), BROADCAST_ROWS), F.col("_row") == F.col("_member"))
    texts = texts.groupBy(*members.columns, F.xxhash64(F.lit(1), "_text").alias("_more")).agg(F.first("_text").alias("_text")).drop("_more")  # rows that repeat id and text are compared once
    parts = texts.mapInArrow(run, schema)
    leads = parts.where("_lead").select("_fp", "_len", "_part", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.col("_bytes").alias("lead_bytes"))
    others = parts.where("not _lead").withColumn("_salt", F.pmod(F.xxhash64("_row", "_sha"), F.col("_salts")))
    unequal = (
        others.join(leads, ["_fp", "_len", "_part", "_salt"])
        .groupBy("_fp", "_len", "_row", "_sha")
        .agg(F.bool_and(F.col("_bytes") == F.col("lead_bytes")).alias("equal"))
        .where("not equal")
        .select(F.col("_fp").alias("x_fp"), F.col("_len").alias("x_len"), F.col("_row").alias("x_row"), F.col("_sha").alias("x_sha"), F.lit(True).alias("unequal"))
    )
    unequal = materialise(unequal, "unequal")  # texts that only share a fingerprint; as good as always none
    same = (F.col("_fp") == F.col("x_fp")) & (F.col("_len") == F.col("x_len")) & (F.col("_sha") == F.col("x_sha")) & (F.col("_row") == F.col("x_row"))
    marked = prints.join(unequal, same, "left").select("_rid", "_id", "_fp", "_len", "_sha", F.when(F.col("unequal"), F.col("_sha")).otherwise("").alias("_sub"))
    kept = marked.groupBy("_fp", "_len", "_sub").agg(first, F.count("*").alias("n")).where("n > 1")
    kept = materialise(kept.select("_fp", "_len", "_sub", F.struct("first._id", "first._rid", "n").alias("g")), "kept")
    return marked.join(kept, ["_fp", "_len", "_sub"], "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("g").isNull(), F.col("_id")).otherwise(F.col("g._id")).alias("keep_id"),
        F.coalesce(F.col("g.n"), F.lit(1)).cast("long").alias("group_size"),
        (F.col("g").isNull() | (F.col("g._rid") == F.col("_rid"))).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
