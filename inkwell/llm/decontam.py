"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window of an item is contained in a document only if all its words are, so one word of it is
prefix enough: its rarest in the documents, by counts over all of them. Documents are joined with
the windows on these words alone. The word's place in the window gives the one place where the
window could begin; it must lie inside the document with the window's whole length. What is left is
compared word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import bound_batches, column_of, mix64, text_blocks, word_hashes, word_spans

WINDOW = 13
#: Bytes of item texts that are matched, and broadcast, at once; more items go in further passes.
BLOCK_BYTES = 16 << 20
#: Candidates examined at once.
PIECE = 1 << 19
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _rolled(hashes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of ``length`` words from ``begin`` on."""
    out = np.zeros(len(begin), np.uint64)
    for k in range(int(length.max(initial=0))):
        use = length > k
        out[use] = out[use] * _STEP + hashes[begin[use] + k]
    return mix64(out + length.astype(np.uint64))


def item_windows(items: list[tuple[str, str]], window: int = WINDOW) -> dict:
    """Every window of the items: where it starts in their words, its length and its item."""
    names, starts, lengths, owner, words, hashes = [], [], [], [], [], []
    base = 0
    for lo, _, buf, offs in text_blocks(pa.array([t for _, t in items], pa.string())):
        low, s, e, first = word_spans(buf, offs)
        hashes.append(word_hashes(low, s, e))
        words += [low[a:b].tobytes() for a, b in zip(s, e, strict=True)]
        for r in range(len(offs) - 1):
            n = int(first[r + 1] - first[r])
            names.append(items[lo + r][0])
            size = min(window, n)
            for k in range(n - size + 1 if n else 0):
                starts.append(base + int(first[r]) + k)
                lengths.append(size)
                owner.append(lo + r)
        base += len(s)
    return {
        "names": names, "words": words, "hashes": np.concatenate([*hashes, np.zeros(0, np.uint64)]),
        "starts": np.array(starts, np.int64), "lengths": np.array(lengths, np.int64), "owner": np.array(owner, np.int64),
    }


def with_prefixes(found: dict, vocabulary: np.ndarray, counts: np.ndarray) -> dict:
    """Add the prefix word of each window, rarest first; windows with an unseen word fall out."""
    rarity = counts[np.searchsorted(vocabulary, found["hashes"])] if len(vocabulary) else np.zeros(0, np.int64)
    prefix = np.zeros(len(found["starts"]), np.int64)
    least = np.full(len(found["starts"]), np.iinfo(np.int64).max)
    for k in range(int(found["lengths"].max(initial=0))):
        use = np.flatnonzero(found["lengths"] > k)
        better = use[rarity[found["starts"][use] + k] < least[use]]
        least[better] = rarity[found["starts"][better] + k]
        prefix[better] = k
    keep = least > 0
    out = found | {k: found[k][keep] for k in ("starts", "lengths", "owner")} | {"prefix": prefix[keep]}
    out["digest"] = _rolled(found["hashes"], out["starts"], out["lengths"])
    token = found["hashes"][out["starts"] + out["prefix"]]
    out["order"] = np.argsort(token, kind="stable")
    out["tokens"], begins = np.unique(token[out["order"]], return_index=True)
    out["begins"] = np.append(begins, len(token))
    out["sieve"] = np.zeros(1 << 16, np.bool_)
    out["sieve"][(out["tokens"] & np.uint64(0xFFFF)).astype(np.int64)] = True
    return out


def _occurrences(index: dict, low, starts, ends, first):
    """Row, first word, and window of every occurrence in a block."""
    hashes = word_hashes(low, starts, ends)
    at = np.flatnonzero(index["sieve"][(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    token = np.searchsorted(index["tokens"], hashes[at])
    hit = index["tokens"][np.minimum(token, len(index["tokens"]) - 1)] == hashes[at]
    at, token = at[hit], token[hit]
    fan = index["begins"][token + 1] - index["begins"][token]
    total = np.cumsum(fan)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PIECE, "right")))
        own = fan[lo:hi]
        inner = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        window = index["order"][np.repeat(index["begins"][token[lo:hi]], own) + inner]
        begin = np.repeat(at[lo:hi], own) - index["prefix"][window]
        row = np.searchsorted(first, np.repeat(at[lo:hi], own), "right") - 1
        length = index["lengths"][window]
        fits = (begin >= first[row]) & (begin + length <= first[row + 1])
        row, begin, window, length = row[fits], begin[fits], window[fits], length[fits]
        same = _rolled(hashes, begin, length) == index["digest"][window]
        for r, b, w in zip(row[same].tolist(), begin[same].tolist(), window[same].tolist(), strict=True):
            o = int(index["starts"][w])
            n = int(index["lengths"][w])
            if all(low[starts[b + k] : ends[b + k]].tobytes() == index["words"][o + k] for k in range(n)):
                yield r, b, n, int(index["owner"][w])
        lo = hi


def _count_words(vocabulary):
    def run(batches):
        words = vocabulary.value
        counts = np.zeros(len(words), np.int64)
        for batch in batches:
            for _, _, buf, offs in text_blocks(batch.column(0)):
                hashes = word_hashes(*word_spans(buf, offs)[:3])
                at = np.searchsorted(words, hashes)
                at[at == len(words)] = 0
                counts += np.bincount(at[words[at] == hashes], minlength=len(words))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["word", "n"])

    return run


def _mark(shared, text_col: str):
    def run(batches):
        index = shared.value
        for batch in batches:
            spans_before, items_before = column_of(batch, "_c_spans"), column_of(batch, "_c_items")
            n_words, n_hit, spans, items = [], [], [], []
            for lo, hi, buf, offs in text_blocks(column_of(batch, text_col)):
                low, starts, ends, first = word_spans(buf, offs)
                edge = np.zeros(len(starts) + 1, np.int64)
                found: dict[int, set] = {}
                for r in range(hi - lo):
                    if len(items_before[lo + r]):
                        found[r] = set(items_before[lo + r].as_py())
                        for b, e in zip(*[iter(spans_before[lo + r].as_py())] * 2, strict=True):
                            edge[first[r] + b] += 1
                            edge[first[r] + e] -= 1
                if len(index["tokens"]):
                    for r, b, n, owner in _occurrences(index, low, starts, ends, first):
                        edge[b] += 1
                        edge[b + n] -= 1
                        found.setdefault(r, set()).add(index["names"][owner])
                hit = np.cumsum(edge[:-1]) > 0
                upto = np.concatenate([[0], np.cumsum(hit)])
                n_words.append(first[1:] - first[:-1])
                n_hit.append(upto[first[1:]] - upto[first[:-1]])
                for r in range(hi - lo):
                    items.append(sorted(found.get(r, ())))
                    own = np.diff(hit[first[r] : first[r + 1]].astype(np.int8), prepend=0, append=0) if r in found else ()
                    spans.append(np.flatnonzero(own).tolist())
            new = {
                "_c_words": pa.array(np.concatenate([*n_words, np.zeros(0, np.int64)]).astype(np.int64)),
                "_c_hit": pa.array(np.concatenate([*n_hit, np.zeros(0, np.int64)]).astype(np.int64)),
                "_c_spans": pa.array(spans, pa.list_(pa.int64())),
                "_c_items": pa.array(items, pa.list_(pa.string())),
            }
            names = batch.schema.names
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(i)) for i, c in enumerate(names)], names=names)

    return run


def mark_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``docs`` and _c_words, _c_hit, _c_spans, _c_items.

    Words are the runs of 0-9, a-z and non-ASCII characters after A-Z became lower-case. A window is
    ``window`` consecutive words of an item, or all words of a shorter one. _c_hit counts the
    document's words inside any occurrence of a window, _c_spans has their word ranges, _c_items the
    items with occurring windows, sorted as strings. Null and empty texts have no words; a null item
    id reads as ``null``; repeated items and rows are marked alike; an empty table of items marks
    nothing. No row is shuffled, at any number of items: blocks of ``block_bytes`` of item texts are
    matched one after another, so what is broadcast has that bound. Columns of ``docs`` that begin
    with ``_c_`` are not allowed.
    """
    if any(c.startswith("_c_") for c in docs.columns):
        raise ValueError("columns of docs must not begin with _c_")
    spark = docs.sparkSession
    bound_batches(spark)
    bench = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("name"), F.col(item_text_col).alias("words")).where("words is not null")
    blocks = max(1, -(-(bench.agg(F.sum(F.octet_length("words"))).first()[0] or 0) // block_bytes))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    out = docs.select("*", F.lit(0).cast("long").alias("_c_words"), F.lit(0).cast("long").alias("_c_hit"), empty("bigint").alias("_c_spans"), empty("string").alias("_c_items"))
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("name", "words"), F.lit(blocks)) == k) if blocks > 1 else bench
        found = item_windows([tuple(r) for r in part.collect()], window)
        vocabulary = np.unique(found["hashes"])
        counts = np.zeros(len(vocabulary), np.int64)
        if len(vocabulary):
            words = spark.sparkContext.broadcast(vocabulary)
            for word, n in docs.select(text_col).mapInArrow(_count_words(words), "word long, n long").groupBy("word").agg(F.sum("n")).collect():
                counts[word] = n
        index = spark.sparkContext.broadcast(with_prefixes(found, vocabulary, counts))
        out = out.mapInArrow(_mark(index, text_col), out.schema)
    return out


def is_contaminated(marked: DataFrame):
    return (F.col("_c_hit") > 0) & (F.col("_c_hit") * 20 >= F.col("_c_words"))


def decontamination_report(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marked = mark_contamination(slim, items, text_col="_text", **options)
    return marked.select(
        F.col("_id").alias(id_col),
        F.col("_c_words").alias("n_words"),
        F.col("_c_hit").alias("n_hit"),
        F.size("_c_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_c_items", ","), 256).alias("items_sha256"),
        is_contaminated(marked).alias("contaminated"),
        F.col("_c_spans").alias("spans"),
        F.col("_c_items").alias("items"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    text_col = options.pop("text_col", "text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # the names of docs may be any
    marked = mark_contamination(plain, items, text_col=plain.columns[docs.columns.index(text_col)], **options)
    return marked.where(~is_contaminated(marked)).select(*[F.col(c).alias(n) for c, n in zip(plain.columns, docs.columns, strict=True)])


def report_by_hand(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """The same by brute force, for tests: id to (n_words, n_hit, items)."""
    import re

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, text in docs:
        words = split(text)
        hit, names = set(), set()
        for name, item in items:
            own = split(item)
            n = min(window, len(own))
            for k in range(len(own) - n + 1 if n else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == own[k : k + n]:
                        hit |= set(range(j, j + n))
                        names.add("null" if name is None else str(name))
        out[i] = (len(words), len(hit), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), len(names))
    return out
