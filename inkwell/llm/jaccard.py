"""N-gram Jaccard join by MinHash banding.

Documents are sets of word n-grams. Equal sets are one class of copies with one representative.
Representatives that agree in all rows of a band share a bucket; each bucket's smallest member leads
it, and every other member is compared with its leads on full sets. Members of one lead are then
compared with each other, in blocks, by what their sets differ from the lead's; a pair that shares
several leads counts at the smallest. So every pair that shares a bucket is verified once.

Members that are all like their lead are in its class without being compared with each other, so
classes cost a row for each member and, for the few that are unlike their lead, one for each block
of the others. Only to count links is every pair of a lead's members compared: M members then are
shuffled M / BLOCK times each, as products of 0/1 matrices, never as rows for pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.llm.common import column_of, discard, materialise, mix64, sized, text_blocks, word_hashes, word_spans

GRAM, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Hash functions at most; the more, the fewer unlike documents meet in a bucket.
MOST_HASHES = 320
#: Members of a lead in a block, and n-grams by which these differ from the lead, both on average;
#: two blocks are compared at once.
BLOCK, BLOCK_ITEMS = 1024, 1 << 18
BROADCAST_ROWS = 100_000
LABELS_PER_FILE = 500_000
_STEP = np.uint64(0x9FB21C651E98DF25)


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows a band for which pairs at the threshold meet with this chance."""
    best = (1, 1)
    for rows in range(1, most + 1):
        chance = threshold**rows
        bands = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
        if bands * rows > most:
            break
        best = (bands, rows)
    return best


def gram_sets(buf: np.ndarray, offs: np.ndarray, gram: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each row; a text of fewer words is one n-gram of all."""
    low, starts, ends, first = word_spans(buf, offs)
    words = word_hashes(low, starts, ends)
    n = max(0, len(words) - gram + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(gram):
        rolled = rolled * _STEP + words[k : k + n]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= gram:
            out.append(np.unique(rolled[a : b - gram + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = h * _STEP + w
            out.append(mix64(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_hashes(grams: np.ndarray, bands: int, rows: int, seed: int = 11) -> np.ndarray:
    """A hash for each band of the MinHash signature of a set."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(grams), 1024):
        np.minimum(least, (grams[k : k + 1024, None] * a + b).min(axis=0), out=least)
    h = np.zeros(bands, np.uint64)
    for column in (least >> np.uint64(32)).reshape(bands, rows).T:
        h = h * _STEP + column
    return mix64(h + np.arange(bands, dtype=np.uint64))


def _set_key(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signatures(id_type: str, gram: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            keys, sizes, hashes = [], [], []
            for _, _, buf, offs in text_blocks(column_of(batch, "_text")):
                for grams in gram_sets(buf, offs, gram):
                    keys.append(_set_key(grams) if len(grams) else None)
                    sizes.append(len(grams))
                    hashes.append(band_hashes(grams, bands, rows).view(np.int64) if len(grams) else [])
            yield pa.RecordBatch.from_arrays([column_of(batch, "_id"), column_of(batch, "_row"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["_id", "_row", "_set", "_n", "_bands"])

    return run, f"_id {id_type}, _row long, _set long, _n long, _bands array<long>"


def _full_sets(gram: int):
    def run(batches):
        for batch in batches:
            wanted = column_of(batch, "_set").to_pylist()
            keys, sets = [], []
            for lo, _, buf, offs in text_blocks(column_of(batch, "_text")):
                for r, grams in enumerate(gram_sets(buf, offs, gram)):
                    if len(grams) and _set_key(grams) == wanted[lo + r]:  # else a row of an equal key
                        keys.append(wanted[lo + r])
                        sets.append(grams.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["_set", "grams"])

    return run


def _compare(threshold: float):
    """Each member with its lead: whether alike, and the grams that only one of them has."""

    def run(batches):
        for batch in batches:
            like, sizes, gone, differ = [], [], [], []
            for one, two in zip(column_of(batch, "lead_grams"), column_of(batch, "member_grams"), strict=True):
                a, b = one.values.to_numpy().view(np.uint64), two.values.to_numpy().view(np.uint64)
                only_a, only_b = np.setdiff1d(a, b, True), np.setdiff1d(b, a, True)
                both = len(a) - len(only_a)
                like.append(both >= threshold * (len(a) + len(b) - both) - 1e-9)
                sizes.append(len(a))
                gone.append(len(only_a))
                differ.append(np.concatenate([only_a, only_b]).view(np.int64))
            yield pa.RecordBatch.from_arrays([column_of(batch, "lead"), column_of(batch, "member"), pa.array(like, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(differ, pa.list_(pa.int64()))], names=["lead", "member", "alike", "n_lead", "gone", "differ"])

    return run, "lead long, member long, alike boolean, n_lead long, gone long, differ array<long>"


def _common(one, two) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices in slices; a list
    is its size, and for each item its set's number and itself."""
    shared = np.intersect1d(one[2], two[2])
    out = np.zeros((one[0], two[0]), np.float32)
    for k in range(0, len(shared), 4096):
        part = shared[k : k + 4096]
        dense = []
        for n, r, v in (one, two):
            at = np.minimum(np.searchsorted(part, v), len(part) - 1)
            hit = part[at] == v
            m = np.zeros((n, len(part)), np.float32)
            m[r[hit], at[hit]] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]), column.flatten().to_numpy()


def _part(offs: np.ndarray, items: np.ndarray, rows: np.ndarray):
    """The chosen sets of a list column, for ``_common``."""
    n = offs[rows + 1] - offs[rows]
    own = np.repeat(np.arange(len(rows)), n)
    return len(rows), own, items[np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n) + offs[rows][own]]


def _counted(member: np.ndarray, leads, lead: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which linked pairs count here: the lead is the smallest that both have, and neither leads the other."""
    offs, values = _lists(leads)
    sets = [values[x:y] for x, y in zip(offs[:-1], offs[1:], strict=True)]
    names, kind = np.unique(np.array([v.tobytes() for v in sets], object), return_inverse=True)
    kinds = [set(np.frombuffer(v, np.int64).tolist()) for v in names]
    codes, at = np.unique(kind[a] * len(kinds) + kind[b], return_inverse=True)
    least = np.array([min(kinds[c // len(kinds)] & kinds[c % len(kinds)]) == lead for c in codes.tolist()], bool)[at]
    order = np.argsort(member)
    place = np.minimum(np.searchsorted(member[order], values), len(member) - 1)
    hit = member[order][place] == values
    led = np.repeat(np.arange(len(sets)), np.diff(offs))[hit] * len(member) + order[place[hit]]
    return least & ~np.isin(a * len(member) + b, led) & ~np.isin(b * len(member) + a, led)


def _links(threshold: float, count_links: bool):
    """For the members of a lead in two blocks: links to each, and a common label of linked ones."""

    def run(table: pa.Table) -> pa.Table:
        lead = table["lead"][0].as_py()
        block = table["_block"].to_numpy()
        low, high = table["_low"][0].as_py(), table["_high"][0].as_py()
        member = table["member"].to_numpy()
        offs, items = _lists(table["differ"])
        gone, n_lead = table["gone"].to_numpy(), table["n_lead"][0].as_py()
        own = n_lead - 2 * gone + np.diff(offs)
        i, j = np.flatnonzero(block == low), np.flatnonzero(block == high)
        both = n_lead - gone[i][:, None] - gone[j][None] + _common(_part(offs, items, i), _part(offs, items, j))
        alike = both >= threshold * (own[i][:, None] + own[j][None] - both) - 1e-6
        if low == high:
            alike = np.triu(alike, 1)
        count, label = np.zeros(len(member), np.int64), np.arange(len(member))
        a, b = np.nonzero(alike)
        a, b = i[a], j[b]
        if count_links and len(a):
            copies, fresh = table["copies"].to_numpy(), _counted(member, table["leads"], lead, a, b)
            np.add.at(count, a[fresh], copies[b[fresh]])
            np.add.at(count, b[fresh], copies[a[fresh]])
        while True:
            least = label.copy()
            np.minimum.at(least, a, label[b])
            np.minimum.at(least, b, label[a])
            least = least[least]
            if (least == label).all():
                break
            label = least
        keep = np.flatnonzero((count > 0) | (label != np.arange(len(member))))
        return pa.table({"_set": pa.array(member[keep]), "links": pa.array(count[keep]), "other": pa.array(member[label[keep]])})

    return run, "_set long, links long, other long"


def components(edges: DataFrame) -> DataFrame:
    """(_set, label): the least member of each connected component of edges (a, b).

    Rounds of taking the least label among neighbours and then that label's own label, each written
    to the shared folder; their number grows with the logarithm of the longest path.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    files = max(1, -(-both.count() // LABELS_PER_FILE))  # labels are few bytes: not a file for each shuffle partition
    labels = materialise(both.groupBy(F.col("a").alias("_set")).agg(F.least(F.col("_set"), F.min("b")).alias("label")).coalesce(files), "labels")
    written = labels
    while True:
        near = both.join(labels.select(F.col("_set").alias("b"), F.col("label").alias("theirs")), "b").groupBy(F.col("a").alias("_set")).agg(F.min("theirs").alias("near"))
        step = labels.join(near, "_set").select("_set", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("_set").alias("label"), F.col("label").alias("root"))
        after = materialise(step.join(jump, "label").select("_set", "old", F.least("label", "root").alias("label")).coalesce(files), "labels")
        discard(written)
        if not after.where("label <> old").limit(1).count():
            discard(both)
            return after.select("_set", "label")
        labels, written = after.select("_set", "label"), after


def _row_key(docs: DataFrame):
    """A key for each row by all its columns that have a hash: stable over scans, the same for equal rows."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))])


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float, gram: int, recall: float, count_links: bool) -> DataFrame:
    """A row for each row of ``docs``: its id, key, class (null without words), class_id, links, copies."""
    bands, rows = choose_bands(threshold, recall)
    id_type = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), _row_key(docs).alias("_row"))
    run, schema = _signatures(id_type, gram, bands, rows)
    signs = materialise(source.mapInArrow(run, schema), "signatures")
    reps = materialise(signs.where("_n > 0").groupBy("_set").agg(F.count("*").alias("copies"), F.min("_id").alias("_least"), F.min("_row").alias("_wanted"), F.first("_bands").alias("_bands")), "reps")
    buckets = reps.select("_set", F.posexplode("_bands").alias("_band", "_hash"))
    leads = buckets.groupBy("_band", "_hash").agg(F.min("_set").alias("lead"), F.max("_set").alias("last")).where("lead <> last").drop("last")
    leads = materialise(leads, "leads")  # a written side: the join can split a bucket that many share
    pairs = materialise(buckets.join(leads, ["_band", "_hash"]).where("lead <> _set").select("lead", F.col("_set").alias("member")).distinct(), "pairs")

    wanted = pairs.select(F.col("lead").alias("_set")).union(pairs.select("member")).distinct().join(reps.select("_set", "_wanted"), "_set")
    wanted = materialise(wanted, "wanted")
    texts = source.join(sized(wanted, wanted.count(), BROADCAST_ROWS), F.col("_row") == F.col("_wanted")).select("_set", "_text")
    sets = materialise(texts.mapInArrow(_full_sets(gram), "_set long, grams array<long>").dropDuplicates(["_set"]), "sets")
    side = lambda who: sets.select(F.col("_set").alias(who), F.col("grams").alias(f"{who}_grams"))
    run, schema = _compare(threshold)
    compared = materialise(pairs.join(side("member"), "member").join(side("lead"), "lead").mapInArrow(run, schema), "compared")

    copies = lambda who, name: reps.select(F.col("_set").alias(who), F.col("copies").alias(name))
    star = compared.where("alike").select("lead", "member")
    share = lambda what: F.greatest(F.ceil(F.count(F.when(what, 1)) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(what, F.size("differ"))), F.lit(0)) / BLOCK_ITEMS)).cast("int")
    crowd = compared.groupBy("lead").agg(share(~F.col("alike")).alias("_far"), share(F.col("alike")).alias("_near"), F.count("*").alias("k")).where("k > 1").drop("k")
    crowd = materialise(crowd if count_links else crowd.where("_far > 0"), "crowd")
    inside = compared.join(crowd, "lead")
    if count_links:
        own_leads = materialise(pairs.groupBy("member").agg(F.sort_array(F.collect_list("lead")).alias("leads")), "own")
        inside = inside.join(own_leads, "member").join(copies("member", "copies"), "member")
    else:
        inside = inside.withColumn("leads", F.lit(None).cast("array<long>")).withColumn("copies", F.lit(None).cast("long"))
    hashed = F.xxhash64("member")  # blocks of members unlike their lead come first
    inside = inside.withColumn("_block", F.when(F.col("alike"), F.col("_far") + F.pmod(hashed, F.greatest(F.lit(1), "_near"))).otherwise(F.pmod(hashed, F.greatest(F.lit(1), "_far"))).cast("int"))
    last = F.col("_far") + F.col("_near") - 1 if count_links else F.when(F.col("alike"), F.col("_far") - 1).otherwise(F.col("_far") + F.col("_near") - 1)
    inside = inside.withColumn("_with", F.explode(F.sequence(F.lit(0), last)))
    inside = inside.select("lead", "member", "copies", "leads", "n_lead", "gone", "differ", "_block", F.least("_block", "_with").alias("_low"), F.greatest("_block", "_with").alias("_high"))
    run, schema = _links(threshold, count_links)
    inner = materialise(inside.groupBy("lead", "_low", "_high").applyInArrow(run, schema), "inner")

    if count_links:
        linked = star.join(copies("member", "mc"), "member").join(copies("lead", "lc"), "lead")
        links = linked.select(F.col("lead").alias("_set"), F.col("mc").alias("links")).union(linked.select("member", "lc")).union(inner.select("_set", "links"))
        links = links.groupBy("_set").agg(F.sum("links").alias("links"))
    else:
        links = reps.select("_set", F.lit(None).cast("long").alias("links")).limit(0)
    edges = star.select(F.col("lead").alias("a"), F.col("member").alias("b")).union(inner.where("_set <> other").select("_set", "other"))
    labels = materialise(components(edges).join(reps.select("_set", "_least"), "_set").join(links, "_set", "left"), "classes")
    names = labels.groupBy("label").agg(F.min("_least").alias("class_id"))
    named = labels.join(names, "label").select("_set", "label", "class_id", "links")
    return (
        signs.select("_id", "_row", "_set")
        .join(reps.select("_set", "_least", "copies"), "_set", "left")
        .join(named, "_set", "left")
        .select("_id", "_row", F.coalesce("label", "_set").alias("_class"), F.coalesce("class_id", "_least", "_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("copies", F.lit(1)).alias("copies"))
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL, count_links: bool = True) -> DataFrame:
    """One row per input row: id, class_id, n_links, n_copies.

    Two rows are linked when the Jaccard index of their word ``gram``-gram sets is at least
    ``threshold``; copies (equal sets) are linked too. ``n_links`` counts the other rows a row is
    linked with, ``n_copies`` the rows with its set, itself included. ``class_id`` is the smallest id
    that links lead to. Pairs at the threshold meet with a chance of ``recall``, more alike ones with
    a higher one; every pair that meets is verified on full sets (of 64-bit n-gram hashes). Rows
    without words (null, empty) are linked with nothing and form classes of their own. Ids may be
    null or repeat; empty tables give no rows. Without ``count_links`` n_links is null and classes are
    the same; members of a class are then not compared with each other, which is for large clusters.
    """
    return _classes(docs, id_col, text_col, threshold, gram, recall, count_links).select(
        F.col("_id").alias(id_col),
        "class_id",
        (F.col("links") + F.col("copies") - 1 if count_links else F.lit(None)).cast("long").alias("n_links"),
        F.col("copies").cast("long").alias("n_copies"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL) -> DataFrame:
    """One row of ``docs`` for each class, with its columns: that of the smallest id, null last, and of
    equal ids that of the smallest key. Rows without words are classes of their own, so all stay. Texts
    are shuffled once, by row key; two rows that share that 64-bit key could both stay, none is lost."""
    rows = materialise(_classes(docs, id_col, text_col, threshold, gram, recall, False).select("_id", "_row", "_class"), "members")
    first = rows.where("_class is not null").groupBy("_class").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_row").alias("r"))).alias("w"))
    kept = first.select(F.col("w.i").alias("_i"), F.col("w.r").alias("_r"), F.lit(False).alias("_all"))
    kept = kept.union(rows.where("_class is null").select("_id", "_row", F.lit(True)).distinct())
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # the names of docs may be any
    key = f"c{docs.columns.index(id_col)}"
    out = plain.withColumn("_row", _row_key(docs.toDF(*plain.columns))).join(kept.select("_r", "_all").distinct(), F.col("_row") == F.col("_r"))
    nth = F.row_number().over(Window.partitionBy("_row", key).orderBy(key))  # of equal rows of a class one stays, whichever
    out = out.withColumn("_nth", nth).where(F.col("_all") | (F.col("_nth") == 1))
    return out.select(*[F.col(c).alias(n) for c, n in zip(plain.columns, docs.columns, strict=True)])
