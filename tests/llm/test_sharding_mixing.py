from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.llm.mixing import capped_targets, mix_sources, sainte_lague, taken_texts
from inkwell.llm.sharding import karmarkar_karp, shard_by_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, taken int, size string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, "y") for i, t, s in rows], SCHEMA)


def plain_differencing(sizes, n):
    """The last spread when the two tuples of largest spread are joined, largest with smallest, again and again."""
    left = [sorted([s] + [0] * (n - 1), reverse=True) for s in sizes]
    order = list(range(len(left)))  # ties go to the earlier
    while len(left) > 1:
        a = max(range(len(left)), key=lambda i: (left[i][0] - left[i][-1], -order[i]))
        one, at = left.pop(a), order.pop(a)
        b = max(range(len(left)), key=lambda i: (left[i][0] - left[i][-1], -order[i]))
        two, other = left.pop(b), order.pop(b)
        joined = sorted((x + y for x, y in zip(one, reversed(two))), reverse=True)
        left.append([x - joined[-1] for x in joined])
        order.append(min(at, other))
    return left[0][0] - left[0][-1]


def test_karmarkar_karp_beats_the_classic_example():
    ways = karmarkar_karp([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, w in zip([8, 7, 6, 5, 4], ways) if w == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16]  # the known result of differencing
    assert karmarkar_karp([], 3) == [] and karmarkar_karp([5], 3) in ([0], [1], [2])
    for sizes, n in ((list(range(1, 400)), 16), ([random.Random(k).randint(1, 10**6) for k in range(300)], 7), ([5] * 9, 4)):
        sums = Counter()
        for s, w in zip(sizes, karmarkar_karp(sizes, n)):
            sums[w] += s
        spread = max(sums[k] for k in range(n)) - min(sums[k] for k in range(n))
        assert spread == plain_differencing(sizes, n) and sum(sums.values()) == sum(sizes)


def test_shards_of_whole_table(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = shard_by_bytes(source).join(source, "doc_id").collect()
    assert len(rows) == source.count()
    per, groups, slots = {}, {}, {}
    for r in rows:
        data = r.text.encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        per[r.shard] = per.get(r.shard, 0) + r["size"]
        groups.setdefault(r.text, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(g) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(per) == set(range(16)) and max(per.values()) - min(per.values()) < 0.02 * max(per.values())


@pytest.mark.parametrize("buckets", [1, 50_000])
def test_shards_with_nulls_repeats_and_one_huge_group(spark, buckets):
    rows = [(i, "same " * 50, "a") for i in range(60)] + [(None, None, None), (None, None, "b"), (7, "", "b"), (7, "", "b")] + [(100 + i, "t" * i, "c") for i in range(40)]
    out = shard_by_bytes(docs(spark, rows), shards=4, rows_per_bucket=buckets).collect()
    assert len(out) == len(rows)
    big = {r.shard for r in out if r["size"] == 251}
    assert len(big) == 1 and all(r["size"] == 251 for r in out if r.shard in big)  # nothing joins the huge group
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert shard_by_bytes(docs(spark, [])).count() == 0


def brute_sainte_lague(votes, seats):
    out = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def test_apportionment_by_highest_quotient():
    for votes in ([53, 24, 23], [5.5, 2.5, 2.0, 0.0, 9.0], [1.0], [10.0] * 7, [1000.0, 1.0, 1.0, 1.0]):
        for seats in (0, 1, 2, 7, 10, 99, 1000):
            if sum(votes):
                assert sainte_lague(list(map(float, votes)), seats) == brute_sainte_lague(votes, seats)


def test_targets():
    assert capped_targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = capped_targets([10, 1000, 90], [5, 2, 1])
    assert got[0] == 30 and abs(sum(got) - 1100) < 1e-6 and got[2] == 270
    assert capped_targets([0, 0], [5, 2]) == [0, 0] and capped_targets([], []) == []


def test_mix_of_whole_table(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix_sources(source).join(source, "doc_id").collect()
    again = {r.doc_id: r.taken for r in mix_sources(source.repartition(7)).collect()}
    assert {r.doc_id: r.taken for r in out} == again and len(out) == source.count()
    by = {}
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) and 0 <= r.taken <= 3 * r["size"]
        by.setdefault(r.source, []).append(r)
    names = sorted(by)
    want = capped_targets([sum(r["size"] for r in by[s]) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want):
        assert abs(by[s][0].target - t) < 1e-6 and by[s][0].source_size == sum(r["size"] for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= 0.01 * t + 20


def test_mix_edges_and_its_texts(spark):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 50)), "big" if i % 3 else None) for i in range(300)] + [(900, None, "b"), (901, "", None), (None, "a b", "c"), (1, rows_text := "u v w", "c"), (1, rows_text, "c")]
    frame = docs(spark, rows)
    mixed = mix_sources(frame).collect()
    assert len(mixed) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in mixed)
    texts = taken_texts(frame)
    assert texts.columns == frame.columns
    words = {r.doc_id: r.n for r in texts.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in taken.items() if v}
    originals = {t for _, t, _ in rows if t}
    assert sum(r.text in originals for r in texts.collect()) > 0.8 * texts.count()
    assert mix_sources(docs(spark, [])).count() == 0 and taken_texts(docs(spark, [])).count() == 0


def test_small_sources_among_many_shards_reach_their_targets(spark):
    text = lambda n: " ".join(["w"] * n)
    rows = [(i, text(10), "a") for i in range(40)] + [(100, text(30), "b")] + [(200 + i, text(7 + i), "c") for i in range(5)] + [(1000 + i, text(100), "d") for i in range(500)]
    out = mix_sources(docs(spark, rows), least_shards=240, blocks_per_shard=1).join(docs(spark, rows).select("doc_id", "source"), "doc_id").collect()
    assert len(out) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in out)
    targets = {r.source: r.target for r in out}
    assert (targets["a"], targets["b"]) == (1200, 90)
    for s, t in targets.items():
        assert abs(sum(r.taken for r in out if r.source == s) - t) <= 1
    again = mix_sources(docs(spark, rows).repartition(5), least_shards=240, blocks_per_shard=1).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in out}


def test_assignment_is_that_of_differencing_on_the_units(spark, sf_dir):
    """Shards of units, found again from the table, have the spread that plain differencing of them gives."""
    shards, units = 16, 8
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard_by_bytes(source, shards, units_per_shard=units, carry=("text", "source"))
    assert out.columns[-2:] == ["text", "source"]
    rows = out.withColumn("h", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))).withColumn("bundle", F.pmod(F.xxhash64("h"), F.lit(shards * units))).collect()
    sizes, of_unit, total = Counter(), {}, sum(r.size for r in rows)
    groups = Counter()
    for r in rows:
        groups[r.text] += r.size
    cut = max(1, total // (shards * units))
    for r in rows:
        unit = ("group", r.text) if groups[r.text] >= cut else ("bundle", r.bundle)
        sizes[unit] += r.size
        assert of_unit.setdefault(unit, r.shard) == r.shard
    filled = Counter()
    for unit, n in sizes.items():
        filled[of_unit[unit]] += n
    assert max(filled[k] for k in range(shards)) - min(filled[k] for k in range(shards)) == plain_differencing(sorted(sizes.values(), reverse=True), shards)
    kept = {r.doc_id: r.text for r in source.collect()}
    assert all(kept[r.doc_id] == r.text for r in rows)
