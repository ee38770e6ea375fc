"""Streams that stop, fail and are replayed, and rules that go on from where they were saved."""

from __future__ import annotations

import datetime as dt
import random
import time

from pyspark.sql import functions as F

from inkwell.operators import learning as L
from inkwell.operators.draft import RuleExtractor
from inkwell.operators.rulebook import RuleBook
from inkwell.schemas import CANDIDATE, JOBS
from inkwell.sources.readers import Store, drop_folder
from inkwell.streaming import rules as S
from inkwell.streaming.jobs import NO_DRAFT, FeedbackJobs, StatusTable

AT = dt.datetime(2024, 5, 1)
FEEDBACK = "feedback_id string, draft_id string, user_id string, draft_type string, submitted_at timestamp, original_draft string, edited_draft string"
EVENTS = f"user_id string, feedback_id string, draft_type string, submitted_at timestamp, candidates array<{CANDIDATE}>, applied_rule_ids array<string>, action string, rule_id string"


class Picky(RuleExtractor):
    """A model that fails on some feedback."""

    def extract(self, feedback):
        bad = F.contains("edited_draft", F.lit("BAD"))
        return super().extract(feedback).withColumn("candidates", F.when(bad, F.raise_error(F.lit("no model"))).otherwise(F.col("candidates")))


def state(jobs):
    rows = jobs.store.load("jobs", f"{JOBS}, batch string, state string").where("state = 'done'").collect()
    return sorted((r.feedback_id, r.status, r.error_message and r.error_message[:40], r.candidates and len(r.candidates), r.batch) for r in rows)


def test_jobs_fail_alone_and_replays_change_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    drafts = spark.createDataFrame([("d", ["r1"]), ("d", ["r1"])], "draft_id string, applied_rule_ids array<string>")
    jobs = FeedbackJobs(store, Picky().extract, lambda: drafts, "picky")
    feedback = lambda ids, more="": spark.createDataFrame([(f"f{i}", "none" if i == 5 else "d", "u", "internal_memo", AT, "a", f"a\n\nb{i}" + (" BAD" if i % 7 == 3 else "")) for i in ids], FEEDBACK)
    listener = StatusTable(spark, f"file://{tmp_path}/status")
    assert listener.rows().count() == 0
    spark.streams.addListener(listener)
    try:
        run = lambda: jobs.start(spark.readStream.schema(FEEDBACK).parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/checkpoint").awaitTermination()
        feedback(range(12)).coalesce(1).write.parquet(f"file://{tmp_path}/in")
        run()
        first = state(jobs)
        assert len(first) == 12 and jobs.taken == 12
        for n, status, error, candidates, _ in first:
            i = int(n[1:])
            want = ("failed", NO_DRAFT, None) if i == 5 else ("failed", None, None) if i % 7 == 3 else ("completed", None, 1)
            assert (status, candidates) == (want[0], want[2]) and (error == want[1] or (want[1] is None and status == "failed" and error))
        run()
        assert state(jobs) == first and jobs.taken == 12
        # the batch was done, but the query broke off before it said so
        drop_folder(spark, f"file://{tmp_path}/checkpoint/commits/0")
        drop_folder(spark, f"file://{tmp_path}/checkpoint/commits/.0.crc")
        run()
        assert state(jobs) == first and jobs.taken == 24
        feedback(range(12, 15)).write.mode("append").parquet(f"file://{tmp_path}/in")
        run()
        assert len(state(jobs)) == 15 and [x for x in state(jobs) if x[4] == "picky-0"] == first
        kept = store.load("jobs", f"{JOBS}, batch string, state string").where("feedback_id = 'f1'").collect()
        assert {r.status for r in kept} == {"processing", "completed"} and all(r.applied_rule_ids == ["r1"] and r.submitted_at == AT for r in kept)
        for _ in range(50):
            seen = {(r.query, r.batch): r.rows for r in listener.rows().collect()}
            if len(seen) > 1:
                break
            time.sleep(0.2)
        assert set(seen) == {("picky", 0), ("picky", 1)}
    finally:
        spark.streams.removeListener(listener)


def events(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        user, at = rng.choice("uvwxyz"), AT + dt.timedelta(minutes=rng.randrange(2000))
        if rng.random() < 0.2:
            out.append((user, f"e{k:04}", None, at, None, None, rng.choice(["enable", "disable", "delete"]), f"r{rng.randrange(9)}"))
        else:
            made = [(f"Rule {rng.choice(['one', 'two', 'three of many words'])}", rng.choice(["tone", "other"]), None, "x", [], round(rng.random() * 0.4, 2)) for _ in range(rng.randrange(3))]
            out.append((user, f"e{k:04}", "internal_memo", at, made, [], None, None))
    return out


def rules_of(rules):
    return sorted((r.user_id, r.insert_seq, r.rule_id, r.normalized_key, round(r.confidence, 6), r.support_count, r.decay_count, r.status, tuple(r.applicable_draft_types), r.last_updated) for r in rules.collect())


def test_folding_onward_equals_folding_all(spark):
    rows = events(1, 160)
    rows = sorted(rows, key=lambda r: r[3])
    every = spark.createDataFrame(rows, EVENTS)
    whole = rules_of(L.fold_batch(every))
    old, new = spark.createDataFrame(rows[:100], EVENTS), spark.createDataFrame([r for r in rows[100:] if r[0] != "u"], EVENTS)

    def never():
        raise AssertionError("only new feedback is to be read")

    rules, upto = L.fold_increment(L.fold_batch(old), L.positions(old), new, never)
    want = [r for r in whole if r[0] != "u"] + [r for r in rules_of(L.fold_batch(old)) if r[0] == "u"]
    assert rules_of(rules) == sorted(want)
    late = spark.createDataFrame([r for r in rows if r[0] == "u"][:3], EVENTS)
    most = spark.createDataFrame([r for r in rows if r not in [x for x in rows if x[0] == "u"][:3]], EVENTS)
    asked = []
    rules, upto = L.fold_increment(L.fold_batch(most), L.positions(most), late, lambda: asked.append(1) or every)
    assert rules_of(rules) == whole and asked == [1]
    assert {r.user_id: r.upto for r in upto.collect()} == {r.user_id: r.upto for r in L.positions(every).collect()}


def test_a_rulebook_reads_new_batches_only(spark, tmp_path):
    store, rows = Store(spark, f"file://{tmp_path}/store"), [r for r in sorted(events(2, 150), key=lambda r: r[3]) if r[6] is None]
    book = RuleBook(store)
    assert book.refresh() == 0 and book.rules().count() == 0
    done = lambda part: spark.createDataFrame(part, EVENTS).drop("action", "rule_id").select("*", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error_message"), F.current_timestamp().alias("at"))
    cuts = [0, 50, 90, len(rows)]
    read = []
    plain = book._events
    book._events = lambda only=None: read.append(only) or plain(only)
    for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
        store.replace(f"jobs/batch=b{n}/state=done", done(rows[a:b]))
        assert book.refresh() == n + 1 and book.refresh() == n + 1
        assert rules_of(book.rules()) == rules_of(L.fold_batch(spark.createDataFrame(rows[:b], EVENTS)))
    assert read == [{("jobs", f"b{n}")} for n in range(3)]  # and never all of them
    # a version that was not finished is done again
    store.replace("rule_state/version=4", book.rules().limit(0))
    assert rules_of(book.rules("u")) == [r for r in rules_of(L.fold_batch(spark.createDataFrame(rows, EVENTS))) if r[0] == "u"]


def test_entries_of_state_equal_the_fold(spark, tmp_path):
    rows = sorted(events(3, 120), key=lambda r: r[3])
    at, half = f"file://{tmp_path}", len(rows) // 2
    before = spark.conf.get(S.ROCKSDB[0], None)
    spark.conf.set(*S.ROCKSDB)
    try:
        for part in (rows[:half], rows[half:]):
            spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(f"{at}/in")
            folded = S.fold_entries(spark.readStream.schema(EVENTS).parquet(f"{at}/in"))
            keep = lambda out, batch: out.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")
            folded.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        spark.conf.unset(S.ROCKSDB[0]) if before is None else spark.conf.set(S.ROCKSDB[0], before)
    last = spark.read.parquet(f"{at}/out").groupBy("user_id", "rule_id").agg(F.max_by("rule", "batch").alias("rule")).where("rule is not null")
    plain = lambda rules: sorted((r.user_id, r.rule_id, r.normalized_key, round(r.confidence, 6), r.support_count, r.status) for r in rules.collect())
    assert plain(S.rules_of(last.select(F.concat(F.lit("["), "rule", F.lit("]")).alias("rules")))) == plain(L.fold_batch(spark.createDataFrame(rows, EVENTS)))


def test_rules_of_a_stream_may_end_on_whole_seconds(spark):
    """Times are read whether or not they have a fraction of a second."""
    rows = [S.json.dumps([rule | {"last_updated": at}]) for at in ("2024-01-01T00:00:00.123456", "2024-01-02T00:00:00", None) for rule in L.fold_feedback([], {"user_id": "u", "feedback_id": at or "-", "draft_type": "t", "submitted_at": at, "candidates": [{"description": "Rule a", "category": "other", "confidence": 0.5}]})]
    latest = spark.createDataFrame([(r,) for r in rows], "rules string").coalesce(1)
    got = sorted(str(r.last_updated) for r in S.rules_of(latest).collect())
    assert got == ["2024-01-01 00:00:00.123456", "2024-01-02 00:00:00", "None"]
