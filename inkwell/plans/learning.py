"""Queries on rules, diffs, feedback and streams."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.config import DEFAULT
from inkwell.functions import rules as U
from inkwell.operators import learning as L
from inkwell.operators.draft import Embedder, RuleExtractor
from inkwell.operators.index import PostingIndex
from inkwell.operators.rulebook import RuleBook
from inkwell.schemas import CANDIDATE, JOBS
from inkwell.sources.readers import Store, drop_folder, in_order_of, latest, parquet, settled, shared_dir
from inkwell.streaming import rules as S
from inkwell.streaming.jobs import NO_DRAFT, FeedbackJobs

CONFIDENCE = "round(value - floor(value), 2)"
CATEGORY = "CASE WHEN event_type = 'click' THEN 'tone' WHEN event_type = 'view' THEN 'structure' ELSE 'other' END"


def rule_key(spark, sf):
    p = parquet(spark, sf, "part")
    return p.select("p_partkey", U.rule_key(F.concat(F.lit("  Use: "), "p_name", F.lit("--"), "p_brand", F.lit("! é ÄB "), "p_type")).alias("key"))


def _pairs(spark, sf):
    """Neighbouring parts of a brand, by key."""
    p = parquet(spark, sf, "part")
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = p.withColumn("key", U.rule_key(F.concat_ws(" ", "p_name", "p_type")))
    return p.select("p_partkey", "key", F.lead("key").over(w).alias("other")).where("other is not null")


def rule_jaccard(spark, sf):
    return _pairs(spark, sf).select("p_partkey", F.round(U.token_overlap(F.col("key"), F.col("other")), 6).alias("overlap"))


def rule_sequence_ratio(spark, sf):
    return _pairs(spark, sf).select("p_partkey", F.round(U.sequence_ratio("key", "other"), 6).alias("ratio"))


def structured_diff(spark, sf):
    """Changed blocks between consecutive assistant turns."""
    c = parquet(spark, sf, "conversations").where("role = 'assistant'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    blocks = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    pairs = c.select("conv_id", "turn", blocks.alias("draft"), F.lead(blocks).over(w).alias("edited")).where("edited is not null")
    return pairs.select("conv_id", "turn", F.posexplode(U.structured_diff("draft", "edited")).alias("pos", "d")).select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "d.operation", "d.before", "d.after")


def rule_match_best(spark, sf):
    """Every part as a candidate against all earlier parts of its brand as rules; category is the type."""
    p = parquet(spark, sf, "part").withColumn("key", U.rule_key(F.concat_ws(" ", "p_name", "p_type")))
    rows = p.select(F.col("p_brand").alias("user_id"), F.col("p_type").alias("category"), "key", "p_partkey")
    rules = rows.select("user_id", "category", F.col("key").alias("normalized_key"), F.col("p_partkey").cast("string").alias("rule_id"), F.col("p_partkey").alias("insert_seq"))
    candidates = rows.select("user_id", "category", "key", F.col("p_partkey").cast("string").alias("candidate_id"), F.col("p_partkey").alias("insert_seq"))
    return L.best_matches(candidates, rules)


def _observations(spark, sf):
    return parquet(spark, sf, "events").select("user_id", F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.expr(CONFIDENCE).alias("confidence"))


def rule_fold_exact(spark, sf):
    """Confidence and support of each key from all its observations."""
    return L.fold_exact(_observations(spark, sf))


def _candidate(description, confidence):
    """One candidate of a feedback, which suits its draft type."""
    return F.struct(description.alias("description"), F.lit("other").alias("category"), F.lit(None).cast("string").alias("example_before"), F.lit(None).cast("string").alias("example_after"), F.array().cast("array<string>").alias("applicable_draft_types"), F.expr(confidence).alias("confidence"))


def _feedback(events):
    """Every event as a feedback with one candidate."""
    made = _candidate(F.concat(F.lit("Rule "), "event_type"), CONFIDENCE)
    return events.select(F.col("user_id").cast("string").alias("user_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("feedback_id"), F.lit("internal_memo").alias("draft_type"), F.col("ts").cast("timestamp").alias("submitted_at"), F.array(made).alias("candidates"), F.array().cast("array<string>").alias("applied_rule_ids"))


def rule_fold(spark, sf):
    """The whole fold of all events, a rule for each kind that the user's events have."""
    out = L.fold_batch(_feedback(parquet(spark, sf, "events")))
    return out.select("user_id", F.col("normalized_key").alias("key"), F.round("confidence", 6).alias("confidence"), F.col("support_count").cast("long").alias("support"))


#: What an event is by its hour and day: an observation with a candidate, with the rule applied too, only
#: the rule applied, or what the user does with the rule.
ROLE = "CASE hour(ts) % 8 WHEN 0 THEN 'disable' WHEN 1 THEN 'enable' WHEN 2 THEN CASE WHEN day(ts) % 4 = 0 THEN 'delete' ELSE 'apply' END WHEN 3 THEN 'apply' WHEN 4 THEN 'both' ELSE 'observe' END"
LOW = "round((value - floor(value)) * 0.3, 2)"


def _controlled(spark, sf):
    """Feedback with like keys and applied rules, and events with which users disable, enable and delete rules.

    All events of a user and kind are about the rule that the first observation made; once that is
    pruned or deleted, a later observation makes a new one, which the events do not mean.
    """
    e = parquet(spark, sf, "events").withColumns({"role": F.expr(ROLE), "feedback_id": F.lpad(F.col("event_id").cast("string"), 12, "0"), "user": F.col("user_id").cast("string"), "submitted_at": F.col("ts").cast("timestamp")})
    seen = F.col("role").isin("observe", "both")
    born = e.where(seen).groupBy("user", "event_type").agg(F.min_by("feedback_id", F.struct("ts", "feedback_id")).alias("first"))
    e = e.join(born, ["user", "event_type"], "left").withColumn("rule", F.sha2(F.concat_ws(":", "user", "first", F.lit("0")), 256).substr(1, 32))
    described = F.concat(F.lit("Rule "), "event_type", F.when(F.dayofmonth("ts") % 2 == 1, " now").otherwise(""))
    none = F.array().cast("array<string>")
    made = F.array(_candidate(described, LOW))
    feedback = e.where(seen | (F.col("role") == "apply")).select(
        F.col("user").alias("user_id"), "feedback_id", F.lit("internal_memo").alias("draft_type"), "submitted_at",
        F.when(seen, made).otherwise(F.array().cast(f"array<{CANDIDATE}>")).alias("candidates"), F.when(F.col("role").isin("apply", "both"), F.array("rule")).otherwise(none).alias("applied_rule_ids"),
    )
    controls = e.where(F.col("role").isin("disable", "enable", "delete")).select(F.col("user").alias("user_id"), F.col("rule").alias("rule_id"), F.col("role").alias("action"), "submitted_at", F.col("feedback_id").alias("event_id"))
    return feedback, controls


def _with_status(rules):
    return rules.select("user_id", F.col("normalized_key").alias("key"), F.round("confidence", 6).alias("confidence"), F.col("support_count").cast("long").alias("support"), F.col("decay_count").cast("long").alias("decays"), "status")


def rule_fold_controls(spark, sf):
    """The whole fold with like keys, applied rules, and rules that users disable, enable and delete."""
    return _with_status(L.fold_batch(L.with_controls(*_controlled(spark, sf))))


def _middle(spark, sf):
    """The time in the middle of the events."""
    first, last = parquet(spark, sf, "events").agg(F.min("ts"), F.max("ts")).first()
    return first + (last - first) / 2 if first is not None else None


def rules_incremental(spark, sf):
    """The same fold from saved rules, of jobs and events that came in two batches; of every tenth user all
    came with the second, and of every tenth other one day of the first, which is folded anew therefore."""
    store, (feedback, controls) = Store(spark, _shared(spark, "rulebook")), _controlled(spark, sf)
    drop_folder(spark, store.folder, now=False)
    user, book = F.col("user_id").cast("long"), RuleBook(store)
    second = (F.col("submitted_at") >= F.lit(_middle(spark, sf))) | (user % 10 == 0) | ((user % 10 == 1) & (F.dayofmonth("submitted_at") == 3))
    done = feedback.select("*", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("error_message"), F.current_timestamp().alias("at"))
    for name, part in (("first", ~second), ("second", second)):
        store.replace(f"jobs/batch={name}/state=done", done.where(part))
        store.replace(f"rule_controls/batch={name}", controls.where(part))
        book.refresh()
    return _with_status(book.rules())


#: For rules whose confidence is to differ after all observations: a low start and small steps.
SLOW = replace(DEFAULT, reinforce=0.02)


def _rules(spark, sf):
    """Rules after all observations of each, from a low start in small steps."""
    r = L.fold_exact(_observations(spark, sf).withColumn("confidence", F.round(F.col("confidence") * 0.4, 3)), SLOW)
    return r.select(
        F.concat_ws(":", "user_id", "key").alias("rule_id"), "user_id", F.concat(F.lit("Prefer "), "key").alias("description"), F.expr(CATEGORY.replace("event_type", "key")).alias("category"),
        F.when(F.col("key") == "click", F.array(F.lit("internal_memo"))).when(F.col("key") == "view", F.array(F.lit("case_fact_summary"))).otherwise(F.array().cast("array<string>")).alias("applicable_draft_types"),
        "confidence", F.col("support").alias("support_count"), F.lit(0).alias("decay_count"), F.when(F.col("user_id") % 7 == 0, "disabled").otherwise("active").alias("status"), F.row_number().over(Window.partitionBy("user_id").orderBy("key")).cast("long").alias("insert_seq"),
    )


def rule_decay_prune(spark, sf):
    """Rules after three feedbacks of which none, one or all reinforced them."""
    rows = _rules(spark, sf).withColumn("confidence", F.round(F.col("confidence") / 3, 6))
    for k in range(3):
        if k:
            rows = rows.where("not pruned").drop("pruned")
        rows = L.decay_rules(rows.withColumn("reinforced", F.length("rule_id") % 3 == k).withColumn("decay_count", F.col("decay_count"))).drop("reinforced")
    return rows.select("rule_id", "confidence", F.col("support_count").cast("long").alias("support_count"), F.col("decay_count").cast("long").alias("decay_count"), "pruned")


def active_rules(spark, sf):
    return L.active_rules(_rules(spark, sf), "internal_memo").select("user_id", "rule_id", "confidence", F.col("rank").cast("long").alias("rank"))


def list_rules(spark, sf):
    return L.list_rules(_rules(spark, sf), "case_fact_summary").select("user_id", "rule_id", "status", F.col("rank").cast("long").alias("rank"))


def rules_prompt(spark, sf):
    return L.rules_prompt(L.active_rules(_rules(spark, sf), "internal_memo"), parquet(spark, sf, "events").select("user_id"))


def rule_public(spark, sf):
    """Rules as users see them."""
    rules = L.public(_rules(spark, sf))
    return rules.select(*[F.array_join(c, ",").alias(c) if c == "applicable_draft_types" else F.col(c) for c in rules.columns])


def session_rules(spark, sf):
    """For each session (customer), how many rules of its user are in force, and the first of them."""
    sessions = parquet(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"), (F.col("c_custkey") % 211).alias("user_id"))
    own = sessions.join(L.active_rules(_rules(spark, sf), "internal_memo"), "user_id", "left")
    return own.groupBy("session_id").agg(F.count("rule_id").alias("n_rules"), F.coalesce(F.min_by("rule_id", "rank"), F.lit("")).alias("first_rule"))


def draft_types_union(spark, sf):
    """The draft types of all rules of a user."""
    return L.union_of_types(_rules(spark, sf), ("user_id",)).select("user_id", F.array_join("applicable_draft_types", ",").alias("types"))


def latest_rows(spark, sf):
    """The last event of each user, unless it deletes the row."""
    log = parquet(spark, sf, "events").select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("gone"))
    return latest(log, "user_id", "event_id", "gone")


def draft_feedback_join(spark, sf):
    """Feedback (user turns) with its draft (the conversation's first assistant turn), or failed."""
    c = parquet(spark, sf, "conversations")
    drafts = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("draft_turn")).where("conv_id % 4 <> 0").select(F.col("conv_id").alias("draft_id"), "draft_turn")
    jobs = c.where("role = 'user'").select(F.col("conv_id").alias("draft_id"), "turn")
    out = S.job_states(jobs, drafts).groupBy("draft_id", "status").agg(F.count("*").alias("n"), F.max("error_message").alias("error"))
    return out.withColumn("error", F.coalesce("error", F.lit("")))


def applied_vs_reinforced(spark, sf):
    """Kinds that a user's events of even days applied, split by whether those of odd days name them again."""
    e = parquet(spark, sf, "events")
    applied = e.where("day(ts) % 2 = 0").select("user_id", "event_type").distinct()
    again = e.where("day(ts) % 2 = 1").select("user_id", "event_type").distinct()
    semi = applied.join(again, ["user_id", "event_type"], "left_semi").withColumn("reinforced", F.lit(True))
    anti = applied.join(again, ["user_id", "event_type"], "left_anti").withColumn("reinforced", F.lit(False))
    return semi.unionByName(anti)


def feedback_rules(spark, sf):
    """Rules in the order in which a feedback lists their ids; those that are not in force drop out."""
    rules = _rules(spark, sf).where("status = 'active'").select("rule_id", "confidence")
    users = parquet(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", "user_id", "event_type")), lambda a, b: F.when(a < b, 1).when(a > b, -1).otherwise(0)).alias("ids"))
    return in_order_of(users, rules, "ids", "rule_id").select("user_id", F.col("pos").cast("long").alias("pos"), "rule_id", "confidence")


def _stream(spark, sf, table):
    """A parquet table of the folder as a file stream, whether it is a file or a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf}/{table}.parquet")
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(parquet(spark, sf, table).schema)
    return reader.parquet(f"{sf}/{table}.parquet") if folder else reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf)


def _shared(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stream_rule_fold(spark, sf):
    """The same fold over a file stream of the events, with state for each user."""
    at = _shared(spark, "rules")

    def keep(rows, batch):
        rows.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{at}/out")

    folded = S.fold_stream(_feedback(_stream(spark, sf, "events")))
    folded.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    last = spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.max_by("rules", "batch").alias("rules"))
    return S.rules_of(last).select("user_id", F.col("normalized_key").alias("key"), F.round("confidence", 6).alias("confidence"), F.col("support_count").cast("long").alias("support"))


def stream_rule_map(spark, sf):
    """The same fold with an entry of state for each rule, by a query that stops in the middle of the events
    and goes on from its checkpoint."""
    at = _shared(spark, "entries")
    drop_folder(spark, at, now=False)
    events, middle = parquet(spark, sf, "events"), _middle(spark, sf)
    before = spark.conf.get(S.ROCKSDB[0], None)
    spark.conf.set(*S.ROCKSDB)

    def keep(rows, batch):
        rows.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    try:
        for part in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle)):
            events.where(part).write.mode("append").parquet(f"{at}/events")
            folded = S.fold_entries(_feedback(spark.readStream.schema(events.schema).parquet(f"{at}/events")))
            folded.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(S.ROCKSDB[0])
        else:
            spark.conf.set(S.ROCKSDB[0], before)
    last = spark.read.schema("user_id string, rule_id string, rule string, batch long").parquet(f"{at}/out").groupBy("user_id", "rule_id").agg(F.max_by("rule", "batch").alias("rule"))
    rules = last.where("rule is not null").select(F.concat(F.lit("["), "rule", F.lit("]")).alias("rules"))
    return S.rules_of(rules).select("user_id", F.col("normalized_key").alias("key"), F.round("confidence", 6).alias("confidence"), F.col("support_count").cast("long").alias("support"))


def stream_feedback_jobs(spark, sf):
    """User turns as feedback on the conversation's draft, taken up by a stream: by draft, jobs of each
    status and what was read from them. Edits of every third turn add a block."""
    store = Store(spark, _shared(spark, "jobs"))
    drop_folder(spark, store.folder, now=False)
    turns = _stream(spark, sf, "conversations").where("role = 'user'")
    edited = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("\n\nAlways cite the page."))).otherwise(F.col("text"))
    feedback = turns.select(F.concat_ws(":", "conv_id", "turn").alias("feedback_id"), F.col("conv_id").cast("string").alias("draft_id"), F.lit("u").alias("user_id"), F.lit("internal_memo").alias("draft_type"), F.lit(None).cast("timestamp").alias("submitted_at"), F.col("text").alias("original_draft"), edited.alias("edited_draft"))
    first = parquet(spark, sf, "conversations").where("role = 'assistant' and conv_id % 4 <> 0").select(F.col("conv_id").cast("string").alias("draft_id")).distinct()
    jobs = FeedbackJobs(store, RuleExtractor().extract, lambda: first.withColumn("applied_rule_ids", F.array().cast("array<string>")))
    for _ in range(2):  # the second finds all taken up
        jobs.start(feedback, f"{store.folder}/checkpoint").awaitTermination()
    done = store.load("jobs", f"{JOBS}, batch string, state string").where("state = 'done'")
    out = done.groupBy(F.split_part("feedback_id", F.lit(":"), F.lit(1)).cast("long").alias("draft_id"), "status")
    return out.agg(F.count("*").alias("n"), F.coalesce(F.max("error_message"), F.lit("")).alias("error"), F.coalesce(F.sum(F.size("candidates")), F.lit(0)).cast("long").alias("candidates"))


def stream_ingest(spark, sf):
    """Documents ingested from a file stream into both indexes; a batch that is done again takes its own place."""
    at = _shared(spark, "ingest")
    drop_folder(spark, at, now=False)
    index, embedder = PostingIndex(spark, f"{at}/postings", id_type="bigint"), Embedder()

    def write(rows, batch):
        rows = settled(rows.select("doc_id", "text").repartition(spark.sparkContext.defaultParallelism), "batch")  # a batch may be one file
        index.append(rows, f"batch-{batch}")
        rows.select("doc_id", embedder.embed(F.col("text")).alias("vector")).write.mode("overwrite").parquet(f"{at}/vectors/batch={batch}")

    S.ingest_stream(_stream(spark, sf, "documents"), write, f"{at}/checkpoint").awaitTermination()
    terms = index.blocks().select(F.explode("postings").alias("p")).groupBy(F.col("p.id").alias("doc_id")).agg(F.count("*").alias("n_terms"), F.sum("p.tf").alias("n_tokens"))
    vectors = spark.read.schema("doc_id bigint, vector array<float>, batch long").parquet(f"{at}/vectors").groupBy("doc_id").agg(F.count("*").alias("n_vectors"), F.sum(F.size("vector")).alias("n_slots"))
    return terms.join(vectors, "doc_id")


QUERIES = {f.__name__: f for f in (rule_key, rule_jaccard, rule_sequence_ratio, structured_diff, rule_match_best, rule_fold_exact, rule_fold, rule_fold_controls, rules_incremental, rule_decay_prune, active_rules, list_rules, rules_prompt, rule_public, session_rules, draft_types_union, latest_rows, draft_feedback_join, applied_vs_reinforced, feedback_rules, stream_rule_fold, stream_rule_map, stream_feedback_jobs, stream_ingest)}

_D_KEY = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _d_fold(c: str = CONFIDENCE, step: float = 0.1) -> str:
    return f"""fold_l AS (SELECT user_id, event_type AS key, list_value(list(c ORDER BY event_id))[1] AS l FROM (SELECT *, {c} AS c FROM events) GROUP BY ALL),
        fold AS (SELECT user_id, key, round(list_reduce(l, lambda a, x: least(1.0, greatest(a, x) + {step})), 6) AS confidence, len(l) AS support FROM fold_l)"""


_D_RULES = f"""{_d_fold(f'round({CONFIDENCE} * 0.4, 3)', 0.02)}, rules AS (SELECT user_id || ':' || key AS rule_id, user_id, 'Prefer ' || key AS description, {CATEGORY.replace('event_type', 'key')} AS category, CASE WHEN key = 'click' THEN ['internal_memo'] WHEN key = 'view' THEN ['case_fact_summary'] ELSE [] END AS types,
        confidence, support, CASE WHEN user_id % 7 = 0 THEN 'disabled' ELSE 'active' END AS status FROM fold)"""
_D_ACTIVE = f"""{_D_RULES}, act AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, support DESC, description) AS rank FROM rules WHERE status = 'active' AND confidence >= 0.5 AND (len(types) = 0 OR list_contains(types, 'internal_memo')))"""
_D_WHOLE = f"WITH {_d_fold()} SELECT CAST(user_id AS VARCHAR) AS user_id, 'rule ' || key AS key, confidence, support FROM fold"


def _d_decay() -> str:
    steps = ["d0 AS (SELECT rule_id, round(confidence / 3, 6) AS c, support AS s, 0 AS d, false AS pruned FROM rules)"]
    for k in range(3):
        steps.append(f"d{k + 1} AS (SELECT rule_id, nc AS c, ns AS s, nd AS d, nc < 0.2 AND nd >= 2 AS pruned FROM (SELECT rule_id, round(CASE WHEN up THEN least(1.0, c + 0.1) ELSE greatest(0.0, c - 0.05) END, 6) AS nc, s + CASE WHEN up THEN 1 ELSE 0 END AS ns, CASE WHEN up THEN greatest(0, d - 1) ELSE d + 1 END AS nd FROM (SELECT *, length(rule_id) % 3 = {k} AS up FROM d{k} WHERE NOT pruned)))")
    return f"WITH {_D_RULES}, {', '.join(steps)} SELECT rule_id, c AS confidence, CAST(s AS BIGINT) AS support_count, CAST(d AS BIGINT) AS decay_count, pruned FROM d3"


_D_CONTROLS = f"""
    WITH RECURSIVE e AS (
        SELECT user_id, event_type, {ROLE} AS role, {LOW} AS c, 'rule ' || event_type || CASE WHEN day(ts) % 2 = 1 THEN ' now' ELSE '' END AS name,
               row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, {ROLE} IN ('disable', 'enable', 'delete'), event_id) AS n FROM events),
    r AS (
        SELECT DISTINCT user_id, event_type, CAST(0 AS BIGINT) AS n, false AS ever, false AS there, false AS meant, CAST(0 AS DOUBLE) AS conf, CAST(0 AS BIGINT) AS sup, CAST(0 AS BIGINT) AS decays, 'active' AS status, '' AS key FROM e
        UNION ALL
        SELECT user_id, event_type, n, ever, there AND NOT (hit AND conf < 0.2 AND decays >= 2) AND NOT (named AND role = 'delete'), meant, conf, sup, decays,
               CASE WHEN named AND role = 'disable' THEN 'disabled' WHEN named AND role = 'enable' THEN 'active' ELSE status END, key
        FROM (SELECT * REPLACE (CASE WHEN hit THEN CASE WHEN seen THEN least(1.0, conf + 0.1) ELSE greatest(0.0, conf - 0.05) END ELSE conf END AS conf,
                                CASE WHEN hit AND seen THEN sup + 1 ELSE sup END AS sup, CASE WHEN hit THEN CASE WHEN seen THEN greatest(0, decays - 1) ELSE decays + 1 END ELSE decays END AS decays)
              FROM (SELECT *, there AND meant AS named, there AND meant AND status = 'active' AND role IN ('apply', 'both') AS hit
                    FROM (SELECT r.user_id, r.event_type, e.n, role, seen, ever OR seen AS ever, there OR seen AS there, CASE WHEN seen AND NOT there THEN NOT ever ELSE meant END AS meant,
                                 CASE WHEN seen AND there THEN least(1.0, greatest(conf, c) + 0.1) WHEN seen THEN c ELSE conf END AS conf, CASE WHEN seen AND there THEN sup + 1 WHEN seen THEN 1 ELSE sup END AS sup,
                                 CASE WHEN seen AND NOT there THEN 0 ELSE decays END AS decays, CASE WHEN seen AND NOT there THEN 'active' ELSE status END AS status, CASE WHEN seen THEN name ELSE key END AS key
                          FROM r JOIN (SELECT *, role IN ('observe', 'both') AS seen FROM e) e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1))))
    SELECT CAST(user_id AS VARCHAR) AS user_id, key, round(conf, 6) AS confidence, sup AS support, decays, status
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY n DESC) AS last FROM r) WHERE last = 1 AND there"""

ORACLE = {
    "rule_fold_controls": _D_CONTROLS,
    "rule_public": f"WITH {_D_RULES} SELECT rule_id, description, category, array_to_string(types, ',') AS applicable_draft_types, confidence, support AS support_count, status FROM rules",
    "session_rules": f"WITH {_D_ACTIVE} SELECT c_custkey AS session_id, count(rule_id) AS n_rules, coalesce(arg_min(rule_id, rank), '') AS first_rule FROM customer LEFT JOIN act ON user_id = c_custkey % 211 GROUP BY c_custkey",
    "draft_types_union": f"WITH {_D_RULES} SELECT user_id, array_to_string(list_sort(list_distinct(flatten(list(types)))), ',') AS types FROM rules GROUP BY user_id",
    "latest_rows": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'",
    "rule_key": f"SELECT p_partkey, {_D_KEY.format(x='''('  Use: ' || p_name || '--' || p_brand || '! é ÄB ' || p_type)''')} AS key FROM part",
    "rule_jaccard": f"""WITH k AS (SELECT p_partkey, p_brand, list_distinct(string_split({_D_KEY.format(x="p_name || ' ' || p_type")}, ' ')) AS w FROM part),
        p AS (SELECT p_partkey, w, lead(w) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS o FROM k)
        SELECT p_partkey, round(len(list_intersect(w, o)) / len(list_distinct(list_concat(w, o))), 6) AS overlap FROM p WHERE o IS NOT NULL""",
    "rule_fold_exact": f"WITH {_d_fold()} SELECT user_id, key, confidence, support FROM fold",
    "rule_fold": _D_WHOLE,
    "stream_rule_fold": _D_WHOLE,
    "stream_rule_map": _D_WHOLE,
    "rules_incremental": _D_CONTROLS,
    "stream_feedback_jobs": f"""WITH d AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant' AND conv_id % 4 <> 0)
        SELECT c.conv_id AS draft_id, CASE WHEN d.conv_id IS NULL THEN 'failed' ELSE 'completed' END AS status, count(*) AS n, CASE WHEN d.conv_id IS NULL THEN '{NO_DRAFT}' ELSE '' END AS error,
               CAST(sum(CASE WHEN d.conv_id IS NOT NULL AND (c.conv_id + turn) % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS candidates
        FROM conversations c LEFT JOIN d ON d.conv_id = c.conv_id WHERE role = 'user' GROUP BY ALL""",
    "rule_decay_prune": _d_decay(),
    "active_rules": f"WITH {_D_ACTIVE} SELECT user_id, rule_id, confidence, rank FROM act",
    "list_rules": f"WITH {_D_RULES} SELECT user_id, rule_id, status, row_number() OVER (PARTITION BY user_id ORDER BY status <> 'active', confidence DESC, support DESC, key) AS rank FROM (SELECT *, split_part(rule_id, ':', 2) AS key FROM rules) WHERE len(types) = 0 OR list_contains(types, 'case_fact_summary')",
    "rules_prompt": f"WITH {_D_ACTIVE}, t AS (SELECT user_id, string_agg(rank || '. [' || category || '] ' || description, chr(10) ORDER BY rank) AS p FROM act GROUP BY user_id) SELECT user_id, coalesce(p, 'None') AS prompt FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN t USING (user_id)",
    "draft_feedback_join": """WITH d AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'assistant' AND conv_id % 4 <> 0)
        SELECT c.conv_id AS draft_id, CASE WHEN d.conv_id IS NULL THEN 'failed' ELSE 'completed' END AS status, count(*) AS n, CASE WHEN d.conv_id IS NULL THEN 'Draft not found' ELSE '' END AS error FROM conversations c LEFT JOIN d ON d.conv_id = c.conv_id WHERE role = 'user' GROUP BY ALL""",
    "applied_vs_reinforced": "SELECT user_id, event_type, EXISTS (SELECT 1 FROM events b WHERE day(b.ts) % 2 = 1 AND b.user_id = a.user_id AND b.event_type = a.event_type) AS reinforced FROM (SELECT DISTINCT user_id, event_type FROM events WHERE day(ts) % 2 = 0) a",
    "feedback_rules": f"""WITH {_D_RULES}, e AS (SELECT DISTINCT user_id, user_id || ':' || event_type AS rule_id FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rule_id DESC) - 1 AS pos FROM e)
        SELECT n.user_id, pos, rule_id, confidence FROM n JOIN (SELECT rule_id, confidence FROM rules WHERE status = 'active') USING (rule_id)""",
    "stream_ingest": "WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS w FROM documents) SELECT doc_id, count(DISTINCT w) AS n_terms, count(*) AS n_tokens, CAST(1 AS BIGINT) AS n_vectors, CAST(64 AS BIGINT) AS n_slots FROM t GROUP BY doc_id",
}
