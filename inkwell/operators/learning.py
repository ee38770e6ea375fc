"""Style rules learned from feedback: one pure fold, used in batches and in streams, and rule views."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.config import DEFAULT, Config
from inkwell.functions.rules import ratio, sequence_ratio, token_overlap
from inkwell.schemas import RULES
from inkwell.sources.readers import settled


def normal_key(description: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", description.lower()).strip()


def overlap(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return len(x & y) / len(x | y) if x and y else 0.0


def best_match(rules: list[dict], category: str, key: str, config: Config = DEFAULT) -> dict | None:
    """The user's rule of that category most like the key; an equal key at once, ties to the earlier."""
    rules = [r for r in rules if r["category"] == category]
    equal = next((r for r in rules if r["normalized_key"] == key), None)
    if equal is not None:
        return equal
    best, best_score = None, 0.0
    for rule in rules:
        own = rule["normalized_key"]
        shared = overlap(own, key)
        score = max(ratio(own, key), shared, config.match_contained if key in own or own in key else 0.0)
        if score > best_score and (score >= config.match_score or shared >= config.match_overlap):
            best, best_score = rule, score
    return best


def fold_feedback(rules: list[dict], feedback: dict, config: Config = DEFAULT) -> list[dict]:
    """A user's rules after one feedback: merge its candidates in order, then reinforce or decay the
    rules its draft had applied, and prune. ``rules`` is changed and returned."""
    reinforced = set()
    for n, c in enumerate(feedback.get("candidates") or ()):
        key = normal_key(c["description"])
        if not key:
            continue
        types = list(c.get("applicable_draft_types") or [feedback["draft_type"]])
        old = best_match(rules, c["category"], key, config)
        if old:
            old |= {"description": c["description"], "normalized_key": key, "confidence": min(1.0, max(old["confidence"], c["confidence"]) + config.reinforce), "support_count": old["support_count"] + 1, "last_updated": feedback["submitted_at"]}
            old["example_before"] = c.get("example_before") or old["example_before"]
            old["example_after"] = c.get("example_after") or old["example_after"]
            old["applicable_draft_types"] = sorted({*old["applicable_draft_types"], *types})
        else:
            seq = max((r["insert_seq"] for r in rules), default=-1) + 1
            rule_id = hashlib.sha256(f"{feedback['user_id']}:{feedback['feedback_id']}:{n}".encode()).hexdigest()[:32]
            old = {"rule_id": rule_id, "user_id": feedback["user_id"], "description": c["description"], "category": c["category"], "example_before": c.get("example_before"), "example_after": c.get("example_after"), "applicable_draft_types": types, "confidence": c["confidence"], "support_count": 1, "decay_count": 0, "normalized_key": key, "status": "active", "last_updated": feedback["submitted_at"], "insert_seq": seq}
            rules.append(old)
        reinforced.add(old["rule_id"])
    for rule_id in feedback.get("applied_rule_ids") or ():
        rule = next((r for r in rules if r["rule_id"] == rule_id), None)
        if rule is None or rule["status"] != "active":
            continue
        if rule_id in reinforced:
            rule |= {"confidence": min(1.0, rule["confidence"] + config.reinforce), "support_count": rule["support_count"] + 1, "decay_count": max(0, rule["decay_count"] - 1)}
        else:
            rule |= {"confidence": max(0.0, rule["confidence"] - config.decay), "decay_count": rule["decay_count"] + 1}
        rule["last_updated"] = feedback["submitted_at"]
        if rule["confidence"] < config.prune_confidence and rule["decay_count"] >= config.prune_decays:
            rules.remove(rule)
    return rules


def control(rules: list[dict], event: dict) -> list[dict]:
    """Enable, disable or delete one rule of the user."""
    rule = next((r for r in rules if r["rule_id"] == event["rule_id"]), None)
    if rule is None:
        return rules
    if event["action"] == "delete":
        rules.remove(rule)
    else:
        rule |= {"status": "active" if event["action"] == "enable" else "disabled", "last_updated": event["submitted_at"]}
    return rules


def as_frame(rules: list[dict]) -> pd.DataFrame:
    names = [x.split()[0] for x in RULES.replace("array<string>", "array").split(", ")]
    return pd.DataFrame(rules, columns=names)


def in_time(frame: pd.DataFrame) -> list[dict]:
    """Feedback and events by time; what users set comes after feedback of the same time, ties go by id."""
    last = lambda x: (True, 0) if pd.isna(x) else (False, x)
    return sorted(records(frame), key=lambda r: (last(r["submitted_at"]), not pd.isna(r.get("action")), last(r["feedback_id"])))


def records(frame: pd.DataFrame) -> list[dict]:
    """A dict for each row."""
    return [dict(zip(frame.columns, row, strict=True)) for row in zip(*(frame[c].tolist() for c in frame.columns), strict=True)]


def with_controls(feedback: DataFrame, controls: DataFrame) -> DataFrame:
    """Feedback and control events (user_id, rule_id, action, submitted_at, event_id) as one table for the
    fold: an event has an action, enable, disable or delete, instead of candidates."""
    events = controls.select("user_id", F.col("event_id").alias("feedback_id"), "submitted_at", "action", "rule_id")
    return feedback.unionByName(events, allowMissingColumns=True)


def fold_batch(feedback: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rules of all users after all feedback, a group each user, in order of time and id.

    ``feedback`` has user_id, feedback_id, draft_type, submitted_at, candidates, applied_rule_ids, and
    where ``with_controls`` added them, action and rule_id. The fold is sequential by its meaning; users
    are independent, so they run in parallel. A user's feedback is sorted by Spark and passes a task in
    batches, which holds the user's rules only, however much feedback there is.
    """

    return _folded(feedback, config)


_STATE = f"struct<{', '.join(':'.join(c.split(' ', 1)) for c in RULES.split(', '))}>"


def _folded(feedback: DataFrame, config: Config) -> DataFrame:
    """Rules after feedback; rows that have a ``rule`` come first and are the rules to begin with."""

    def run(frames):
        user, rules = object(), []
        for frame in frames:
            done: list[dict] = []
            for row in records(frame):
                if row["user_id"] != user:
                    done += rules
                    user, rules = row["user_id"], []
                if row.get("rule") is not None:
                    rules.append({**row["rule"], "applicable_draft_types": list(row["rule"]["applicable_draft_types"])})
                else:
                    fold_row(rules, row, config)
            yield as_frame(done)
        yield as_frame(rules)

    begin = [F.col("rule").isNull(), F.col("rule.insert_seq")] if "rule" in feedback.columns else []
    late = F.col("action").isNotNull() if "action" in feedback.columns else F.lit(False)
    rows = feedback.repartition("user_id").sortWithinPartitions("user_id", *begin, "submitted_at", late, "feedback_id")
    return rows.mapInPandas(run, RULES)


def fold_onward(rules: DataFrame, later: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rules after more feedback than they were folded from; ``later`` is all of it, in time after what is
    in ``rules``. Users without later feedback keep their rules."""
    names = [c.split()[0] for c in RULES.split(", ")]
    begin = rules.select("user_id", F.struct(*names).cast(_STATE).alias("rule"))
    return _folded(later.unionByName(begin, allowMissingColumns=True), config)


def positions(feedback: DataFrame) -> DataFrame:
    """How far in time each user's feedback goes: (user_id, upto), where upto is a time, whether it is that
    of a control event, and an id."""
    late = F.col("action").isNotNull() if "action" in feedback.columns else F.lit(False)
    return feedback.groupBy("user_id").agg(F.max(F.struct("submitted_at", late.alias("late"), "feedback_id")).alias("upto"))


def fold_increment(rules: DataFrame, upto: DataFrame, new: DataFrame, every: Callable[[], DataFrame], config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Rules and positions after ``new`` feedback, from those before it. Equal to a fold of everything.

    Only new feedback is read, and the rules of the users it is of go on from where they are. A user of
    whom some new feedback is older than what is folded already is folded from the start: only if there
    is one, ``every`` is called for all feedback, the new one included. ``new`` and the tables before it
    are read more than once; pass written ones.
    """
    added = positions(new)
    when = F.struct("submitted_at", (F.col("action").isNotNull() if "action" in new.columns else F.lit(False)).alias("late"), "feedback_id")
    back = new.join(upto, "user_id").where(when < F.col("upto")).select("user_id").distinct()
    back = settled(back, "back")
    onward = new.join(back, "user_id", "left_anti")
    kept = rules.join(back, "user_id", "left_anti")
    out = fold_onward(kept, onward, config)
    if not back.isEmpty():
        out = out.unionByName(_folded(every().join(back, "user_id", "left_semi"), config))
    upto = upto.unionByName(added).groupBy("user_id").agg(F.max("upto").alias("upto"))
    return out, upto


def fold_row(rules: list[dict], row: dict, config: Config = DEFAULT) -> None:
    """One feedback or event into a user's rules."""
    if row.get("action"):
        control(rules, row)
        return
    for name in ("candidates", "applied_rule_ids"):
        row[name] = [] if row.get(name) is None else list(row[name])
    for c in row["candidates"]:
        c["applicable_draft_types"] = [] if c.get("applicable_draft_types") is None else list(c["applicable_draft_types"])
    fold_feedback(rules, row, config)


def fold_exact(observations: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The confidence recurrence where only equal keys match: user_id, key, confidence, support.

    ``observations`` has user_id, key, seq, confidence (0 to 1). Each one adds ``reinforce`` and nothing
    takes it away, so once 1 / reinforce of them have passed the bound of 1 is reached: only that many of
    the last ones are gathered for a key, whatever it has, and the others are counted.
    """
    last = math.ceil(1 / config.reinforce) + 1
    recent = observations.withColumn("_n", F.row_number().over(Window.partitionBy("user_id", "key").orderBy(F.desc("seq")))).where(F.col("_n") <= last)
    recent = recent.groupBy("user_id", "key").agg(F.array_sort(F.collect_list(F.struct("seq", "confidence"))).alias("s"))
    counts = observations.groupBy("user_id", "key").agg(F.count("*").alias("support"))
    later = F.slice("s", 2, F.greatest(F.size("s"), F.lit(1)))
    value = F.aggregate(later, F.element_at("s", 1)["confidence"], lambda a, x: F.least(F.lit(1.0), F.greatest(a, x["confidence"]) + config.reinforce))
    return recent.join(counts, ["user_id", "key"]).select("user_id", "key", F.round(value, 6).alias("confidence"), "support")


def decay_rules(applied: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Applied rules after one feedback, joined with whether it reinforced them: confidence, support,
    decays and whether the rule is pruned."""
    up = F.col("reinforced")
    conf = F.when(up, F.least(F.lit(1.0), F.col("confidence") + config.reinforce)).otherwise(F.greatest(F.lit(0.0), F.col("confidence") - config.decay))
    count = F.when(up, F.greatest(F.lit(0), F.col("decay_count") - 1)).otherwise(F.col("decay_count") + 1)
    out = applied.withColumns({"support_count": F.col("support_count") + up.cast("int"), "_c": F.round(conf, 6), "_d": count})
    return out.withColumns({"confidence": F.col("_c"), "decay_count": F.col("_d"), "pruned": (F.col("_c") < config.prune_confidence) & (F.col("_d") >= config.prune_decays)}).drop("_c", "_d")


def suits(draft_type: str | Column) -> Column:
    kind = F.lit(draft_type) if isinstance(draft_type, str) else draft_type
    types = F.col("applicable_draft_types")
    return types.isNull() | (F.size(types) == 0) | F.array_contains(types, kind)


def active_rules(rules: DataFrame, draft_type: str, config: Config = DEFAULT) -> DataFrame:
    """Rules in force for a draft type, ranked within their user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("confidence"), F.desc("support_count"), "description", "insert_seq")
    kept = rules.where((F.col("status") == "active") & (F.col("confidence") >= config.rule_confidence) & suits(draft_type))
    return kept.withColumn("rank", F.row_number().over(w))


def list_rules(rules: DataFrame, draft_type: str | None = None, include_disabled: bool = True) -> DataFrame:
    """Rules of each user: active first, then by confidence, support and age."""
    kept = rules if include_disabled else rules.where("status = 'active'")
    kept = kept if draft_type is None else kept.where(suits(draft_type))
    w = Window.partitionBy("user_id").orderBy((F.col("status") != "active").cast("int"), F.desc("confidence"), F.desc("support_count"), "insert_seq")
    return kept.withColumn("rank", F.row_number().over(w))


def public(rules: DataFrame) -> DataFrame:
    return rules.drop("user_id", "decay_count", "normalized_key", "insert_seq")


def union_of_types(rules: DataFrame, by: tuple[str, ...], types_col: str = "applicable_draft_types") -> DataFrame:
    """All draft types that rows of a key suit, each once and sorted: a closed set, so a row stays small."""
    each = rules.select(*by, F.explode_outer(types_col).alias("_t"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_set("_t")).alias(types_col))


def rules_prompt(ranked: DataFrame, users: DataFrame) -> DataFrame:
    """A numbered text of each user's rules; ``None`` for users without any."""
    line = F.struct("rank", F.format_string("%d. [%s] %s", "rank", "category", "description").alias("line"))
    text = ranked.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("prompt"))
    return users.select("user_id").distinct().join(text, "user_id", "left").withColumn("prompt", F.coalesce("prompt", F.lit("None")))


#: Letters of keys, the frequent ones first; the order of pairs of letters may be any, this begins with rare ones.
_LETTERS = " etaoinsrhldcumfpgwybvkxjqz0123456789"


def _pieces(key: str) -> tuple[Column, Column]:
    """Words and pairs of letters of a key, each once, in orders that are the same for all keys: long words
    and rare pairs first."""
    ranked = lambda texts, rank: F.transform(F.array_sort(F.transform(F.array_distinct(texts), lambda g: F.struct(rank(g).alias("r"), g.alias("g")))), lambda x: x["g"])
    place = lambda g, n: F.position(F.substr(g, F.lit(n), F.lit(1)), F.lit(_LETTERS))
    pairs = F.when(F.length(key) > 1, F.transform(F.sequence(F.lit(1), F.length(key) - 1), lambda i: F.substr(F.col(key), i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return ranked(F.array_remove(F.split(key, " "), ""), lambda w: -F.length(w)), ranked(pairs, lambda g: -place(g, 1) - place(g, 2))


def _signed(rows: DataFrame, key: str, side: int, config: Config) -> DataFrame:
    """Keys with ``signs``, hashes of which like keys of the two sides have one in common, but for contained
    keys of two words or less, and ``short``, whether it is such a key; see ``best_matches``."""
    low, high = config.match_score / (2 - config.match_score), (2 - config.match_score) / config.match_score  # of the other key's length
    lost = max((2 - 1.5 * config.match_score) + (1 - 1.5 * config.match_score) * other for other in (low, high))
    rows = rows.where(F.length(key) > 0).withColumn("_all", F.split(key, " "))
    rows = rows.withColumns({"_words": _pieces(key)[0], "_pairs": _pieces(key)[1]})
    some = F.size("_words") - F.ceil(F.size("_words") * config.match_overlap - 1e-9) + 1
    inner = F.transform(F.array_sort(F.transform(F.slice("_all", 2, F.greatest(F.size("_all") - 2, F.lit(0))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    of = lambda kind, texts: F.transform(texts, lambda t: F.xxhash64(F.col("g"), F.lit(kind), t))
    # what one side has of a kind that the other looks for: a key's inner words are words of a key that contains it
    own, theirs = ("inner", "words") if side else ("words", "inner")
    signs = F.concat(of("word", F.slice("_words", 1, F.greatest(some, F.lit(1)).cast("int"))), of("pair", F.slice("_pairs", 1, (F.floor(F.length(key) * lost + 1e-9) + 1).cast("int"))), of(own, F.slice(inner, 1, 1)), of(theirs, F.col("_words")))
    return rows.withColumns({"signs": signs, "short": F.size("_all") < 3})


def _contained(short: DataFrame, key: str, other: DataFrame, whole: str) -> DataFrame:
    """Pairs of a key of one or two words and a key that has its rarest pair of letters, or its only letter. Only
    keys in a group with such a short key are taken apart."""
    groups = short.select("g").distinct()
    probe = short.withColumn("text", F.when(F.length(key) > 1, F.element_at("_pairs", 1)).otherwise(F.col(key)))
    every = F.concat("_pairs", F.array_distinct(F.array_remove(F.split(whole, ""), "")))
    index = other.join(groups, "g", "left_semi").select("g", *[c for c in ("c", "r", "q", "s") if c in other.columns], F.explode(every).alias("text"))
    return probe.select("g", "text", *[c for c in ("c", "r", "q", "s") if c in short.columns]).join(index, ["g", "text"])


def _histogram(key: str) -> Column:
    """How often a key has each letter."""
    return F.transform(F.array(*[F.lit(c) for c in _LETTERS]), lambda c: F.length(key) - F.length(F.replace(F.col(key), c, F.lit(""))))


def best_matches(candidates: DataFrame, rules: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """For candidates (user_id, candidate_id, category, key), the best of the user's rules of the
    category, or none. A candidate that has an insert_seq meets only the rules before it; keys are
    normalised and candidate_id tells candidates apart.

    Equal keys are joined. For the other candidates a rule is a match if it shares enough words, contains
    the key or is contained, or is alike by the ratio of matching blocks, and rules are found by what such
    a pair must share: of two keys with a word overlap of t the first words, in one order for all, but for
    (1 - t) of them; of two with a ratio of r the first pairs of letters, one more than edits can take from
    a key (at most 0.49 of its length for r = 0.86); of a contained key the longest inner word, which is a
    word of the other, or with two words or less the rarest pair of letters. Hashes of these are joined, so
    a user's rules are no group of one task, and the letters that two keys share bound the ratio before it
    is computed.
    """
    group = F.to_json(F.struct("user_id", "category"), {"ignoreNullFields": "false"}).alias("g")
    seq = F.col("insert_seq").cast("long") if "insert_seq" in candidates.columns else F.lit(None).cast("long")
    asked = settled(candidates.select(group, F.col("candidate_id"), F.col("key"), seq.alias("q"), F.monotonically_increasing_id().alias("c")), "candidates")
    known = settled(rules.select(group, F.col("normalized_key").alias("own"), "rule_id", F.col("insert_seq").cast("long").alias("s"), F.monotonically_increasing_id().alias("r")), "rules")
    before = F.col("q").isNull() | (F.col("s") < F.col("q"))
    first = F.min_by("rule_id", "s").alias("rule_id")
    equal = settled(asked.join(known.withColumnRenamed("own", "key"), ["g", "key"]).where(before).groupBy("candidate_id").agg(first), "equal")
    rest = settled(asked.join(equal, "candidate_id", "left_anti"), "rest")

    left, right = _signed(rest, "key", 0, config), _signed(known, "own", 1, config)
    met = left.select("c", "q", F.explode("signs").alias("h")).join(right.select("r", "s", F.explode("signs").alias("h")), "h").where(before).select("c", "r").distinct()
    for a, key, b, whole in ((left, "key", right, "own"), (right, "own", left, "key")):
        short = settled(a.where("short"), "short")
        if not short.isEmpty():
            met = met.unionByName(_contained(short, key, b, whole).where(before).select("c", "r")).distinct()
    shared = F.aggregate(F.zip_with(_histogram("key"), _histogram("own"), lambda a, b: F.least(a, b)), F.lit(0), lambda a, x: a + x)
    bound = 2.0 * shared / (F.length("key") + F.length("own"))
    near = 2.0 * F.least(F.length("key"), F.length("own")) / (F.length("key") + F.length("own")) + 1e-9 >= config.match_score
    met = met.join(rest.select("c", "g", "candidate_id", "key"), "c").join(known.select("r", F.col("g").alias("_g"), "rule_id", "own", "s"), "r").where("g = _g")
    met = met.withColumns({"overlap": token_overlap(F.col("own"), F.col("key")), "within": F.contains(F.col("own"), F.col("key")) | F.contains(F.col("key"), F.col("own"))})
    met = met.where((F.col("overlap") >= config.match_overlap) | F.col("within") | (near & (bound + 1e-9 >= config.match_score)))
    scored = met.withColumn("score", F.greatest(sequence_ratio("own", "key"), "overlap", F.when(F.col("within"), config.match_contained).otherwise(0.0)))
    scored = scored.where((F.col("score") >= config.match_score) | (F.col("overlap") >= config.match_overlap)).select("candidate_id", "rule_id", "s", "score")
    # an empty key is in every other
    least = lambda rows: rows.groupBy("g").agg(F.min_by(F.struct("rule_id", "s"), "s").alias("r")).select("g", "r.*")
    none = rest.where(F.length("key") == 0).join(least(known), "g").unionByName(rest.where(F.length("key") > 0).join(least(known.where(F.length("own") == 0)), "g"))
    scored = scored.unionByName(none.where(before).select("candidate_id", "rule_id", "s", F.lit(config.match_contained).alias("score")))
    best = scored.groupBy("candidate_id").agg(F.min_by("rule_id", F.struct(-F.col("score"), F.col("s"))).alias("rule_id"))
    return asked.select("candidate_id").join(equal.unionByName(best), "candidate_id", "left")
