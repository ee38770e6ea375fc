"""The learning fold and document ingest as streams."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from inkwell.config import DEFAULT, Config
from inkwell.operators.learning import as_frame, control, fold_feedback, in_time
from inkwell.schemas import RULES


def _plain(value):
    return None if value is None else value.isoformat() if hasattr(value, "isoformat") else str(value)


def _step(rules: list[dict], row: dict, config: Config) -> list[dict]:
    """One feedback or event, as ``_as_json`` gives it, into a user's rules."""
    row["submitted_at"] = _plain(row["submitted_at"])
    if row.get("action"):
        return control(rules, row)
    row["candidates"] = json.loads(row["candidates"] or "[]")
    row["applied_rule_ids"] = json.loads(row["applied_rule_ids"] or "[]")
    return fold_feedback(rules, row, config)


def _as_json(rows: DataFrame) -> DataFrame:
    for name in ("candidates", "applied_rule_ids"):
        rows = rows.withColumn(name, F.to_json(name))
    for name in ("action", "rule_id"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return rows


def fold_stream(feedback: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The users' rules after each micro-batch that touched them, as JSON in ``rules``.

    The state of a user is the list of rules; the fold is the batch's own, so where batches end does
    not change the result, as long as feedback comes in order of (submitted_at, feedback_id) across
    batches. ``feedback`` may have ``action`` and ``rule_id``: enable, disable or delete instead.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rules = json.loads(state.get[0]) if state.exists else []
        frame = pd.concat(list(frames))
        for row in in_time(frame):
            rules = _step(rules, row, config)
        text = json.dumps(rules, ensure_ascii=False)
        state.update((text,))
        yield pd.DataFrame({"user_id": [key[0]], "rules": [text]})

    return _as_json(feedback).groupBy("user_id").applyInPandasWithState(run, "user_id string, rules string", "rules string", "update", GroupStateTimeout.NoTimeout)


class RuleEntries(StatefulProcessor):
    """The fold with an entry of state for each rule: a batch writes the entries it changed, and gives these
    out, removed ones as null. Feedback as in ``fold_stream``."""

    def __init__(self, config: Config = DEFAULT):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("rules", "rule_id string", "rule string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {k[0]: v[0] for k, v in self.entries.iterator()}
        rules = sorted(map(json.loads, before.values()), key=lambda r: r["insert_seq"])
        for row in in_time(pd.concat(list(rows))):
            rules = _step(rules, row, self.config)
        after = {r["rule_id"]: json.dumps(r, ensure_ascii=False) for r in rules}
        changed = [(k, v) for k, v in after.items() if before.get(k) != v] + [(k, None) for k in before if k not in after]
        for k, v in changed:
            if v is None:
                self.entries.removeKey((k,))
            else:
                self.entries.updateValue((k,), (v,))
        yield pd.DataFrame({"user_id": [key[0]] * len(changed), "rule_id": [k for k, _ in changed], "rule": [v for _, v in changed]}, dtype=object)

    def close(self) -> None:
        pass


#: What keeps state on disk, a key each, and only writes what changed.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fold_entries(feedback: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(user_id, rule_id, rule) of each rule that a micro-batch changed, as JSON, null where it went. Start
    the query with the setting ``ROCKSDB``."""
    rows = _as_json(feedback)
    return rows.groupBy("user_id").transformWithStateInPandas(statefulProcessor=RuleEntries(config), outputStructType="user_id string, rule_id string, rule string", outputMode="Update", timeMode="None")


def rules_of(latest: DataFrame) -> DataFrame:
    """Rule rows from the stream's last output of each user."""

    def run(batches):
        for frame in batches:
            rules = [r for text in frame["rules"] for r in json.loads(text)]
            out = as_frame(rules)
            out["last_updated"] = pd.to_datetime(out["last_updated"], format="ISO8601")  # whole seconds have no fraction
            yield out

    return latest.select("rules").mapInPandas(run, RULES)


def job_states(events: DataFrame, drafts: DataFrame) -> DataFrame:
    """Feedback jobs as they are taken up: failed with a message where the draft is unknown."""
    known = drafts.select("draft_id", F.lit(True).alias("_known")).dropDuplicates(["draft_id"])
    rows = events.join(known, "draft_id", "left")
    return rows.withColumns({"status": F.when(F.col("_known"), "completed").otherwise("failed"), "error_message": F.when(F.col("_known").isNull(), F.lit("Draft not found"))}).drop("_known")


def ingest_stream(source: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Append-only ingest of a file stream: ``write`` puts each micro-batch to both indexes."""
    return source.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
