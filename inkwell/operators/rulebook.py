"""Saved rules: each user's rules after what was folded so far, and the inputs that are in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell import schemas as S
from inkwell.config import DEFAULT, Config
from inkwell.operators import learning
from inkwell.sources.readers import Store, settled

UPTO = "user_id string, upto struct<submitted_at:timestamp,late:boolean,feedback_id:string>"


class RuleBook:
    """Rules of users, folded from the batches of ``jobs`` and ``rule_controls`` in the store.

    A refresh reads the batches that came since the last one, and for their users the rules and how far
    in time these go; it writes both as a new version, of these users only. A version counts from when its
    list of inputs is there, so one that broke off is done again.
    """

    def __init__(self, store: Store, config: Config = DEFAULT):
        self.store, self.config = store, config

    def _folded(self) -> tuple[int, set[tuple[str, str]]]:
        """The last version, and the inputs of all."""
        rows = self.store.load("rule_inputs", "source string, batch string, version int").collect()  # a row for each batch
        return max((r.version for r in rows), default=0), {(r.source, r.batch) for r in rows}

    def _events(self, only: set[tuple[str, str]] | None = None) -> DataFrame:
        """Completed feedback and control events, all or of some batches, whose files alone are read then."""
        of = lambda table: [b for t, b in only or () if t == table]
        done = self.store.load("jobs", f"{S.JOBS}, batch string, state string").where("state = 'done' and status = 'completed'")
        set_ = self.store.load("rule_controls", f"{S.RULE_CONTROLS}, batch string")
        if only is not None:
            done, set_ = done.where(F.col("batch").isin(of("jobs"))), set_.where(F.col("batch").isin(of("rule_controls")))
        done = done.select("user_id", "feedback_id", "draft_type", "submitted_at", "candidates", "applied_rule_ids")
        return learning.with_controls(done, set_)

    def _current(self, table: str, schema: str, version: int) -> DataFrame:
        return self.store.load(table, f"{schema}, version int").where(F.col("version") <= version)

    def refresh(self) -> int:
        """Fold what is new into the rules of the users it is of; gives the version."""
        version, folded = self._folded()
        inputs = {("jobs", b) for b in self.store.partitions("jobs", "batch") if self.store.exists(f"jobs/batch={b}/state=done")} | {("rule_controls", b) for b in self.store.partitions("rule_controls", "batch")}
        new = inputs - folded
        if not new:
            return version
        events = settled(self._events(new), "events")
        upto, rules = self.upto(version, events.select("user_id").distinct()), self.rules(version=version, users=events.select("user_id").distinct())
        after, upto = learning.fold_increment(rules, upto, events, self._events, self.config)
        at = f"version={version + 1}"
        self.store.replace(f"rule_state/{at}", after)
        self.store.replace(f"rule_upto/{at}", upto)
        self.store.replace(f"rule_inputs/{at}", self.store.spark.createDataFrame(sorted(new), "source string, batch string").coalesce(1))
        return version + 1

    def _last(self, version: int, users: DataFrame | None, user_id: str | None) -> DataFrame:
        rows = self._current("rule_upto", UPTO, version)
        rows = rows if user_id is None else rows.where(F.col("user_id") == user_id)
        rows = rows if users is None else rows.join(users, "user_id", "left_semi")
        return rows.groupBy("user_id").agg(F.max("version").alias("version"), F.max_by("upto", "version").alias("upto"))

    def upto(self, version: int, users: DataFrame | None = None) -> DataFrame:
        return self._last(version, users, None).select("user_id", "upto")

    def rules(self, user_id: str | None = None, version: int | None = None, users: DataFrame | None = None) -> DataFrame:
        """The rules of a user, of some users or of all."""
        version = self._folded()[0] if version is None else version
        rows = self._current("rule_state", S.RULES, version)
        rows = rows if user_id is None else rows.where(F.col("user_id") == user_id)
        return rows.join(self._last(version, users, user_id).drop("upto"), ["user_id", "version"]).select(*[c.split()[0] for c in S.RULES.split(", ")])
