"""Feedback jobs as a stream: every feedback becomes a completed or failed job, once, whatever is replayed."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from inkwell.functions.rules import structured_diff
from inkwell.schemas import CANDIDATE
from inkwell.sources.readers import Store, settled

#: Fixed value: what a job without its draft says.
NO_DRAFT = "Draft run not found for feedback"
JOB_COLUMNS = ("feedback_id", "user_id", "status", "candidates", "error_message", "at", "draft_type", "submitted_at", "applied_rule_ids")
#: What a job keeps of its feedback and of the draft, so that rules can be folded from jobs alone.
KEPT = ("feedback_id", "user_id", "draft_type", "submitted_at", "applied_rule_ids")
#: Halvings of a batch after which what still fails counts as failed.
HALVINGS = 40
MESSAGE = 500


class FeedbackJobs:
    """Takes up feedback in micro-batches. A batch has a folder of its own in the table ``jobs``, which a
    replay writes anew, so a job is there once; first its rows say ``processing``, then each also
    ``completed`` with the candidates that were read, or ``failed`` with a message.

    ``extract`` adds ``candidates`` to feedback; ``drafts`` gives the known drafts (draft_id,
    applied_rule_ids) of that time.
    """

    def __init__(self, store: Store, extract: Callable[[DataFrame], DataFrame], drafts: Callable[[], DataFrame], name: str = "feedback"):
        self.store, self.extract, self.drafts, self.name, self.taken = store, extract, drafts, name, 0

    def _write(self, rows: DataFrame, batch: int, state: str) -> None:
        rows.select(*JOB_COLUMNS).write.mode("overwrite").parquet(f"{self.store.folder}/jobs/batch={self.name}-{batch}/state={state}")

    def _read(self, rows: DataFrame, halved: int = 0) -> DataFrame:
        """Jobs with what was read from them. If that fails the halves are tried apart, so one feedback that
        cannot be read makes no other fail, and takes a few jobs more than the batch."""
        done = lambda read, status, why: read.select(*KEPT, F.lit(status).alias("status"), F.col("candidates").cast(f"array<{CANDIDATE}>").alias("candidates"), F.lit(why).cast("string").alias("error_message"))
        try:
            return settled(done(self.extract(rows), "completed", None), "jobs")
        except Exception as why:  # whatever the extractor raised is the job's message
            if halved == HALVINGS or rows.limit(2).count() < 2:
                return done(rows.withColumn("candidates", F.lit(None)), "failed", str(why).strip("'")[:MESSAGE])
        bit = F.shiftright(F.xxhash64("feedback_id"), halved) % 2 == 0
        return self._read(rows.where(bit), halved + 1).unionByName(self._read(rows.where(~bit), halved + 1))

    def batch(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch of feedback: feedback_id, draft_id, user_id, draft_type, submitted_at,
        original_draft, edited_draft and what else the extractor reads."""
        at = F.current_timestamp().alias("at")
        none = [F.lit(None).cast(f"array<{CANDIDATE}>").alias("candidates"), F.lit(None).cast("string").alias("error_message")]
        known = self.drafts().select("draft_id", "applied_rule_ids").dropDuplicates(["draft_id"]).withColumn("_known", F.lit(True))
        rows = settled(rows.join(known, "draft_id", "left"), "feedback")
        self.taken += rows.count()
        self._write(rows.select(*KEPT, F.lit("processing").alias("status"), *none, at), batch, "taken")
        there = rows.where("_known").drop("_known").withColumn("structured_diff", structured_diff("original_draft", "edited_draft"))
        lost = rows.where("_known is null").select(*KEPT, F.lit("failed").alias("status"), none[0], F.lit(NO_DRAFT).alias("error_message"))
        self._write(self._read(there).unionByName(lost).withColumn("at", F.current_timestamp()), batch, "done")

    def start(self, feedback: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Take up a stream of feedback: what is there and then stop, or with processingTime="2 seconds", say,
        whatever comes, in the background."""
        return feedback.writeStream.queryName(self.name).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(self.batch).start()


class StatusTable(StreamingQueryListener):
    """Keeps a row of each micro-batch and of each end of a query, as a JSON file of its own, so that a
    replayed batch is one row. Read it with ``rows``."""

    SCHEMA = "query string, run string, batch bigint, rows bigint, millis bigint, error string"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _put(self, name: str, row: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json")
        out = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(bytearray(json.dumps(row).encode()))
        finally:
            out.close()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._put(f"{p.id}-{p.batchId}", {"query": p.name, "run": str(p.runId), "batch": p.batchId, "rows": p.numInputRows, "millis": p.batchDuration})

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._put(f"{event.id}-{event.runId}", {"query": None, "run": str(event.runId), "batch": -1, "rows": 0, "millis": 0, "error": event.exception[:MESSAGE]})

    def rows(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.folder)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).json(self.folder)
