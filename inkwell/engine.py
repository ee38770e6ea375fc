"""The session façade: ingest, draft, feedback and rules over the store's tables."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from inkwell import schemas as S
from inkwell.config import DEFAULT, Config
from inkwell.functions.rules import block_diff
from inkwell.operators import chunk, draft, ingest, learning, retrieve
from inkwell.operators.index import PostingIndex
from inkwell.operators.rulebook import RuleBook
from inkwell.sources import readers
from inkwell.sources.readers import Store, latest
from inkwell.streaming.jobs import FeedbackJobs

INDEX = "chunk_id string, doc_id string, text string, page_start int, page_end int, filename string, doc_type string, vector array<float>, session_id string"


class Engine:
    """All calls of the service; ids are hashes of their content, so reruns agree."""

    def __init__(self, spark: SparkSession, folder: str, config: Config = DEFAULT, embedder=None, query_writer=None, draft_writer=None, rule_extractor=None):
        readers.bound_batches(spark)
        self.spark, self.config, self.store = spark, config, Store(spark, folder)
        self.embedder = embedder or draft.Embedder(config.embedding_size)
        self.query_writer, self.draft_writer = query_writer or draft.QueryWriter(), draft_writer or draft.DraftWriter()
        self.rule_extractor = rule_extractor or draft.RuleExtractor()
        self.postings = PostingIndex(spark, f"{self.store.folder}/postings", config)
        self.rulebook = RuleBook(self.store, config)
        self._worker: tuple[FeedbackJobs, StreamingQuery] | None = None

    def health(self) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    def create_session(self, user_id: str, at: dt.datetime | None = None) -> str:
        at = at or dt.datetime.now(dt.timezone.utc)
        session = hashlib.sha256(f"{user_id}:{at.isoformat()}".encode()).hexdigest()[:32]
        self.store.append("sessions", self.spark.createDataFrame([(session, user_id, at)], S.SESSIONS))
        return session

    def session_user(self, session_id: str) -> str:
        row = self.store.load("sessions", S.SESSIONS).where(F.col("session_id") == session_id).first()
        if row is None:
            raise KeyError("Session not found")
        return row.user_id

    def ingest(self, session_id: str, pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
        """Pages (doc_id, filename, page_number, raw_text) to documents and to the session's index."""
        self.session_user(session_id)
        batch = self._batch(session_id)
        pages = self._written("pages", ingest.finished_pages(ingest.with_defaults(pages), None, self.config), S.PAGES, batch, "filename string")
        named = pages.groupBy("doc_id").agg(F.first("filename").alias("filename"))
        found = named.select("doc_id", "filename", F.lower(F.regexp_extract("filename", r"(\.[^./]+)$", 1)).alias("extension"), F.lit(None).cast("long").alias("length"))
        docs = self._written("documents", ingest.document_rows(pages, found, self.config), S.DOCUMENTS, batch)
        self._add(session_id, docs, pages, tables, batch)
        return docs

    def ingest_files(self, session_id: str, path: str, extractor=None, engine=None, answers: DataFrame | None = None, vision=None) -> tuple[DataFrame, DataFrame]:
        """The files of a folder to pages, entities, documents, chunks and the session's index; gives a
        row for each document, with its counts, and a row with the reason for each file that was not let in
        or could not be read; so every file has its answer.

        Pages, documents, entities and chunks are each written once and read from there. ``extractor``
        reads PDF files and ``engine`` images; ``vision`` reads weak pages again, or ``answers`` has what it
        read from them.
        """
        self.session_user(session_id)
        found, rejected = readers.files(self.spark, path, self.config)
        batch = self._batch(f"{session_id}:{path}")
        written = lambda table, rows, schema, more="": self._written(table, rows, schema, batch, more)
        raw = written("raw_pages", ingest.raw_pages(found, extractor, engine), S.RAW_PAGES)
        rejected, raw = rejected.unionByName(ingest.unread(raw, found)), raw.where("error is null").drop("error")
        if vision is not None:
            answers = written("vision_answers", ingest.vision_answers(found, raw, vision, extractor, self.config), S.ANSWERS)
        pages = written("pages", ingest.finished_pages(raw, answers, self.config), S.PAGES, "filename string")
        docs = written("documents", ingest.document_rows(pages, found.drop("content"), self.config), S.DOCUMENTS)
        entities = written("entities", ingest.entity_rows(pages), S.ENTITIES)
        tables = pages.where("has_tables").select("doc_id", "page_number", F.posexplode("tables").alias("table_index", "rows"))
        return ingest.upload_rows(docs, self._add(session_id, docs, pages, tables, batch), entities), rejected

    def _batch(self, of: str) -> str:
        return hashlib.sha256(f"{of}:{dt.datetime.now(dt.timezone.utc).isoformat()}".encode()).hexdigest()[:32]

    def _written(self, table: str, rows: DataFrame, schema: str, batch: str, more: str = "") -> DataFrame:
        """Append rows of an upload to a table and read them from there, so that nothing is done twice."""
        schema = f"{schema}, {more}" if more else schema
        names = [f.name for f in self.spark.createDataFrame([], schema).schema]
        rows, append = rows.select(*names, F.lit(batch).alias("batch")), lambda out: self.store.append(table, out, "batch")
        if table == "documents":
            readers.Metrics(self.store).written(rows, append, batch, readers.document_measures(), readers.METRICS)
        else:
            append(rows)
        return self.store.load(table, f"{schema}, batch string").where(F.col("batch") == batch).drop("batch")

    def _add(self, session_id: str, docs: DataFrame, pages: DataFrame, tables: DataFrame | None, batch: str) -> DataFrame:
        """Chunks of documents to the store and, with their vectors, to the session's index; documents to
        the session, in order of their names after those that it has."""
        bounds = chunk.page_bounds(pages)
        text = self._written("text_chunks", chunk.text_chunks(docs, bounds), S.TEXT_CHUNKS, batch)
        counts = text.groupBy("doc_id").agg(F.count("*").alias("n"))
        none = self.spark.createDataFrame([], "doc_id string, page_number int, table_index int, rows array<array<string>>")
        chunks = self._written("chunks", chunk.all_chunks(text, chunk.table_chunks(tables if tables is not None else none, bounds, counts, self.config)), S.CHUNKS, batch)
        flat = chunk.flatten(chunks, docs, session_id).withColumn("vector", self.embedder.embed(F.col("text")))
        self.store.append("chunk_index", flat.select(*[c.split()[0] for c in INDEX.split(", ")]), "session_id")
        self.postings.append(chunks.select("chunk_id", "text"), batch, session_id, "chunk_id")
        begin = int(dt.datetime.now(dt.timezone.utc).timestamp() * 1e6)  # uploads at once do not wait for each other's count
        order = Window.partitionBy("session_id").orderBy("filename", "doc_id")
        listed = docs.select(F.lit(session_id).alias("session_id"), "doc_id", "filename").withColumn("pos", (F.row_number().over(order) - 1 + begin).cast("long"))
        self.store.append("session_documents", listed.select("session_id", "doc_id", "pos"))
        return chunks

    def metrics(self) -> DataFrame:
        """A row for each upload: documents, pages, means of confidence and quality, and warnings."""
        return readers.Metrics(self.store).rows()

    def document(self, doc_id: str) -> dict:
        row = self.documents([doc_id]).first()
        if row is None:
            raise KeyError("Document not found")
        return row.asDict(recursive=True)

    def documents(self, doc_ids: list[str]) -> DataFrame:
        """Stored documents of a list of ids, in its order, the last version of each; unknown ones drop out."""
        asked = self.spark.createDataFrame([(list(doc_ids),)], "ids array<string>")
        stored = latest(self.store.load("documents", f"{S.DOCUMENTS}, batch string").where(F.col("doc_id").isin(list(doc_ids))), "doc_id", "processed_at")
        return readers.in_order_of(asked, stored.drop("batch"), "ids", "doc_id").orderBy("pos").drop("pos")

    def session_documents(self, session_id: str) -> list[str]:
        rows = self.store.load("session_documents", S.SESSION_DOCUMENTS).where(F.col("session_id") == session_id)
        return [r.doc_id for r in rows.orderBy("pos", "doc_id").collect()]

    def _index(self, session_id: str) -> DataFrame:
        return self.store.load("chunk_index", INDEX).where(F.col("session_id") == session_id)

    def delete_session(self, session_id: str) -> None:
        self.store.drop_partition("chunk_index", "session_id", session_id)
        self.postings.drop(session_id)

    def search(self, session_id: str, queries: DataFrame) -> DataFrame:
        """Dense and BM25 lists, fused and reranked; ``queries`` has query_id and query. BM25 reads the
        session's stored postings, not its texts."""
        index = self._index(session_id)
        texts = index.select(F.col("chunk_id").alias("id"), "text")
        asked = queries.select("query_id", self.embedder.embed(F.col("query")).alias("query_vector"))
        dense = retrieve.top_k(retrieve.dense_scores(index, asked, "chunk_id", "vector"), self.config.retrieve_k)
        sparse, _ = self.postings.search(queries, self.config.retrieve_k, session_id)
        best = retrieve.rerank(retrieve.fuse(dense, sparse, self.config), texts, queries, self.config.rerank_n)
        return best.drop("text").join(index.drop("vector", "session_id"), best["id"] == index["chunk_id"])

    def draft(self, session_id: str, draft_type: str, instructions: str | None = None, at: dt.datetime | None = None) -> dict:
        user = self.session_user(session_id)
        if draft_type not in S.DRAFT_TYPES:
            raise ValueError(f"Unknown draft type: {draft_type}")
        if not self.store.load("session_documents", S.SESSION_DOCUMENTS).where(F.col("session_id") == session_id).limit(1).count():
            raise ValueError("Session has no documents")
        at = at or dt.datetime.now(dt.timezone.utc)
        request = self.query_writer.write(self.spark.createDataFrame([(0, draft_type, instructions)], "query_id int, draft_type string, instructions string"))
        evidence = retrieve.evidence_rows(self.search(session_id, request), self.config)
        row = self.draft_writer.write(request, evidence).first()
        items = [r.asDict() for r in evidence.orderBy("rank").drop("query_id", "rank").collect()]
        rules = [r.asDict() for r in self.rules(user, draft_type, active=True).collect()]
        draft_id = hashlib.sha256(f"{session_id}:{draft_type}:{instructions}:{at.isoformat()}".encode()).hexdigest()[:32]
        run = (draft_id, user, session_id, draft_type, instructions, row["query"], row["draft"], items, [r["rule_id"] for r in rules], at)
        self.store.append("draft_runs", self.spark.createDataFrame([run], S.DRAFT_RUNS))
        return {"draft_id": draft_id, "retrieval_query": row["query"], "draft": row["draft"], "evidence": items, "applied_rules": rules}

    def submit_feedback(self, draft_id: str, edited: str, notes: str | None = None, at: dt.datetime | None = None, process: bool = True) -> str:
        """Store an edited draft; its job is taken up at once, or with ``process`` off by the next
        ``process_feedback`` or the worker that runs."""
        run = self.store.load("draft_runs", S.DRAFT_RUNS).where(F.col("draft_id") == draft_id).first()
        if run is None:
            raise KeyError("Draft not found")
        at = at or dt.datetime.now(dt.timezone.utc)
        feedback = hashlib.sha256(f"{draft_id}:{edited}:{at.isoformat()}".encode()).hexdigest()[:32]
        row = (feedback, draft_id, run.user_id, run.draft_type, run.draft, edited, notes, run.retrieval_query, "pending", None, None, None, at, None)
        self.store.append("feedback", self.spark.createDataFrame([row], S.FEEDBACK))
        if process:
            self.process_feedback()
        return feedback

    def feedback_worker(self, **trigger) -> tuple[FeedbackJobs, StreamingQuery]:
        """Take up feedback as a stream: with processingTime="2 seconds", say, in the background until it is
        stopped, else what waits now. Where it is at is kept in the store, so each feedback is taken once."""
        name = f"feedback-{hashlib.sha256(self.store.folder.encode()).hexdigest()[:8]}"
        jobs = FeedbackJobs(self.store, lambda rows: self.rule_extractor.extract(rows), lambda: self.store.load("draft_runs", S.DRAFT_RUNS), name)
        feedback = self.spark.readStream.schema(S.FEEDBACK).parquet(f"{self.store.folder}/feedback")
        self._worker = jobs, jobs.start(feedback, f"{self.store.folder}/checkpoints/feedback", **trigger)
        return self._worker

    def process_feedback(self) -> int:
        """Take up the feedback that waits, by the worker if one runs, and fold what was read from it into the
        saved rules; returns how many were taken up."""
        taken = 0
        if self._worker is not None and self._worker[1].isActive:
            jobs, query = self._worker
            taken = -jobs.taken
            query.processAllAvailable()
            taken += jobs.taken
        elif self.store.exists("feedback"):
            jobs, query = self.feedback_worker()
            query.awaitTermination()
            taken = jobs.taken
        self.rulebook.refresh()
        return taken

    def compact(self) -> None:
        """Keep the last state of each job only, in one batch; for times when no job is taken up. All
        batches must be in the saved rules before, so they are refreshed."""
        self.rulebook.refresh()
        before = self.store.partitions("jobs", "batch")
        kept = readers.settled(self._jobs(), "jobs")
        name = f"kept-{hashlib.sha256(':'.join(before).encode()).hexdigest()[:16]}"
        version, _ = self.rulebook._folded()
        listed = self.spark.createDataFrame([("jobs", name)], "source string, batch string").coalesce(1)
        self.store.replace(f"rule_inputs/version={version + 1}", listed)  # the batch has nothing new to fold
        self.store.replace(f"jobs/batch={name}/state=done", kept)
        for batch in before:
            self.store.drop_partition("jobs", "batch", batch)

    def _jobs(self) -> DataFrame:
        """The last state of each job."""
        names = [c.name for c in self.spark.createDataFrame([], S.JOBS).schema]
        return latest(self.store.load("jobs", S.JOBS).select(*names), "feedback_id", "at")

    def _rules(self, user_id: str) -> DataFrame:
        """The user's saved rules."""
        return self.rulebook.rules(user_id)

    def feedback_status(self, feedback_id: str) -> dict:
        """State of a feedback's job, its diff and the rules that its draft type's drafts would follow now."""
        row = self.store.load("feedback", S.FEEDBACK).where(F.col("feedback_id") == feedback_id).first()
        if row is None:
            raise KeyError("Feedback not found")
        job = self._jobs().where(F.col("feedback_id") == feedback_id).first()
        diff = block_diff(row.original_draft, row.edited_draft)
        return {
            "feedback_id": feedback_id, "draft_id": row.draft_id, "status": job.status if job else "pending", "error_message": job.error_message if job else None,
            "structured_diff": diff, "active_rules": [r.asDict() for r in self.rules(row.user_id, row.draft_type, active=True).collect()],
        }

    def rules(self, user_id: str, draft_type: str | None = None, include_disabled: bool = True, active: bool = False) -> DataFrame:
        own = self._rules(user_id)
        ranked = learning.active_rules(own, draft_type, self.config) if active else learning.list_rules(own, draft_type, include_disabled)
        return learning.public(ranked).orderBy("rank")

    def control_rule(self, user_id: str, rule_id: str, action: str, at: dt.datetime | None = None) -> None:
        """Enable, disable or delete a rule of the user; feedback that comes later may make it anew."""
        if action not in ("enable", "disable", "delete"):
            raise ValueError(f"Unknown action: {action}")
        if not self._rules(user_id).where(F.col("rule_id") == rule_id).count():
            raise KeyError("Rule not found")
        at = at or dt.datetime.now(dt.timezone.utc)
        event = hashlib.sha256(f"{rule_id}:{action}:{at.isoformat()}".encode()).hexdigest()[:32]
        self.store.replace(f"rule_controls/batch={event}", self.spark.createDataFrame([(user_id, rule_id, action, at, event)], S.RULE_CONTROLS))
        self.rulebook.refresh()

    def set_rule_status(self, user_id: str, rule_id: str, status: str, at: dt.datetime | None = None) -> None:
        self.control_rule(user_id, rule_id, {"active": "enable", "disabled": "disable"}[status], at)

    def delete_rule(self, user_id: str, rule_id: str, at: dt.datetime | None = None) -> None:
        self.control_rule(user_id, rule_id, "delete", at)
