"""Drafting: guidance, retrieval query, prompts, and the writers behind interfaces.

The bundled writers are deterministic stand-ins, not language models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.rules import diff_json

#: What a draft of each type is to look for; words for the stand-in writers.
GUIDANCE = {
    "title_review_summary": "Who owns the property and through which deeds, who conveyed it to whom, what burdens it (mortgage, lien, easement, encumbrance), how it is described, and which title papers are not there.",
    "case_fact_summary": "Who is involved, what happened when, case numbers, what is claimed, where the proceedings stand, and where documents disagree.",
    "notice_related_summary": "What kind of notice it is, from whom to whom, its dates and deadlines, what default it names and how to cure it, how it was served, and what must be done.",
    "document_checklist": "Which kinds of documents are there, which seem missing or doubled, which scans are weak, and what a person should look at.",
    "internal_memo": "The main facts, the serious risks, open questions, evidence that is lacking, and a short structure for a first memo.",
}


def guidance(draft_type: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in GUIDANCE.items() for x in pair])[draft_type]


class QueryWriter:
    """Stand-in for the model that rewrites a request as a search query: its parts, joined."""

    def write(self, requests: DataFrame) -> DataFrame:
        text = F.concat_ws(" ", F.translate("draft_type", "_", " "), guidance(F.col("draft_type")), F.coalesce("instructions", F.lit("")))
        return requests.withColumn("query", F.trim(text))


class DraftWriter:
    """Stand-in for the drafting model: a heading and a line for each piece of evidence."""

    def write(self, requests: DataFrame, evidence: DataFrame) -> DataFrame:
        line = F.struct("rank", F.format_string("- %s (%s, pages %d-%d)", "snippet", "filename", "page_start", "page_end").alias("line"))
        body = evidence.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("body"))
        out = requests.join(body, "query_id", "left")
        title = F.initcap(F.translate("draft_type", "_", " "))
        return out.withColumn("draft", F.concat_ws("\n\n", title, F.coalesce("body", F.lit("No evidence was found.")))).drop("body")


def draft_prompt(requests: DataFrame) -> DataFrame:
    """What a drafting model would be given; needs draft_type, instructions, evidence, prompt."""
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Draft type: "), F.col("draft_type")),
        F.concat(F.lit("Guidance: "), guidance(F.col("draft_type"))),
        F.concat(F.lit("Instructions: "), F.coalesce("instructions", F.lit("None"))),
        F.concat(F.lit("Style rules:\n"), F.coalesce("prompt", F.lit("None"))),
        F.concat(F.lit("Evidence:\n"), F.coalesce("evidence", F.lit(""))),
    )
    return requests.withColumn("draft_prompt", text)


def rules_request(feedback: DataFrame) -> DataFrame:
    """What a model that reads rules from an edit would be given; needs draft_type, retrieval_query,
    operator_notes, original_draft, edited_draft, structured_diff."""
    part = lambda title, c: F.concat(F.lit(f"{title}:\n"), F.coalesce(c, F.lit("None")))
    text = F.concat_ws("\n\n", part("Draft type", F.col("draft_type")), part("Query", F.col("retrieval_query")), part("Notes", F.col("operator_notes")), part("Draft", F.col("original_draft")), part("Edited draft", F.col("edited_draft")), part("Changes", diff_json(F.col("structured_diff"))))
    return feedback.withColumn("rules_request", text)


class RuleExtractor:
    """Stand-in for the model that reads rules from an edit: one candidate a changed block."""

    def extract(self, feedback: DataFrame) -> DataFrame:
        made = F.transform(
            F.filter("structured_diff", lambda d: d["after"] != ""),
            lambda d: F.struct(
                F.concat(F.lit("Prefer: "), F.substring(d["after"], 1, 80)).alias("description"), F.lit("other").alias("category"),
                d["before"].alias("example_before"), d["after"].alias("example_after"), F.array().cast("array<string>").alias("applicable_draft_types"), F.lit(0.6).alias("confidence"),
            ),
        )
        return feedback.withColumn("candidates", made)


class Embedder:
    """Stand-in for an embedding model: hashed term counts, scaled to length 1."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, text: Column) -> Column:
        from inkwell.operators.retrieve import tokens

        once = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)  # noqa: E731  a bound value is made once
        slots = F.transform(tokens(F.lower(text)), lambda w: F.pmod(F.xxhash64(w), F.lit(self.size)).cast("int"))
        counts = lambda own: F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda i: F.size(F.filter(own, lambda s: s == i)).cast("double"))
        norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
        scaled = lambda c: once(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))
        return once(slots, lambda own: once(counts(own), scaled))


class OcrEngine:
    """Interface for text recognition: pages of images in, (text, confidence) out. None is bundled."""

    def read(self, content: bytes) -> tuple[str, float]:
        return "", 0.0


class VisionExtractor(OcrEngine):
    """Interface for a vision model as the fallback of text recognition. None is bundled."""
