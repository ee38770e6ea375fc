"""From raw documents to shards: what to keep, in which amounts, and where.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written and read again
as the next one's ``docs``.
"""

from __future__ import annotations

from inkwell.llm.common import discard, materialise, read, scratch
from inkwell.llm.decontam import drop_contaminated
from inkwell.llm.jaccard import keep_one_of_each
from inkwell.llm.mixing import taken_texts
from inkwell.llm.quality import keep_good
from inkwell.llm.sharding import shard_by_bytes


def quality(spark, docs, sf_dir):
    """Documents that the classifier accepts."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One document of each class of near duplicates, the one of the smallest id."""
    return keep_one_of_each(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that benchmark passages do not contaminate."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark, docs, sf_dir):
    """The texts of the mixture: repeated, whole or in part as the quotas say."""
    return taken_texts(docs)


def sharding(spark, docs, sf_dir):
    """A shard of near equal bytes and a slot for each text of the mixture, with the text."""
    return shard_by_bytes(docs, carry=("text", "lang", "source"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixing),
    ("sharding", sharding),
]

#: The classifier and the differencing are beyond SQL; tests state the stages by hand.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages' result over ``documents``. Each stage is written to the shared folder; what a stage has
    written on its way goes when it is done, and its result when the next one is."""
    docs, before = read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as written:
            docs = materialise(stage(spark, docs, sf_dir), f"stage{k}")
            written.remove(docs.written_to)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
