"""The corpus pipeline: quality, near copies, repeated substrings, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns
the columns of documents, the last one the packed pieces. run() applies them to documents,
each stage's rows written to the shared folder and read again, so that a lost executor costs
one stage at most.
"""

from __future__ import annotations

import public_tokenizers

from lattica.llm import decontaminate, packing, quality, simhash, substrings
from lattica.llm.common import materialize, table


def classify(spark, docs, sf_dir):
    """Documents that the quality classifier doesn't reject."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """One document, of the smallest id, of each group of near copies."""
    return simhash.one_of_each(docs)


def substring_dedup(spark, docs, sf_dir):
    """Documents without the passages that occur elsewhere too."""
    return substrings.deduplicated(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that leak no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit(spark, docs, sf_dir):
    """The pieces of every document with their places in sequences of 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", classify),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", best_fit),
]

#: No stage but the joins around them can be said in SQL; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
