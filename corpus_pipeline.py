"""Corpus pipeline: toxicity, line dedup, near-duplicates, benchmark decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next.
All but the last return the columns of the documents.  A stage works on all rows that its predecessor kept.

Defined cases, of all stages: a null text is an empty one (the line stage leaves it null) and stays unless a like one is
kept; a null doc_id is an id of its own, last in order; ties go by doc_id, then by a hash of the text; rows that repeat a
doc_id, or a doc_id and its text, are told apart by their texts, and near-duplicates keep one of exact repeats; empty
tables give empty results, and without labels of both classes, or without items, nothing is rejected; columns pass
through untouched, whatever their names, but text and n_chars, which line dedup changes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from paperlens.llm import decontaminate, line_dedup, mixing, near, toxicity
from paperlens.llm.common import stored, table


def toxic(spark, docs, sf_dir):
    """Documents that the classifier rejects go; it is fitted on the labelled documents among `docs`."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.teaches())
    name = f"_score_beside_{len(docs.columns)}_columns"
    return toxicity.scores(docs, model, name=name).filter(F.col(name) < 0.5).select(*docs.columns)


def repeated_lines(spark, docs, sf_dir):
    """Lines that an earlier line equals, or nearly equals, go; every document stays, perhaps without text."""
    return line_dedup.dedup_lines(docs, counts=False).select(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Of every group of near-duplicates one row stays: of its smallest doc_id, null last, the text with the smallest hash."""
    return near.one_of_each(docs).select(*docs.columns)


def benchmark_passages(spark, docs, sf_dir):
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixed(spark, docs, sf_dir):
    """The documents that the mix takes: doc_id, source, size, source_size, target, copies, taken."""
    return mixing.mix(docs).filter("copies > 0")


STAGES = [
    ("toxicity", toxic),
    ("line_dedup", repeated_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("mixing", mixed),
]

#: The classifier and the fingerprints have no SQL; tests/llm holds every stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
