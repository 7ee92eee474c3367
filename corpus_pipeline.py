"""Corpus preparation: tell languages, cut repeated lines, drop near-copies and benchmark leaks, pack into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import table, written
from tidemark.llm.decontaminate import keep_clean
from tidemark.llm.language_id import keep_identified
from tidemark.llm.line_dedup import keep_new_lines
from tidemark.llm.packing import pack
from tidemark.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; those that are like none of them go.

    Null and blank texts and texts without letters go, and all of them where no row has a label; rows that repeat share
    their fate; very long texts are read whole; an empty table stays empty; further columns stay, whatever their names.
    """
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of two and more lines that an earlier one holds; ``n_chars`` follows the text.

    A document of which nothing is left goes.  Null, empty and one-line texts stay as they are.  Of rows that share an id the
    order is that of a hash of their texts, rows that repeat id and text are cut alike, rows without an id come last.  The cut takes
    time in proportion to the lines; an empty table stays empty; further columns stay, whatever their names.
    """
    return keep_new_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: 5-word shingles, a similarity of 0.8 or more.

    Null and blank texts are copies of each other; rows that repeat id and text are one, rows that share an id alone are not;
    rows without an id stay only where no other of their group has one (of these, one).  Very long texts are read whole; an empty table
    stays empty; further columns stay, whatever their names.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, with its own values or others.

    Null and empty texts stay; rows of one id are judged each by its text; repeated rows share their fate; items without an id
    count; very long texts are read whole; with an empty table on either side all rows stay; further columns stay, whatever their names.
    """
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, with their sequence and place.

    A null or empty text is one piece that holds its end alone; rows that repeat or lack an id are documents of their own;
    longer texts than a sequence are cut; an empty table gives no rows; other columns are not read.
    """
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: Fingerprints, tokens and packing have no SQL form; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
