"""The corpus pipeline: documents in, a mixed training corpus out.

STAGES are (name, function(spark, docs, sf_dir)); a driver may write and read each stage's
result before the next, or run() applies them one after the other. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioworks.llm.common import cut, documents
from folioworks.llm.decontaminate import without_leaks
from folioworks.llm.language import keep_identified
from folioworks.llm.lines import without_recurring_lines
from folioworks.llm.mixing import mixture
from folioworks.llm.neardup import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, or with an uncertain one, go.

    Null, empty and letterless texts go; without any label to learn from, only these. Repeated
    rows share their result, ties go to the label that sorts first, texts are read whole, an
    empty table stays empty, and other columns stay whatever their names.
    """
    return keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but their first; documents left without words go.

    Null and empty texts stay as they are, and so do rows without an id. Rows that share an id
    are one document; of documents tied for a line the smallest id keeps it. Texts of any length
    are read whole, n_chars follows the text, and other columns stay whatever their names.
    """
    return without_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id: five-word shingles, similarity 0.8.

    Null and empty texts are like nothing and stay, as do rows without an id. Of rows that share
    an id and a text one stays; with other texts they are one document, and stay or go together.
    Texts are compared whole; other columns stay whatever their names.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with all rows of their id.

    Null and empty texts, and rows without an id, stay; so does all if there are no items.
    Passages of texts of any length are searched; other columns stay whatever their names.
    """
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with their size and how often; those it does not take go.

    Null and empty texts have size 0; a null source is one of its own; rows that share an id
    (or have none) share their hash, each is decided by its own size. size, copies and taken
    replace columns of these names; other columns stay.
    """
    return mixture(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: No SQL expresses the classifier and the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written once in the shared checkpoint folder."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
