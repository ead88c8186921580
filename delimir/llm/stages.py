"""Stages of the corpus pipeline.  Each takes (spark, docs, sf_dir); all but the last keep the columns of docs.

Rows are documents of their own, whatever their ids; texts are read whole, however long; columns beside
``doc_id``, ``text``, ``lang`` and ``n_chars`` pass through whatever their names; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is unclear, those with null or empty text or without a letter among them.

    Rows with null ``lang`` are judged like others; where no row has one there is nothing to tell languages
    by, and all go.
    """
    from .zstd_language import fit, keep

    return keep(docs, fit(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score below the classifier's threshold; null text counts as empty.

    Without any label every score is 0.5, which is below it.
    """
    from .factor_machine import fit, keep

    return keep(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the first row, of each class of near copies.

    Null and empty texts are copies of one another, so one of them stays.
    """
    from .chosen_path import join

    row = "_row" + "_" * max((len(c) for c in docs.columns), default=0)  # no column of docs
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    first = join(numbered, id_col=row).where("is_first").select(row)
    return numbered.join(first, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets; ``n_chars`` follows where it is a column.

    Null texts stay null, with null ``n_chars``; every row stays.
    """
    from .pii import redacted

    got = redacted(docs)
    return got.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else got


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 ids over all documents that are left; null and empty texts are their closing id."""
    from .packing import pack

    return pack(docs, vocabulary("word_bpe_49k.json"))


def run(spark: SparkSession, sf_dir: str, stages: list) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(stages):
        docs = stage(spark, docs, sf_dir)
        if k < len(stages) - 1:
            docs = written(docs, name)
    return docs
