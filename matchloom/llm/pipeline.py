"""A training corpus from ``documents``: five stages, each over all that the one before kept.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of documents, further ones too, whatever
their names. Every stage takes nulls in any column, empty and very long texts, ties, repeated rows and
empty tables; what it makes of them stands beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchloom.llm import op3_classifier, op5_mixing, op6_bpe, op7_pii, op8_jaccard
from matchloom.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null, empty and very short texts have no evidence against them and stay; null sources and languages are
    sites of their own; repeated rows share a verdict; without labels of both kinds all stay."""
    return op3_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram similarity stays, the one with the smallest id.

    Null, empty and wordless texts link with nothing and all stay, as do rows without an id; a row repeated with
    its id stays once; an id that stands for two different texts is two documents."""
    return op8_jaccard.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; no row goes.

    Null texts stay null; secrets of any length are masked whole; a table that can't teach the method has its base
    kinds masked only."""
    return op7_pii.redact(docs, op7_pii.train(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that sources, languages and topics meet their target weights.

    Null sources and languages are groups of their own; repeated rows and rows without an id share a draw; a cell
    without any word stays whole."""
    return op5_mixing.mix(docs)[0].select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, as counts and digests; null counts as empty, with no tokens."""
    return op6_bpe.digest(docs)


STAGES: list[tuple[str, Callable]] = [
    ("quality_classifier", quality),
    ("ngram_jaccard", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixing),
    ("byte_bpe", tokens),
]

#: The classifier is fitted by iteration and components and BPE are loops: SQL can't express the stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
