"""The corpus pipeline: each stage works on all rows that the stage before it kept.

All stages but the last return the columns of documents. ORACLE_SQL is None, as SQL expresses
neither the learnt filter nor the fingerprints; the tests compare with a brute-force version.

Defined cases, in all stages: a null text is an empty one, which the filters keep and the dedup stages reduce to one;
a null id comes after all others, and rows without one are kept apart by their texts and other columns; of rows that
repeat an id and a text one stays, chosen by a hash of the plain columns; texts of any length
are read whole; further columns are carried, whatever their names, to the stage before the last; empty documents
give an empty result, and without labels that teach anything or without benchmark items the filter keeps all.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm import decontaminate, exact_dedup, near_copies, sentencepiece_bpe, toxicity
from lodeweave.llm.common import staged, table
from lodeweave.llm.queries import tokenizer_path
from lodeweave.sources.shared import ARROW_ROWS, READER_ROWS, settings_kept, temporary_tables

#: Rows with whole texts that are held at once.
TEXTS_AT_ONCE = {ARROW_ROWS: 1000, READER_ROWS: 512}


def few_texts_at_once(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with TEXTS_AT_ONCE at most. The settings stay after it: its result is planned when the caller writes it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, rows in TEXTS_AT_ONCE.items():
            now = int(spark.conf.get(name))
            spark.conf.set(name, str(min(rows, now) if now > 0 else rows))  # 0 or less: no limit
        return stage(spark, docs, sf_dir)

    return run


@few_texts_at_once
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_rows(docs, table(spark, sf_dir, "labels"))


@few_texts_at_once
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_rows(docs)


@few_texts_at_once
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


@few_texts_at_once
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


@few_texts_at_once
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("sentencepiece", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with temporary_tables(spark), settings_kept(spark, *TEXTS_AT_ONCE):  # a stage's own tables go when its result is written
            kept = stage(spark, docs, sf_dir)
            docs = staged(kept, lasting=True)
    return docs
