"""A corpus from raw documents to token records: five stages, each a table that the next one reads.

Every stage takes null and empty texts, null keys and sources, repeated rows, columns of any further name, and an empty
table (which stays empty); what becomes of each is said below.  All but the last keep the columns they find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import decontaminate, mixing, records, similar, toxicity
from barloom.llm.common import settle, table
from barloom.llm.subwords import default_path
from barloom.session import prepare


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text the lexicon does not reject; learned from the labels of the documents given.

    Null and empty texts stay; repeated rows stay or go together; without toxic labels all stay.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group that shares 80 % of its five-word shingles.

    Null and empty texts are copies of each other; a row without id stays only where its group has none with one; rows
    alike in id and text cannot be told apart and stay together.
    """
    return similar.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none and stay, repeated rows fare alike."""
    return decontaminate.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share takes them; texts without words are never taken, null is a source."""
    return mixing.mix(docs)


def write_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all documents, as read back: place, length and checksum; a null text is the end id alone."""
    return records.token_records(docs, default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_records", write_records),
]

#: The toxicity model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
