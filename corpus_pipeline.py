"""From raw documents to token ids: each stage calls one operator of tessella.llm and reads what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import bpe, crf, postings, simhash, store, suffixdedup


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.

    Rows are judged one by one: repeated rows stay or go together, null and empty texts are judged by the model's prior,
    long ones whole. Without labels of both kinds nothing is learned and nothing rejected. Columns pass through whatever
    their names; an empty table gives an empty one.
    """
    return crf.without_toxic(docs, crf.train(docs, store.table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of the five-word shingles in common, as 512 bits estimate it).

    The least id of a group stays, one row of it; a null id only where the group has no other; unlike texts with one id
    both stay. Null, empty and blank texts are copies of each other. Columns pass through whatever their names; an empty
    table gives an empty one.
    """
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings of 200 that start elsewhere, too; n_chars follows the text.

    All rows stay, also those that lose all their text; null stays null. Columns pass through whatever their names; an
    empty table gives an empty one.
    """
    cut = suffixdedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark items.

    Null and empty texts stay; repeated rows stay or go together; items without an id or without words do nothing.
    Columns pass through whatever their names; an empty table of either kind is none.
    """
    return postings.without_contaminated(docs, store.table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and whether they decode to the text again.

    Null and empty texts have no ids; repeated rows stay; columns named ids, n_tokens or round_trip are replaced; an empty
    table gives an empty one.
    """
    return bpe.tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("contamination", drop_contaminated),
    ("tokens", to_tokens),
]

#: Trained fields, sorted suffixes and byte pair merges are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again; a stage's table goes once the next one is written."""
    docs = store.table(spark, sf_dir, "documents")
    with store.Scratch(spark) as scratch:
        for name, stage in STAGES[:-2]:
            last, docs = docs, scratch.written(stage(spark, docs, sf_dir), name)
            if name != STAGES[0][0]:
                scratch.drop(last)
        name, stage = STAGES[-2]
        docs = store.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
