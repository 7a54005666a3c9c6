"""Corpus preparation as five stages over ``documents``: every stage reads what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's ``docs``.  The first four return the
columns of ``docs``; the last returns the packed pieces.

Defined cases, in every stage: null text counts as empty (and stays null in what
is kept); an empty text is scored like any other; rows that repeat are copies of
each other, of which one stays; of ties the smallest id stays, a null id last;
texts are read whole, whatever their length; columns beside those of
``documents`` are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logsift.llm import exact, packing, quality, simhash, suffix
from logsift.llm.common import compact, files_for, fresh, numbered, stage, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as label 1."""
    row = fresh(docs, "row")
    rows = numbered(docs, row)
    scored = quality.quality_scores(rows, table(spark, sf_dir, "labels"), keep=(row,))
    return compact(rows.join(scored.where("predicted = 1").select(row), row, "left_semi").drop(row),
                   files_for(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal but for white space."""
    return exact.keep_distinct(docs)


def distinct_fingerprints(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of linked SimHash fingerprints."""
    return simhash.keep_first(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 200-byte strings that occur elsewhere; whole characters only."""
    return suffix.drop_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("SimHash near-dedup", distinct_fingerprints),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", packed),
]

ORACLE_SQL = None         # SQL can't train the classifier; tests/llm compares run() with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", files_for(docs))
    return docs
