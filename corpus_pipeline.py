"""Corpus pipeline: documents through cleaning, dedup, decontamination and mixing to shards.

Each stage takes all rows that the one before kept and returns the columns of
documents; the last returns one row per document with its shard and slot.
Decisions take effect: rejected, copied, contaminated and unsampled documents
are gone, and lines that fail the quality rules are cut from the texts.

Defined results: a null or empty text has too few words and is rejected; rows
that share a doc_id stay or go by their own text in every stage but near-dedup, which
keeps or drops a doc_id as a whole; a null doc_id is no copy of another; of tied
copies the least doc_id stays; an empty table gives an empty table; other columns
pass through to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import common, decontam, mixing, neardup, quality, sharding


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: rejected documents go, failing lines are cut."""
    return quality.keep_quality(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the least doc_id of each group of near copies stays."""
    return neardup.keep_distinct(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a benchmark window go."""
    return decontam.keep_uncontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents are sampled to raked source, language and topic weights."""
    return mixing.keep_mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: contiguous minimax partition into shards."""
    return sharding.shard_documents(docs)


STAGES = [("quality rules", clean), ("near-dedup", dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

#: Minimax cuts need a binary search over greedy walks; tests compare run() with the SQL of the other stages and a brute-force capacity.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
