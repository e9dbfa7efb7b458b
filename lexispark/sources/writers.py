"""Sinks: corpora, aligned lines, vocabularies and XML reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def write_corpus(tokens: DataFrame, path: str) -> None:
    """One line a row: toks joined by blanks."""
    tokens.select(F.array_join("toks", " ").alias("value")).write.text(path)


def write_aligned(rows: DataFrame, path: str) -> None:
    """Two lines a row, tokens then lemmas, side by side in one file."""
    rows.select(F.concat_ws("\n", F.array_join("toks", " "), F.array_join("lemmas", " ")).alias("value")).write.text(path)


def write_vocabulary(texts: DataFrame, path: str) -> None:
    """Distinct words that begin with a small letter."""
    texts.select(F.explode(X.blank_tokens(F.col("text"))).alias("value")).filter(F.col("value").rlike(r"^\p{Ll}")).distinct().write.text(path)


def write_report(report: DataFrame, path: str, root: str = "RESULTS", row: str = "RESULT") -> None:
    report.write.option("rootTag", root).option("rowTag", row).format("xml").save(path)


def write_words(words: DataFrame, path: str) -> None:
    """Distinct words of a column word: the universe of an evaluation, or unique collocations."""
    words.select(F.col("word").alias("value")).filter(F.col("value") != "").distinct().write.text(path)


def concatenate(spark: SparkSession, paths: list[str], path: str) -> None:
    """Lines of several text files in one folder."""
    spark.read.text(paths).write.text(path)


def write_parameters(spark: SparkSession, groups: dict[str, dict[str, object]], path: str) -> None:
    """Parameters and statistics as XML: a GROUP for each group of names and values."""
    rows = [(g, [(str(k), str(v)) for k, v in values.items()]) for g, values in groups.items()]
    spark.createDataFrame(rows, "_LABEL string, PARAM array<struct<_LABEL: string, _VALUE: string>>").write.option("rootTag", "PARAMETERS").option("rowTag", "GROUP").format("xml").save(path)
