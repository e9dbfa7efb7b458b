"""Queries over the reference operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import base, counts, decode, models, pieces, segment, tagging, tokens, vectors  # noqa: F401  modules register their queries


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top links between neighbouring tokens: lines, tokens, window pairs, counts, pruning, shares."""
    return counts.rank_links_pruned(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
