"""Incremental model update: token counts of each micro-batch appended, merged on read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.base import token_counts


def update_counts(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a batch's counts under its id: a batch that runs again replaces what it wrote."""
    def batch(df: DataFrame, epoch: int) -> None:
        token_counts(df).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("tok").agg(F.sum("cnt").alias("cnt"))
