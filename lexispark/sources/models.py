"""Models are Parquet tables in the shared folder that the session names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where none is set and all tasks run here, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Saved:
    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema


def save(df: DataFrame, name: str, path: str | None = None) -> Saved:
    path = path or f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Saved(df.sparkSession, path, df.schema)


def load(saved: Saved) -> DataFrame:
    return saved.spark.read.schema(saved.schema).parquet(saved.path)
