"""What the operators share: tables, written intermediates, streamed maps."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all tasks run here, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="lexispark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and no lineage to lose."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of written() that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.split("://")[-1].replace("file:", "").startswith(shared_dir(spark).split("://")[-1].replace("file:", "")):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: other columns, whatever their names, can't clash."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def filter_batches(docs: DataFrame, keep: Callable[[object], object]) -> DataFrame:
    """Rows of docs, all columns as they are, for which keep(chunk of texts) is true. No shuffle."""
    from . import kernel

    d = docs.withColumn("text", F.col("text").cast("string"))
    at = d.columns.index("text")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for c in kernel.chunks(b.column(at)):
            yield b.slice(c.first, c.n).filter(pa.array(keep(c)))

    return map_batches(d, run, d.schema)
