"""Building blocks: lines, tokens, the corpus lexicon, and query registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..shipping import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores is spread over them first."""
    ship(spark)
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line, text: every line feed ends a sentence."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def token_lists(docs: DataFrame) -> DataFrame:
    """doc_id, line, toks: letter tokens of every line, split once, where lines without any make no difference."""
    return lines(docs).select("doc_id", "line", X.letter_tokens(F.col("text")).alias("toks"))


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, line, toks: letter tokens of every line that has some."""
    return token_lists(docs).filter(F.size("toks") > 0)


def token_rows(docs: DataFrame) -> DataFrame:
    return sentences(docs).select("doc_id", "line", F.posexplode("toks").alias("pos", "tok"))


def token_counts(docs: DataFrame) -> DataFrame:
    """tok, cnt. Counted without positions: partial aggregates before the only shuffle."""
    return X.letters_only(docs.select(F.explode(X.raw_tokens(F.col("text"))).alias("tok"))).groupBy("tok").agg(F.count("*").alias("cnt"))


def lexicon(docs: DataFrame, least: int = 20, shortest: int = 2, longest: int = 7) -> DataFrame:
    """word, cnt: the corpus' own frequent short words."""
    return token_counts(docs).filter((F.col("cnt") >= least) & F.length("tok").between(shortest, longest)).select(F.col("tok").alias("word"), "cnt")


#: DuckDB twins of the blocks above.
TOKS = r"list_filter(regexp_split_to_array(lower({c}), '[\x09-\x0D\x20[:punct:]]+'), lambda x: regexp_matches(x, '^\p{{L}}+$') and length(x) < 25)"
SQL_LINES = "ln as (select doc_id, generate_subscripts(ls, 1) - 1 as line, unnest(ls) as text from (select doc_id, string_split(text, chr(10)) as ls from documents))"
SQL_SENTENCES = SQL_LINES + f", se as (select doc_id, line, toks from (select doc_id, line, {TOKS.format(c='text')} as toks from ln) where len(toks) > 0)"
SQL_TOKENS = SQL_SENTENCES + ", tk as (select doc_id, line, generate_subscripts(toks, 1) - 1 as pos, unnest(toks) as tok from se)"
SQL_COUNTS = f"tc as (select tok, count(*) as cnt from (select unnest({TOKS.format(c='text')}) as tok from documents) group by tok)"
SQL_LEXICON = SQL_COUNTS + ", lx as (select tok as word, cnt from tc where cnt >= 20 and length(tok) between 2 and 7)"
