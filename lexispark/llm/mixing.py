"""Operator 7, mixing sources to target weights by iterative proportional fitting.

Token counts are aggregated to cells (source, language, topic). The cells'
weights are raked: scaled in turn to the target share of every source, every
language and every topic, until the shares agree. Targets default to the
tempered shares of the data (share ** temper, normalised), or are given.
A document is then sampled with its cell's calibrated probability, the raked
weight over the cell's tokens, scaled by the largest factor that needs no
document twice. The draw is a hash of doc_id, so it is the same in every run,
order and partitioning.

Only cells are raked. Up to ``LOCAL_CELLS`` of them are fitted on the driver
with numpy, more with the same steps on DataFrames; both give the same weights.

Topics are rules on the text: ``legal`` (licence, license, copyright),
``contact`` (an @ or http), ``listing`` (`` | ``), else ``prose``.

Defined results: a null source or language is the category of the empty string;
a null or empty text has no tokens, topic ``prose``, and is sampled with its
cell's probability (1 in a cell without tokens); a null doc_id draws as the
empty string; rows that share a doc_id draw alike; an empty table gives an
empty table; other columns pass through keep_mixed and are not read otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import map_batches, table, written

DIMS = ("source", "lang", "topic")
LOCAL_CELLS = 100_000


@dataclass(frozen=True)
class MixParams:
    temper: float = 0.9
    sweeps: int = 40
    seed: str = "mix"
    #: Target shares by dimension, in place of tempered ones; categories left out get none.
    targets: dict[str, dict[str, float]] = field(default_factory=dict)


def topic(text) -> F.Column:
    low = F.lower(text)
    has = lambda *words: F.coalesce(F.greatest(F.lit(False), *(F.contains(low, F.lit(w)) for w in words)), F.lit(False))
    return F.when(has("licence", "license", "copyright"), "legal").when(has("@", "http"), "contact").when(has(" | "), "listing").otherwise("prose")


def tokens_by_document(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens (words between white space)."""
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        topic(F.col("text").cast("string")).alias("topic"), F.col("text").cast("string").alias("text"),
    )

    def run(b: pa.RecordBatch):
        counts = []
        for c in K.chunks(b.column(4)):
            m = K.SPACE_WORD[c.buf]
            begins = m.copy()
            begins[1:] &= ~m[:-1]
            at = c.offs[:-1][np.diff(c.offs) > 0]
            begins[at] = m[at]
            counts.append(c.per_row(begins))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.concatenate(counts))], names=["doc_id", *DIMS, "n_tokens"])

    return map_batches(d, run, "doc_id long, source string, lang string, topic string, n_tokens long")


def _targets(cells: DataFrame, dim: str, p: MixParams) -> DataFrame:
    """(dim, target): shares that sum to 1 over the categories with tokens."""
    marginal = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).filter("t > 0")
    if dim in p.targets:
        given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in p.targets[dim].items()], f"{dim} string, raw double")
        marginal = marginal.join(given, dim, "left").select(dim, F.coalesce("raw", F.lit(0.0)).alias("raw"))
    else:
        marginal = marginal.select(dim, F.pow("t", F.lit(p.temper)).alias("raw"))
    total = marginal.agg(F.sum("raw")).first()[0] or 1.0
    return marginal.select(dim, (F.col("raw") / F.lit(total)).alias("target"))


def rake_local(cells: DataFrame, p: MixParams) -> DataFrame:
    c = cells.toPandas()
    w = c["tokens"].to_numpy(float)
    w = w / max(w.sum(), 1.0)
    fits = []
    for dim in DIMS:
        t = _targets(cells, dim, p).toPandas().set_index(dim)["target"]
        names, at = np.unique(c[dim].to_numpy(str), return_inverse=True)
        fits.append((at, t.reindex(names).fillna(0.0).to_numpy()))
    for _ in range(p.sweeps):
        for at, target in fits:
            now = np.bincount(at, w, len(target)).astype(float)
            w = w * np.divide(target, now, out=np.zeros_like(now), where=now > 0)[at]
    c["weight"] = w
    return cells.sparkSession.createDataFrame(c[[*DIMS, "weight"]], "source string, lang string, topic string, weight double")


def rake_distributed(cells: DataFrame, p: MixParams) -> DataFrame:
    targets = {dim: written(_targets(cells, dim, p), "targets") for dim in DIMS}
    total = max(cells.agg(F.sum("tokens")).first()[0] or 1, 1)
    w = cells.select(*DIMS, (F.col("tokens") / F.lit(float(total))).alias("weight"))
    for _ in range(p.sweeps):
        for dim in DIMS:
            now = w.groupBy(dim).agg(F.sum("weight").alias("now")).join(targets[dim], dim, "left")
            now = now.select(dim, F.coalesce(F.try_divide("target", "now"), F.lit(0.0)).alias("by"))
            w = w.join(now, dim).select(*DIMS, (F.col("weight") * F.col("by")).alias("weight"))
        w = written(w, "weights")
    return w


def calibrated(tokens: DataFrame, p: MixParams = MixParams(), local_cells: int = LOCAL_CELLS) -> DataFrame:
    """source, lang, topic, tokens, weight (raked share), p (probability of a document of the cell)."""
    cells = written(tokens.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    weights = (rake_local if cells.count() <= local_cells else rake_distributed)(cells, p)
    both = written(cells.join(weights, list(DIMS)), "raked")
    most = both.agg(F.max(F.try_divide("weight", "tokens"))).first()[0] or 1.0
    ratio = F.try_divide("weight", "tokens") / F.lit(most)
    return both.select(*DIMS, "tokens", "weight", F.when(F.col("tokens") == 0, 1.0).otherwise(F.round(F.coalesce(ratio, F.lit(1.0)), 9)).alias("p"))


def draw(doc_id, seed: str) -> F.Column:
    """Uniform in [0, 1) from a hash of doc_id."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix_documents(docs: DataFrame, p: MixParams = MixParams(), local_cells: int = LOCAL_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, p, sampled for every row of docs."""
    tokens = written(tokens_by_document(docs), "tokens")
    cells = calibrated(tokens, p, local_cells).select(*DIMS, "p")
    return tokens.join(cells, list(DIMS)).select("doc_id", *DIMS, "n_tokens", F.round("p", 6).alias("p"), (draw(F.col("doc_id"), p.seed) < F.col("p")).alias("sampled"))


def keep_mixed(docs: DataFrame, p: MixParams = MixParams(), local_cells: int = LOCAL_CELLS) -> DataFrame:
    """Docs' own columns, sampled rows only."""
    cells = calibrated(tokens_by_document(docs), p, local_cells)
    names = {dim: f"__cell_{dim}" for dim in DIMS}
    key = {"source": F.coalesce(F.col("source").cast("string"), F.lit("")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "topic": topic(F.col("text").cast("string"))}
    d = docs.withColumns({names[k]: v for k, v in key.items()})
    cells = cells.select(*(F.col(k).alias(v) for k, v in names.items()), F.col("p").alias("__cell_p"))
    return d.join(cells, list(names.values())).filter(draw(F.col("doc_id"), p.seed) < F.col("__cell_p")).select(*docs.columns)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def cte_sql(docs: str = "documents", pre: str = "", p: MixParams = MixParams()) -> str:
    """DuckDB: CTEs (of a recursive with) giving {pre}mixed(doc_id, ..., p, sampled)."""
    has = lambda *words: " or ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words)
    dims = ", ".join(DIMS)
    targets = "".join(f",\n{pre}t_{d} as (select {d}, pow(sum(tokens), {p.temper}) / sum(pow(sum(tokens), {p.temper})) over () as t_{d} from {pre}cells group by {d} having sum(tokens) > 0)" for d in DIMS)
    step, last = f"(select r.*, {', '.join(f't_{d}' for d in DIMS)} from {pre}rake r left join {pre}t_source using (source) left join {pre}t_lang using (lang) left join {pre}t_topic using (topic))", "w"
    for d in DIMS:
        step = f"(select *, coalesce(w{d[0]}.x, 0) as u_{d} from (select *, struct_pack(x := {last} * t_{d} / nullif(sum({last}) over (partition by {d}), 0)) as w{d[0]} from {step}))"
        last = f"u_{d}"
    return f"""
{pre}tokens as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, case when {has("licence", "license", "copyright")} then 'legal' when {has("@", "http")} then 'contact' when {has(" | ")} then 'listing' else 'prose' end as topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens from {docs}),
{pre}cells as (select {dims}, sum(n_tokens) as tokens from {pre}tokens group by all){targets},
{pre}rake as (select 0 as it, {dims}, tokens, tokens::double / sum(tokens) over () as w from {pre}cells union all select it + 1, {dims}, tokens, {last} from {step} where it < {p.sweeps}),
{pre}pc as (select {dims}, case when tokens = 0 then 1.0 else round(coalesce((w / nullif(tokens, 0)) / max(w / nullif(tokens, 0)) over (), 1.0), 9) end as p from {pre}rake where it = {p.sweeps}),
{pre}mixed as (select doc_id, {dims}, n_tokens, round(p, 6) as p, ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{p.seed}'), 1, 12))::bigint / {float(1 << 48)} < p as sampled from {pre}tokens join {pre}pc using ({dims}))"""


def oracle() -> str:
    return f"with recursive {cte_sql().strip()} select * from mixed"
