"""Counting operators: n-grams, tries, links, skips, co-occurrence, collocations; merge, normalise and prune.

Neighbours are generated inside the row from the token array, so the only
shuffle is the aggregation's, behind a partial aggregate. Shares are ratios to
a window total over already aggregated rows; pruning is a ranked window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.models import load, save
from .base import SQL_COUNTS, SQL_LEXICON, SQL_SENTENCES, SQL_TOKENS, lexicon, query, read, sentences, token_counts, token_lists
from .chunks import counted, first_places, grams, nearness, neighbours, prefixes, rare_pairs, runs

START, END = "<s>", "</s>"


def normalise(counts: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """Share of each row in its parent's total; totals are aggregated and joined, so a hot parent's rows stay spread."""
    totals = counts.groupBy(*by).agg(F.sum("cnt").alias("__total"))
    return counts.join(totals, by).withColumn("score", F.round(F.col("cnt") / F.col("__total"), digits)).select(*counts.columns, "score")


def prune(scored: DataFrame, by: str, n: int, ties: list[str], exempt: tuple[str, ...] = ()) -> DataFrame:
    """The n best rows of each source; exempt sources keep all. Only n rows of a source and task are shuffled for it."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cnt"), *ties))
    free = F.col(by).isin(*exempt) if exempt else F.lit(False)
    kept = scored.filter(~free).withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")
    return kept.union(scored.filter(free)) if exempt else kept


def merge(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Counts of several models added up."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*keys).agg(F.sum("cnt").alias("cnt"))


def ngram_counts(sents: DataFrame, longest: int = 2, least: int = 1, window: int = 0) -> DataFrame:
    """ngram, cnt of runs of up to three tokens; with a window, counted in every window of a line that holds them."""
    g = counted(sents, grams(longest, window), [""], least=least)
    return g.select(F.when(F.col("dst") == "", F.col("src")).otherwise(F.concat("src", F.lit(" "), "dst")).alias("ngram"), "cnt")


@query("word_ngram_freq", f"with {SQL_SENTENCES}, g as (select unnest(toks || [toks[i] || ' ' || toks[i + 1] for i in range(1, len(toks))]) as ngram from se) select ngram, count(*) as cnt from g group by ngram having count(*) > 2")
def word_ngram_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_counts(token_lists(read(spark, sf_dir, "documents")), least=3)


def binned(counts: DataFrame, bins: int = 100_000) -> DataFrame:
    """Equal-width bin of each count, fractional, from 1. One pair of extremes, no global window."""
    lo, hi = counts.agg(F.min("cnt"), F.max("cnt")).first()
    step = ((hi or 0) - (lo or 0)) / bins or None
    return counts.withColumn("bin", F.round(F.try_divide(F.col("cnt"), F.lit(step).cast("double")) + 1, 6))


@query("binned_freq", f"with {SQL_COUNTS}, x as (select min(cnt) as lo, max(cnt) as hi from tc) select tok, cnt, round(cnt / nullif((hi - lo) / 100000.0::double, 0) + 1, 6) as bin from tc, x")
def binned_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned(token_counts(read(spark, sf_dir, "documents")))


@query("nested_window_grams", f"with {SQL_SENTENCES}, w as (select unnest([toks[i:i + 3] for i in range(1, greatest(len(toks) - 3, 1) + 1)]) as win from se), g as (select unnest(win || [win[i] || ' ' || win[i + 1] for i in range(1, len(win))] || [win[i] || ' ' || win[i + 1] || ' ' || win[i + 2] for i in range(1, len(win) - 1)]) as ngram from w) select ngram, count(*) as cnt from g group by ngram having count(*) > 4")
def nested_window_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_counts(token_lists(read(spark, sf_dir, "documents")), 3, 5, 4)


def trie_edges(paths: DataFrame) -> DataFrame:
    """parent, sym, cnt over the prefixes of an array column: inserting n paths counts n at the root."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.struct(F.array_join(F.slice("path", 1, i - 1), " ").alias("parent"), F.element_at("path", i).alias("sym")))
    return paths.filter(F.size("path") > 0).select(F.inline(steps)).groupBy("parent", "sym").agg(F.count("*").alias("cnt"))


_SLIDES = "w as (select unnest([toks[i:i + 2] for i in range(1, greatest(len(toks) - 2, 1) + 1)]) as win from se), p as (select array_to_string(win[1:i - 1], ' ') as parent, win[i] as sym from (select win, unnest(range(1, len(win) + 1)) as i from w))"


@query("prefix_counts", f"with {SQL_SENTENCES}, {_SLIDES}, c as (select parent, sym, count(*) as cnt from p group by all) select parent, sym, cnt, round(cnt / sum(cnt) over (partition by parent), 9) as score from c")
def prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges below the root are counted by chunks; those of the root, the one parent of all tokens, apart."""
    s = token_lists(read(spark, sf_dir, "documents"))
    first = s.select(F.explode(F.slice("toks", F.lit(1), F.greatest(F.size("toks") - 2, F.lit(1)))).alias("sym")).groupBy("sym").agg(F.count("*").alias("cnt"))
    root = normalise(first.select(F.lit("").alias("parent"), "sym", "cnt"), ["parent"])
    return root.union(counted(s, prefixes, [""]).select(F.col("src").alias("parent"), F.col("dst").alias("sym"), "cnt", "score"))


@query("char_trie", f"with {SQL_LEXICON}, p as (select word[1:i - 1] as parent, word[i] as sym, i = length(word) as fin from (select word, unnest(range(1, length(word) + 1)) as i from lx)) select parent, sym, count(*) as cnt, count(*) filter (fin) as n_end from p group by parent, sym")
def char_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("word")
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substring("word", F.lit(1), i - 1).alias("parent"), F.substring("word", i, F.lit(1)).alias("sym"), (i == n).alias("fin")))
    return lexicon(read(spark, sf_dir, "documents")).select(F.inline(steps)).groupBy("parent", "sym").agg(F.count("*").alias("cnt"), F.count(F.when(F.col("fin"), 1)).alias("n_end"))


@query("trie_stats", f"with {SQL_LEXICON}, p as (select word[1:i - 1] as parent, word[i] as sym from (select word, unnest(range(1, length(word) + 1)) as i from lx)), e as (select parent, sym, count(*) as cnt from p group by all) select count(distinct parent) + 1 as states, count(*) as transitions, sum(cnt)::bigint as freq, round(count(*) / (count(distinct parent) + 1.0::double), 6) as per_state, round(sum(ln(cnt)), 4) as logs from e")
def trie_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = char_trie(spark, sf_dir)
    return e.agg((F.count_distinct("parent") + 1).alias("states"), F.count("*").alias("transitions"), F.sum("cnt").alias("freq"), F.round(F.count("*") / (F.count_distinct("parent") + 1), 6).alias("per_state"), F.round(F.sum(F.log("cnt")), 4).alias("logs"))


def pairs_ahead(toks, window: int):
    """Structs (src, dst, d) of every token with those up to window places ahead."""
    n = F.size(toks)

    def at(d: int):
        left = F.greatest(n - d, F.lit(0))
        return F.zip_with(F.slice(toks, F.lit(1), left), F.slice(toks, F.lit(1 + d), left), lambda x, y: F.struct(x.alias("src"), y.alias("dst"), F.lit(d).alias("d")))

    return F.concat(*(at(d) for d in range(1, window + 1)))


_BUCKETS = ["loc", "neig", "dist"]


def _links(sents: DataFrame, window: int = 6, top: int = 0, exempt: tuple[str, ...] = ()) -> DataFrame:
    """src, dst, bucket, cnt and share (score) in the source's total of framed lines; with top, of its best links alone."""
    places = {d: 2 if d >= 5 else 1 if d > 2 else 0 for d in range(1, window + 1)}
    return counted(sents, neighbours(places, 3, START, END), _BUCKETS, top, exempt).select("src", "dst", F.col("kind").alias("bucket"), "cnt", "score")


def link_counts(sents: DataFrame, window: int = 6) -> DataFrame:
    """src, dst, bucket, cnt of ordered tokens within a window; lines are bracketed by START and END."""
    return _links(sents, window).drop("score")


_LINKS = f"f as (select ['{START}'] || toks || ['{END}'] as toks from se), l as (select toks[i] as src, toks[i + d] as dst, case when d >= 5 then 'dist' when d > 2 then 'neig' else 'loc' end as bucket from (select toks, i, unnest(range(1, least(6, len(toks) - i) + 1)) as d from (select toks, unnest(range(1, len(toks))) as i from f))), lc as (select src, dst, bucket, count(*) as cnt from l group by all)"


@query("rank_links", f"with {SQL_SENTENCES}, {_LINKS} select src, dst, bucket, cnt, round(cnt / sum(cnt) over (partition by src), 9) as score from lc")
def rank_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(token_lists(read(spark, sf_dir, "documents")))


@query("rank_links_pruned", f"with {SQL_SENTENCES}, {_LINKS}, r as (select *, row_number() over (partition by src order by cnt desc, dst, bucket) as k from lc) select src, dst, bucket, cnt, round(cnt / sum(cnt) over (partition by src), 9) as score from r where k <= 10 or src in ('{START}', '{END}')")
def rank_links_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(token_lists(read(spark, sf_dir, "documents")), top=10, exempt=(START, END))


@query("pruned_targets", f"with {SQL_SENTENCES}, {_LINKS}, r as (select *, row_number() over (partition by src order by cnt desc, dst, bucket) as k from lc), kept as materialized (select src, dst, bucket, cnt from r where k <= 3) select * from kept where dst in (select src from kept)")
def pruned_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pruning of a graph: edges to states that lost all their own edges go too.

    Every token of a line is followed by another or by END, so it keeps its best edge; END alone has none.
    """
    kept = _links(token_lists(read(spark, sf_dir, "documents")), top=3)
    return kept.filter(F.col("dst") != END).select("src", "dst", "bucket", "cnt")


@query("skip_edges", f"with {SQL_SENTENCES}, s as (select toks[j] as src, toks[i] || '@' || case when i - j > 5 then 'dist' when i - j > 2 then 'neig' else 'loc' end as sym from (select toks, i, unnest(range(greatest(1, i - 6), i)) as j from (select toks, unnest(range(2, len(toks) + 1)) as i from se))) select src, sym, count(*) as cnt from s group by src, sym")
def skip_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = {d: 2 if d >= 6 else 1 if d > 2 else 0 for d in range(1, 7)}
    p = counted(token_lists(read(spark, sf_dir, "documents")), neighbours(places, 3), _BUCKETS)
    return p.select("src", F.concat("dst", F.lit("@"), "kind").alias("sym"), "cnt")


@query("merge_partials", f"with {SQL_COUNTS} select tok, cnt from tc")
def merge_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four models trained on a quarter of the documents each, merged: the same as one."""
    docs = read(spark, sf_dir, "documents").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    return merge([token_counts(docs.filter(F.col("shard") == k)) for k in range(4)], ["tok"])


@query("epoch_shards", "with o as (select doc_id, text, row_number() over (order by doc_id) - 1 as rn from documents) select (rn // 100)::bigint as epoch, count(*) as n, min(doc_id) as first_doc, sum(length(text))::bigint as n_chars from o group by 1")
def epoch_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset and limit by row for every epoch at once. Rows are numbered by partition offsets of a range sort, not in one task."""
    numbered = row_ids(read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")), ["doc_id"]).withColumn("epoch", F.floor(F.col("id") / 100))
    return numbered.groupBy("epoch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.sum("n").cast("long").alias("n_chars"))


@query("vocab_ids", f"with {SQL_TOKENS}, v as (select tok, count(*) as freq, min((doc_id, line, pos)) as fp from tk group by tok) select tok, freq, row_number() over (order by fp) - 1 as id, case when row_number() over (order by freq desc, tok) <= 1000 then row_number() over (order by freq desc, tok) else 0 end as bounded from v")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by first appearance, and ids of the 1000 most frequent, 0 for the rest. Numbered by a sort's partitions."""
    v = first_places(token_lists(read(spark, sf_dir, "documents"))).groupBy("tok").agg(F.sum("freq").alias("freq"), F.min(F.struct("doc_id", "line", "pos")).alias("at"))
    v = load(save(v, "vocabulary"))  # counted once for its ranges, its rows and its most frequent
    top = v.select("tok", "freq").orderBy(F.desc("freq"), "tok").limit(1000)
    top = top.select("tok", F.row_number().over(Window.orderBy(F.desc("freq"), "tok")).cast("long").alias("bounded"))  # 1000 rows
    return row_ids(v, ["at"]).join(F.broadcast(top), "tok", "left").select("tok", "freq", "id", F.coalesce("bounded", F.lit(0)).alias("bounded"))


def row_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """id, 0 and up in the given order: ranges are written, so they can't move, then counted and numbered apart."""
    ranged = load(save(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges"))
    counts = sorted((r[0], r[1]) for r in ranged.groupBy("__part").count().collect())
    offsets, at = [], 0
    for part, n in counts:
        offsets.append((part, at))
        at += n
    o = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part int, __first long")
    k = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__k", k).join(F.broadcast(o), "__part").withColumn("id", F.col("__first") + F.col("__k") - 1).drop("__part", "__first", "__k")


def cooccurrence(sents: DataFrame, window: int = 3) -> DataFrame:
    """w1, w2, x: symmetric counts weighted by 1 / distance, kept as exact sixtieths until the end."""
    once = counted(sents, nearness(window), [""]).select(F.col("src").alias("w1"), F.col("dst").alias("w2"), F.col("cnt").alias("w"))
    x = F.round(F.when(F.col("w1") == F.col("w2"), 2 * F.col("w")).otherwise(F.col("w")) / 60, 6)
    sides = F.when(F.col("w1") == F.col("w2"), F.array(F.struct("w1", "w2"))).otherwise(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w1").alias("w2"))))
    return once.select(F.inline(sides), x.alias("x")).toDF("w1", "w2", "x")


@query("cooccurrence", f"with {SQL_SENTENCES}, p as (select toks[i] as a, toks[i + d] as b, 60 // d as w from (select toks, i, unnest(range(1, least(3, len(toks) - i) + 1)) as d from (select toks, unnest(range(1, len(toks))) as i from se))), u as (select a, b, w from p union all select b, a, w from p) select a as w1, b as w2, round(sum(w) / 60.0::double, 6) as x from u group by a, b")
def cooccurrence_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence(token_lists(read(spark, sf_dir, "documents")))


def collocations(sents: DataFrame) -> DataFrame:
    """w1, w2, f1, f2, joint and 2 joint / (f1 f2) of neighbours."""
    joint = counted(sents, grams(2), [""], own=True).select(F.col("src").alias("w1"), F.col("dst").alias("w2"), F.col("cnt").alias("joint"), F.col("total").alias("f1"))
    single = sents.select(F.explode("toks").alias("w2")).groupBy("w2").agg(F.count("*").alias("f2"))
    out = joint.join(single, "w2")
    return out.withColumn("score", F.round(2 * F.col("joint") / (F.col("f1") * F.col("f2")), 9))


def close_pairs(sents: DataFrame) -> DataFrame:
    """doc_id, line, w1, w2, n and score of neighbours whose collocation score is over 0.5.

    A pair is no more frequent than its rarer token, so that its score is at most 2 over the frequency of the other: both stand three times or less.
    """
    rare = sents.select(F.explode("toks").alias("w")).groupBy("w").agg(F.count("*").alias("f")).filter("f < 4")
    p = rare_pairs(sents, 3)
    for k in ("1", "2"):
        p = p.join(rare.select(F.col("w").alias(f"w{k}"), F.col("f").alias(f"f{k}")), f"w{k}")
    joint = F.sum("n").over(Window.partitionBy("w1", "w2"))  # three at most
    return p.withColumn("score", F.round(2 * joint / (F.col("f1") * F.col("f2")), 9)).filter("score > 0.5").select("doc_id", "line", "w1", "w2", "n", "score")


_COLLOC = "cj as (select toks[i] as w1, toks[i + 1] as w2, count(*) as joint from (select toks, unnest(range(1, len(toks))) as i from se) group by all), cs as (select w, count(*) as f from (select unnest(toks) as w from se) group by w), cc as (select w1, w2, joint, a.f as f1, b.f as f2, round(2 * joint / (a.f * b.f)::double, 9) as score from cj join cs a on a.w = w1 join cs b on b.w = w2)"


@query("collocations", f"with {SQL_SENTENCES}, {_COLLOC} select w1, w2, f1, f2, joint, score from cc")
def collocations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(token_lists(read(spark, sf_dir, "documents"))).select("w1", "w2", "f1", "f2", "joint", "score")


@query("collocation_merges", f"with {SQL_SENTENCES}, {_COLLOC}, p as (select doc_id, line, toks[i] as w1, toks[i + 1] as w2 from (select doc_id, line, toks, unnest(range(1, len(toks))) as i from se)) select doc_id, count(*) as n_pairs, count(*) filter (score > 0.5) as n_joined, count(*) filter (score >= 0.7) as n_strong from p join cc using (w1, w2) group by doc_id")
def collocation_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many neighbours of a document one round of joining would merge."""
    s = sentences(read(spark, sf_dir, "documents"))
    n = s.groupBy("doc_id").agg(F.sum(F.size("toks").cast("long") - 1).alias("n_pairs")).filter("n_pairs > 0")
    j = close_pairs(s).groupBy("doc_id").agg(F.sum("n").alias("n_joined"), F.sum(F.when(F.col("score") >= 0.7, F.col("n")).otherwise(0)).alias("n_strong"))
    return n.join(j, n["doc_id"].eqNullSafe(j["doc_id"]), "left").select(n["doc_id"], "n_pairs", F.coalesce("n_joined", F.lit(0)).alias("n_joined"), F.coalesce("n_strong", F.lit(0)).alias("n_strong"))


@query("graph_density", f"with {SQL_SENTENCES}, a as (select sum(len(toks) * len(toks))::double as e, sum(len(toks))::bigint as n_tokens, count(*) as n_lines from se), v as (select count(distinct t)::double as v from (select unnest(toks) as t from se)) select n_lines, n_tokens, v::bigint as n_distinct, round(n_tokens / n_lines::double, 6) as per_line, round(2 * e / (v * (v - 1)), 9) as density from a, v")
def graph_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges are the squared line lengths, so no pair is ever formed."""
    s = sentences(read(spark, sf_dir, "documents"))
    v = s.select(F.explode("toks").alias("t")).distinct().count()
    n = F.size("toks").cast("double")
    out = s.agg(F.count("*").alias("n_lines"), F.sum(F.size("toks").cast("long")).alias("n_tokens"), F.sum(n * n).alias("e"))
    return out.select("n_lines", "n_tokens", F.lit(v).cast("long").alias("n_distinct"), F.round(F.col("n_tokens") / F.col("n_lines"), 6).alias("per_line"), F.round(F.try_divide(2 * F.col("e"), F.lit(float(v * (v - 1)))), 9).alias("density"))


@query("model_roundtrip", f"with {SQL_SENTENCES}, {_LINKS} select bucket, count(*) as n, sum(cnt)::bigint as total from lc group by bucket")
def model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link model written as Parquet and read again."""
    return load(save(link_counts(token_lists(read(spark, sf_dir, "documents"))), "links")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("cnt").alias("total"))


@query("language_windows", f"with {SQL_SENTENCES}, w as (select unnest([toks[i:i + 4] for i in range(1, len(toks) - 3)]) as win from se where len(toks) >= 5) select array_to_string(win[1:4], ' ') as context, win[5] as label, count(*) as cnt from w group by all having count(*) > 1")
def language_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of a language model: four words and the next, those seen more than once."""
    w = counted(token_lists(read(spark, sf_dir, "documents")), runs(5), [""], least=2).select(F.split("dst", "_").alias("w"), "cnt")
    return w.select(F.array_join(F.slice("w", 1, 4), " ").alias("context"), F.element_at("w", 5).alias("label"), "cnt")


@query("overlap_windows", f"with {SQL_SENTENCES}, w as (select doc_id, line, unnest([toks[i:i + 3] for i in range(1, greatest(len(toks) - 4, 0) + 4, 3)]) as win, len(toks) as n from se) select doc_id, line, count(*) as n_windows, md5(string_agg(array_to_string(win, ' '), '|' order by array_to_string(win, ' '))) as windows from w where len(win) > 0 group by doc_id, line")
def overlap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of four that overlap by one word, the last one maybe shorter."""
    w = sentences(read(spark, sf_dir, "documents")).select("doc_id", F.col("line").cast("long").alias("line"), F.transform(X.sliding(F.col("toks"), 4, 3), lambda x: F.array_join(x, " ")).alias("w"))
    return w.select("doc_id", "line", F.size("w").cast("long").alias("n_windows"), F.md5(F.array_join(F.array_sort("w"), "|")).alias("windows"))
