"""Spans, sentences, hidden Markov tagging, and evaluation measures."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..shipping import ship
from .base import SQL_COUNTS, SQL_LINES, lines, query, read, token_counts

UPPER = "A-ZÇĞİÖŞÜ"
#: Rule taggers: label and pattern.
RULES: list[tuple[str, str]] = [
    ("DATE", r"\d{2}\.\d{2}\.\d{4}"), ("TIME", r"\d{2}:\d{2}(?: [ap]\.m\.)?"), ("WORD", r"[a-zA-ZçğıöşüÇĞİÖŞÜ]+"), ("STOP", r"[?.:!]+"), ("SYM", r"[\^%$#€Â*£=@]"),
    ("MONEY", rf"(?:\d+,\d+\.\d+|\d+\.\d+|\d+)(?:[$€£¥₹₱₺]|Kč|[{UPPER}]+)"), ("SEP", r"_|-|&&|~|¨|'"), ("NUM", r"\d+,\d+\.\d+|\d+"), ("NUM", r"\d+\.\d+"), ("ABBR", rf"(?:[{UPPER}]\.)+"), ("ABBR", rf"[{UPPER}]+"), ("ADJ", r"\d+'?(?:[ıiuü]?nc[ıiuü]|lar|ler\.)"),
]


SPANS = 1 << 16  # spans that a batch holds


def tag_spans(texts: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """id, start, end, label, value of every match of every rule in (id, text)."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(label, re.compile(p)) for label, p in rules]
        for b in batches:
            rows = ((i, m.start(), m.end(), label, m[0]) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for label, p in compiled for m in p.finditer(text or ""))
            while held := list(itertools.islice(rows, SPANS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()))], names=["id", "start", "end", "label", "value"])

    return texts.mapInArrow(run, "id long, start int, end int, label string, value string")


def consume(spans: DataFrame) -> DataFrame:
    """Spans in order of start (longest first) that reach beyond all before them; equal spans keep the least label."""
    order = ["start", F.desc("end"), "label"]
    far = F.max("end").over(Window.partitionBy("id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("__far", far).filter("__far is null or end > __far").drop("__far")


def overlaps(a: str = "a", b: str = "b"):
    """Overlap without containment, either way."""
    c = F.col
    inside = lambda x, y: (c(f"{x}.start") >= c(f"{y}.start")) & (c(f"{x}.end") <= c(f"{y}.end"))
    return (c(f"{a}.start") < c(f"{b}.end")) & (c(f"{b}.start") < c(f"{a}.end")) & ~inside(a, b) & ~inside(b, a)


def group_spans(spans: DataFrame) -> DataFrame:
    """Alternatives by start: the longest span, and one alternative for each label, longest first."""
    one = F.row_number().over(Window.partitionBy("id", "start", "label").orderBy(F.desc("end"), "value"))
    kept = spans.withColumn("__one", one).filter("__one = 1")
    return kept.groupBy("id", "start").agg(F.max("end").alias("end"), F.array_sort(F.collect_list(F.struct("label", "end", "value"))).alias("items"))


@query("rule_tags")
def rule_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumed spans of every document by label. Offsets need a regular-expression engine; a test compares with consume()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(label, re.compile(p)) for label, p in RULES]
        for b in batches:
            for k in range(0, b.num_rows, 256):  # only a document's spans are held, and the counts of 256
                rows = []
                for i, text in zip(b.column(0)[k : k + 256].to_pylist(), b.column(1)[k : k + 256].to_pylist()):
                    found, far = {}, -1
                    for start, end, label in sorted(((m.start(), -m.end(), label) for label, p in compiled for m in p.finditer(text or ""))):
                        if -end > far:
                            n, chars = found.get(label, (0, 0))
                            found[label], far = (n + 1, chars - end - start), -end
                    rows += [(i, label, n, chars) for label, (n, chars) in found.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (b.column(0).type, pa.string(), pa.int64(), pa.int64()))], names=["doc_id", "label", "n", "n_chars"])

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, label string, n long, n_chars long")
    return counts.groupBy("doc_id", "label").agg(F.sum("n").alias("n"), F.sum("n_chars").alias("n_chars"))


_MARK = r"regexp_replace(text, '([.:!?]+[\")\]]?)[\x09-\x0D\x20]+', '\1' || chr(1), 'g')"


@query("sentence_split", f"with s as (select doc_id, list_filter(string_split({_MARK}, chr(1)), lambda x: x <> '') as ss from documents) select doc_id, len(ss)::bigint as n_sentences, coalesce(list_max([length(x) for x in ss]), 0)::bigint as longest, md5(array_to_string(ss, '|')) as split from s")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences end where stops, maybe with a closing mark, are followed by a blank; the rest is a sentence too."""
    marked = F.regexp_replace("text", r"([.:!?]+[\")\]]?)" + X.BLANK + "+", "$1\u0001")
    s = read(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(marked, "\u0001"), lambda x: x != "").alias("ss"))
    return s.select("doc_id", F.size("ss").cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform("ss", F.length)), F.lit(0)).cast("long").alias("longest"), F.md5(F.array_join("ss", "|")).alias("split"))


@query("word_cover", f"with {SQL_COUNTS}, {SQL_LINES}, top as (select tok as word from tc order by cnt desc, tok limit 25), m as (select word, doc_id, line, row_number() over (partition by word order by doc_id, line) as k from ln join top on contains(ln.text, word)) select word, doc_id, line from m where k <= 3")
def word_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three lines that contain each of the 25 most frequent words (a top-k report) as a substring."""
    docs = read(spark, sf_dir, "documents")
    words = [r.tok for r in token_counts(docs).orderBy(F.desc("cnt"), "tok").limit(25).collect()]
    hit = lines(docs).select("doc_id", F.col("line").cast("long").alias("line"), F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.col("text"), w))).alias("word"))
    k = F.row_number().over(Window.partitionBy("word").orderBy("doc_id", "line"))
    return hit.withColumn("k", k).filter("k <= 3").select("word", "doc_id", "line")


@query("islands", "with c as (select *, coalesce(role = lag(role) over (partition by conv_id order by turn), false) as same from conversations), i as (select *, sum((not same)::int) over (partition by conv_id order by turn) as g from c) select conv_id, g::bigint as island, min(role) as role, count(*) as n, min(turn) as first_turn from i group by conv_id, g")
def islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns of one role: gaps and islands, as in tagged files with blank lines between sentences."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumn("new", F.coalesce(F.col("role") != F.lag("role").over(w), F.lit(True)).cast("int"))
    i = c.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("conv_id", "island").agg(F.min("role").alias("role"), F.count("*").alias("n"), F.min("turn").alias("first_turn"))


def observations(conv: DataFrame) -> DataFrame:
    """seq, pos, sym, label: a turn's symbol is its length class, its label the role."""
    n = F.length(F.coalesce("text", F.lit("")))
    return conv.select(F.col("conv_id").alias("seq"), F.col("turn").alias("pos"), F.floor(F.log2(n + 1)).cast("string").alias("sym"), F.col("role").alias("label"))


_OBS = "ob as (select conv_id as seq, turn as pos, floor(log2(length(coalesce(text, '')) + 1))::bigint::varchar as sym, role as label from conversations), em as (select sym, label, count(*) as cnt from ob group by all), tr as (select label as l1, nxt as l2, count(*) as cnt from (select label, lead(label) over (partition by seq order by pos) as nxt from ob) where nxt is not null group by all)"


def hmm_emissions(obs: DataFrame) -> DataFrame:
    return obs.groupBy("sym", "label").agg(F.count("*").alias("cnt"))


def hmm_transitions(obs: DataFrame) -> DataFrame:
    nxt = F.lead("label").over(Window.partitionBy("seq").orderBy("pos"))
    return obs.select(F.col("label").alias("l1"), nxt.alias("l2")).filter("l2 is not null").groupBy("l1", "l2").agg(F.count("*").alias("cnt"))


def smoothed(counts: DataFrame, by: str) -> DataFrame:
    """(cnt + 1) / (cnt + total of the row)."""
    return counts.withColumn("prob", F.round((F.col("cnt") + 1) / (F.col("cnt") + F.sum("cnt").over(Window.partitionBy(by))), 9))


@query("hmm_counts", f"with {_OBS} select 'emit' as kind, sym as x, label as y, cnt, round((cnt + 1) / (cnt + sum(cnt) over (partition by label)), 9) as prob from em union all select 'trans', l1, l2, cnt, round((cnt + 1) / (cnt + sum(cnt) over (partition by l1)), 9) from tr")
def hmm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(read(spark, sf_dir, "conversations"))
    e = smoothed(hmm_emissions(obs), "label").select(F.lit("emit").alias("kind"), F.col("sym").alias("x"), F.col("label").alias("y"), "cnt", "prob")
    return e.union(smoothed(hmm_transitions(obs), "l1").select(F.lit("trans"), "l1", "l2", "cnt", "prob"))


UNSEEN = 1e-11


def viterbi(obs: DataFrame, emit: DataFrame, trans: DataFrame) -> DataFrame:
    """seq, pos, label: least sum of negative logs; ties go to the lesser label. The label tables are small by definition.

    Rows are sorted by sequence within partitions and streamed, a sequence at a time.
    """
    ship(obs.sparkSession)
    e = {(r.sym, r.label): -math.log(r.prob) for r in emit.collect()}
    t = {(r.l1, r.l2): -math.log(r.prob) for r in trans.collect()}
    labels, none = sorted({k[1] for k in e}), -math.log(UNSEEN)

    def decode(syms: list[str]) -> list[str]:
        cost, back = {y: e.get((syms[0], y), none) for y in labels}, []
        for s in syms[1:]:
            step = {y: min((round(cost[x] + t.get((x, y), none), 9), x) for x in labels) for y in labels}
            back.append({y: x for y, (_, x) in step.items()})
            cost = {y: c + e.get((s, y), none) for y, (c, _) in step.items()}
        path = [min(labels, key=lambda y: (round(cost[y], 9), y))]
        for b in reversed(back):
            path.append(b[path[-1]])
        return path[::-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.int64()), pa.array(decode([r[2] for r in held]), pa.string())], names=["seq", "pos", "label"])

        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(3))):
                if held and r[0] != held[-1][0]:
                    yield flush()
                    held = []
                held.append(r)
        if held:
            yield flush()

    return obs.select("seq", "pos", "sym").repartition("seq").sortWithinPartitions("seq", "pos").mapInArrow(run, "seq long, pos long, label string")


@query("hmm_viterbi")
def hmm_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded roles beside the true ones; a test compares with all paths of short sequences."""
    obs = observations(read(spark, sf_dir, "conversations"))
    found = viterbi(obs, smoothed(hmm_emissions(obs), "label"), smoothed(hmm_transitions(obs), "l1"))
    return found.join(obs.select("seq", "pos", F.col("label").alias("actual")), ["seq", "pos"])


def confusion(pairs: DataFrame) -> DataFrame:
    """cls, tp, fp, fn, tn, precision, recall, f1 of (actual, predicted)."""
    cells = pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    both = F.explode(F.array_distinct(F.array("actual", "predicted")))
    total = pairs.count()
    c = cells.select("*", both.alias("cls"))
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    m = c.groupBy("cls").agg(s((F.col("actual") == F.col("cls")) & (F.col("predicted") == F.col("cls"))).alias("tp"), s((F.col("actual") != F.col("cls")) & (F.col("predicted") == F.col("cls"))).alias("fp"), s((F.col("actual") == F.col("cls")) & (F.col("predicted") != F.col("cls"))).alias("fn"))
    m = m.withColumn("tn", F.lit(total) - F.col("tp") - F.col("fp") - F.col("fn"))
    r = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return m.withColumns({"precision": r(F.col("tp"), F.col("tp") + F.col("fp")), "recall": r(F.col("tp"), F.col("tp") + F.col("fn")), "f1": r(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


_PAIRS = "pr as (select l.quality::varchar as actual, case when n_chars >= 400 then '1' else '0' end as predicted, d.source, d.lang from labels l join documents d using (doc_id))"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.when(F.col("n_chars") >= 400, "1").otherwise("0").alias("predicted"))
    return read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("actual")).join(d, "doc_id")


@query("confusion_measures", f"with {_PAIRS}, k as (select distinct unnest([actual, predicted]) as cls from pr), c as (select cls, count(*) filter (actual = cls and predicted = cls) as tp, count(*) filter (actual <> cls and predicted = cls) as fp, count(*) filter (actual = cls and predicted <> cls) as fn, count(*) filter (actual <> cls and predicted <> cls) as tn from pr, k group by cls) select *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from c")
def confusion_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(_pairs(spark, sf_dir))


@query("report_by_group", f"with {_PAIRS}, r as (select source || '-' || lang as classifier, count(*) as n, count(*) filter (actual = predicted) as tp from pr group by all), g as (select unnest(['en', 'fr', 'de', 'es', 'src1']) as grp) select grp, count(*) as n_classifiers, sum(n)::bigint as n, sum(tp)::bigint as tp, round(sum(tp) / sum(n), 6) as accuracy from r join g on contains(classifier, grp) group by grp")
def report_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by classifier, then rolled up to groups by a part of the name."""
    r = _pairs(spark, sf_dir).groupBy(F.concat("source", F.lit("-"), "lang").alias("classifier")).agg(F.count("*").alias("n"), F.sum((F.col("actual") == F.col("predicted")).cast("long")).alias("tp"))
    groups = F.filter(F.array(*map(F.lit, ("en", "fr", "de", "es", "src1"))), lambda g: F.contains(F.col("classifier"), g))
    g = r.select(F.explode(groups).alias("grp"), "n", "tp").groupBy("grp").agg(F.count("*").alias("n_classifiers"), F.sum("n").alias("n"), F.sum("tp").alias("tp"))
    return g.withColumn("accuracy", F.round(F.col("tp") / F.col("n"), 6))
