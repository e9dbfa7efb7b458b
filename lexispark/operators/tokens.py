"""Queries over the text functions: normalisation, masking, tokenising, stems and pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .base import SQL_COUNTS, SQL_SENTENCES, TOKS, lines, query, read, sentences, token_counts

_MASK = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c},
 '(?:\d+[-/.\\]\d+[-/.\\]?)+', ' NUM ', 'g'), '(?:\d+[-/.\\][\x09-\x0D\x20]\d+[\x09-\x0D\x20][-/.\\]?)+', ' NUM ', 'g'), '[(\[{{"<`]', ' OPEN ', 'g'), '[)\]}}>]', ' CLOSE ', 'g'), '\d+', ' NUM ', 'g'), '_|-|&&|~|¨|''|\|\|,;', ' - ', 'g')"""
_LEX = "(" + "|".join(X.LEXER.values()).replace("'", "''") + ")"


@query("token_pipeline", f"with d as (select doc_id, {TOKS.format(c='text')} as toks from documents) select doc_id, len(toks)::bigint as n_tokens, len(list_distinct(toks))::bigint as n_distinct from d")
def token_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", X.letter_tokens(F.col("text")).alias("toks"))
    return d.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), F.size(F.array_distinct("toks")).cast("long").alias("n_distinct"))


@query("turkish_lower", "select doc_id, md5(lower(translate(text, 'Iİ', 'ıi'))) as lowered from documents")
def turkish_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.turkish_lower(F.col("text"))).alias("lowered"))


@query("mask_symbols", f"select doc_id, md5(regexp_replace(regexp_replace({_MASK.format(c='text')}, '[\\x09-\\x0D\\x20]+', ' ', 'g'), '^ | $', '', 'g')) as masked from documents")
def mask_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(X.squeeze(X.mask_symbols(F.col("text")))).alias("masked"))


@query("lexer_tokens", f"with l as (select doc_id, regexp_extract_all({_MASK.format(c='text')}, '{_LEX}') as t from documents) select doc_id, len(t)::bigint as n_tokens, md5(array_to_string(t, ' ')) as tokens from l")
def lexer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", X.lex(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"))


def _fix_sql(c: str) -> str:
    b = r"[\x09-\x0D\x20]"
    for p, t in ((r"([:.!?]+)([\"''\p{L}])", r"\1 \2"), (r"([:.!?]+)" + b + r"+\d+$", r"\1"), ("”", '"'), (r"([:.!?]+)" + b + r"+(\[\d+\])", r"\2 \1"), (r"\d+\.\d+(?:,\d+)?", "000.00"), (r"\d+", "000"), (r"\d+\.\d+", "00.00"), (r"\d+:\d+", "00:00"), (r"\d+\.\d+\.\d+", "00.00.00")):
        c = f"regexp_replace({c}, '{p}', '{t}', 'g')"
    return c


_QUOTE = """case when (length({c}) - length(replace({c}, '"', ''))) % 2 = 1 then {c} || '"' else {c} end"""


@query(
    "fix_sentence",
    f"""with d as (select doc_id, string_split(text, chr(10)) as ls from documents), l as (select doc_id, generate_subscripts(ls, 1) as k, unnest(ls) as x from d),
a as (select doc_id, k, {_fix_sql("x")} as x from l), b as (select doc_id, k, {_QUOTE.format(c="x")} as x from a), c as (select doc_id, k, reverse(regexp_replace(x, '"[\\x09-\\x0D\\x20]+"', '"', 'g')) as x from b),
e as (select doc_id, k, reverse({_QUOTE.format(c="x")}) as x from c) select doc_id, k - 1 as line, md5(regexp_replace(x, '[\\x09-\\x0D\\x20]+', ' ', 'g')) as fixed, md5(regexp_replace(x, '\\d', '0', 'g')) as zeroed from e""",
)
def fix_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = lines(read(spark, sf_dir, "documents"))
    whole = F.reverse(X.close_quote(F.reverse(F.regexp_replace(X.close_quote(X.fix_punctuation(F.col("text"))), '"' + X.BLANK + '+"', '"'))))
    return x.select("doc_id", F.col("line").cast("long").alias("line"), F.md5(X.fix_sentence(F.col("text"))).alias("fixed"), F.md5(X.digits_to_zero(whole)).alias("zeroed"))


def _distinct_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents")).select("tok")


@query("stem_partitions", f"with {SQL_COUNTS} select tok, array_to_string(list_distinct([case when i < length(tok) then tok[1:i] || '#' || tok[i + 1:] else tok end for i in range(least(5, length(tok)), length(tok) + 1)]).list_sort(), ' ') as parts from tc")
def stem_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_tokens(spark, sf_dir).select("tok", F.array_join(F.array_sort(X.stem_partitions(F.col("tok"))), " ").alias("parts"))


@query("stem_cuts", f"with {SQL_COUNTS} select tok, array_to_string(list_sort(list_distinct([tok[1:greatest(3, length(tok) - n)] || '#' || tok[greatest(3, length(tok) - n) + 1:] for n in [9, 5, 4, 3, 2, 1, 0]])), ' ') as cuts from tc")
def stem_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_tokens(spark, sf_dir).select("tok", F.array_join(F.array_sort(X.stem_cuts(F.col("tok"))), " ").alias("cuts"))


_GRAMS = " || ".join(f"[tok[i + j + 1:i + j + {n}] for j in range(0, greatest(length(tok) - i - {n}, 0) + 1)]" for n in (3, 4, 5, 6))


@query("suffix_grams", f"with {SQL_COUNTS} select tok, array_to_string(list_filter(flatten([[tok[1:i]] || {_GRAMS} for i in range(1, greatest(length(tok) - 1, 1) + 1)]), lambda x: x <> ''), ' ') as grams from tc")
def suffix_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_tokens(spark, sf_dir).select("tok", F.array_join(X.suffix_grams(F.col("tok")), " ").alias("grams"))


@query("char_tokens", f"with {SQL_COUNTS} select tok, array_to_string(string_split(tok, '') || ['#'], ' ') as chars, array_to_string([tok[i:i + 4] for i in range(1, greatest(length(tok) - 5, 0) + 2)], ' ') as grams from tc")
def char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _distinct_tokens(spark, sf_dir).select("tok", F.array_join(X.characters(F.col("tok")), " ").alias("chars"), F.array_join(X.char_grams(F.col("tok"), 5), " ").alias("grams"))


def _forms_sql() -> str:
    cons = "[^aeıioöuü]*"
    rules = ((f"([aı]{cons})E$", r"\1ı"), (f"([aıou]{cons})E$", r"\1a"), (f"([ei]{cons})E$", r"\1i"), (f"([eiöü]{cons})E$", r"\1e"), (f"([öü]{cons})E$", r"\1ü"), (f"([ou]{cons})E$", r"\1u"), ("K$", "ğ"), ("K$", "k"), ("T$", "d"), ("T$", "t"))
    return "[" + ", ".join(f"regexp_replace(w, '{p}', '{t}', 'g')" for p, t in rules) + "]"


@query(
    "surface_forms",
    f"with {SQL_COUNTS}, e as (select tok, unnest([tok || 'E', tok || 'K', tok || 'T', tok || 'lE$']) as entry from tc), b as (select tok, entry, regexp_replace(entry, '[&$~_]', '', 'g') as w from e) select tok, entry, array_to_string(list_sort(list_distinct(list_filter({_forms_sql()}, lambda x: not regexp_matches(x, '[ETK]$')))), ' ') as forms from b",
)
def surface_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tok")
    e = _distinct_tokens(spark, sf_dir).select("tok", F.explode(F.array(F.concat(t, F.lit("E")), F.concat(t, F.lit("K")), F.concat(t, F.lit("T")), F.concat(t, F.lit("lE$")))).alias("entry"))
    return e.select("tok", "entry", F.array_join(F.array_sort(X.surface_forms(F.col("entry"))), " ").alias("forms"))


def _clean_sql(c: str) -> str:
    for p, t in (("[&$~_]", ""), ("([aıou][^aeıioöuü]*)E$", r"\1a"), ("([eiöü][^aeıioöuü]*)E$", r"\1e"), ("K$", "k"), ("T$", "t")):
        c = f"regexp_replace({c}, '{p}', '{t}', 'g')"
    return c


@query("clean_entries", f"with {SQL_COUNTS} select tok, {_clean_sql("'~' || tok || 'lET&$'")} as cleaned, {_clean_sql("tok || 'E'")} as vowel, regexp_replace(tok || 'ağ', '([^aeıioöuü][aeıioöuü])ğ$', '\\1k', 'g') as hardened from tc")
def clean_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, at = F.col("tok"), lambda *p: F.concat(*p)
    return _distinct_tokens(spark, sf_dir).select("tok", X.clean_entry(at(F.lit("~"), t, F.lit("lET&$"))).alias("cleaned"), X.clean_entry(at(t, F.lit("E"))).alias("vowel"), X.harden(at(t, F.lit("ağ"))).alias("hardened"))


@query("padded_windows", f"with {SQL_SENTENCES} select doc_id, line, md5(array_to_string(list_resize([]::varchar[], greatest(20 - len(toks), 0), 'zero') || toks[1:20], ' ')) as padded from se")
def padded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(read(spark, sf_dir, "documents")).select("doc_id", F.col("line").cast("long").alias("line"), F.md5(F.array_join(X.left_pad(F.col("toks"), 20), " ")).alias("padded"))


@query("sentence_filters", "with l as (select doc_id, generate_subscripts(ls, 1) - 1 as line, unnest(ls) as x from (select doc_id, string_split(text, chr(10)) as ls from documents)), w as (select *, list_filter(regexp_split_to_array(x, '[\\x09-\\x0D\\x20]+'), lambda y: y <> '') as ws from l) select doc_id, count(*) filter (length(x) between 70 and 300) as n_mid, count(*) filter (len(list_filter(ws, lambda y: length(y) > 25)) = 0) as n_valid, count(*) filter (len(ws) > 0 and list_sum([length(y) for y in ws]) // len(ws) < 20) as n_short_words, sum(len(list_filter(ws, lambda y: regexp_matches(y, '^\\p{Ll}'))))::bigint as n_lower from w group by doc_id")
def sentence_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lines(read(spark, sf_dir, "documents")).withColumn("ws", X.blank_tokens(F.col("text")))
    total = F.aggregate("ws", F.lit(0), lambda a, x: a + F.length(x))
    n = lambda c: F.count(F.when(c, 1))
    return w.groupBy("doc_id").agg(
        n(F.length("text").between(70, 300)).alias("n_mid"), n(~F.exists("ws", lambda x: F.length(x) > 25)).alias("n_valid"),
        n((F.size("ws") > 0) & (F.floor(F.try_divide(total, F.size("ws"))) < 20)).alias("n_short_words"), F.sum(F.size(F.filter("ws", lambda x: x.rlike(r"^\p{Ll}"))).cast("long")).alias("n_lower"),
    )


@query("vocabulary", "select distinct w as word from (select unnest(regexp_split_to_array(text, '[\\x09-\\x0D\\x20]+')) as w from documents) where regexp_matches(w, '^\\p{Ll}')")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.explode(X.blank_tokens(F.col("text"))).alias("word")).filter(F.col("word").rlike(r"^\p{Ll}")).distinct()


_ALTS = "[list_distinct([t[1:greatest(3, length(t) - n)] || '#' || t[greatest(3, length(t) - n) + 1:] for n in [4, 2, 0]]) for t in win]"


@query("alternative_products", f"with {SQL_SENTENCES}, w as (select doc_id, line, unnest([toks[i:i + 1] for i in range(1, greatest(len(toks) - 1, 1) + 1)]) as win from se), a as (select doc_id, line, {_ALTS} as alts from w) select doc_id, line, count(*) as n_windows, sum(list_product([len(x) for x in alts]))::bigint as n_choices from a group by doc_id, line")
def alternative_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of two tokens and the choices of one cut a token: a token's cuts are as many as their places, so no choice is formed."""
    s = sentences(read(spark, sf_dir, "documents"))
    n = F.transform("toks", lambda t: F.size(F.array_distinct(F.transform(F.array(*map(F.lit, (4, 2, 0))), lambda k: F.greatest(F.lit(3), F.length(t) - k)))).cast("long"))
    w = s.select("doc_id", F.col("line").cast("long").alias("line"), n.alias("n"))
    pairs = F.zip_with(F.slice("n", F.lit(1), F.size("n") - 1), F.slice("n", F.lit(2), F.size("n") - 1), lambda x, y: x * y)
    w = w.withColumn("n", F.when(F.size("n") > 1, pairs).otherwise(F.col("n")))
    return w.groupBy("doc_id", "line").agg(F.sum(F.size("n").cast("long")).alias("n_windows"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda acc, x: acc + x)).alias("n_choices"))
