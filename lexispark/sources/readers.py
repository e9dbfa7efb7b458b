"""Readers of text formats, each with an explicit schema; sources that name models live in models.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .models import load, save

EVALUATION = "intrinsic array<struct<label: string, classifier: string, semeval: string, texts: array<string>, text: array<string>, textA: string, targets: array<string>, filename: string, morphemes: array<string>>>"


def corpus(spark: SparkSession, path: str, shortest: int = 0, longest: int = 1 << 30) -> DataFrame:
    """text: one sentence a line, within a range of lengths."""
    return spark.read.text(path).select(F.col("value").alias("text")).filter(F.length("text").between(shortest, longest))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no, value. Splits are read apart: a line's number is its place in its split and the lines of the file's earlier ones."""
    d = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("id"))
    d = load(save(d, "lines"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = d.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))  # a row a split
    return d.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("id") - F.col("first")).alias("line_no"), "value")


def embeddings_text(spark: SparkSession, path: str, vocabulary: DataFrame | None = None) -> DataFrame:
    """word, vec of a text file: a header is dropped, leading fields that are no numbers are the (maybe long) key.

    With a vocabulary (column word), only its words are kept; of repeated words the last in order stays.
    """
    fields = F.filter(F.split("value", r"[\x09\x20]+"), lambda x: x != "")
    d = spark.read.text(path).select(fields.alias("f"), F.monotonically_increasing_id().alias("at")).filter(F.size("f") > 2)
    first = F.array_position(F.transform("f", lambda x: x.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")), True).cast("int")
    d = d.withColumn("k", first).filter("k > 1")
    d = d.select(F.array_join(F.slice("f", 1, F.col("k") - 1), " ").alias("word"), F.transform(F.slice("f", F.col("k"), F.size("f")), lambda x: x.cast("double")).alias("vec"), "at")
    if vocabulary is not None:
        d = d.withColumn("word", F.lower("word")).join(vocabulary.select("word").distinct(), "word", "left_semi")
    return d.groupBy("word").agg(F.max_by("vec", "at").alias("vec"))


def evaluation_blocks(spark: SparkSession, path: str) -> DataFrame:
    """One row a block of an evaluation file, in the file's order."""
    return spark.read.schema(EVALUATION).json(path, multiLine=True).select(F.posexplode("intrinsic").alias("block", "b")).select("block", "b.*")


def analogy_queries(blocks: DataFrame) -> DataFrame:
    """block, kind (add, mul, order), k, a, b, x, y: similarity pairs against each other, analogies as written, targets in order."""
    pair = lambda x: F.split(F.trim(x), r"\s*[:+]\s*")
    pairs = blocks.filter("label rlike 'similarity' and semeval is not null").select("block", "classifier", F.posexplode("texts").alias("i", "t")).select("block", "classifier", "i", pair("t")[0].alias("w1"), pair("t")[1].alias("w2"))
    other = pairs.select("block", F.col("i").alias("i2"), F.col("w1").alias("x"), F.col("w2").alias("y"))
    semeval = pairs.join(other, "block").filter("w1 <> x").select("block", "classifier", F.col("w1").alias("a"), F.col("w2").alias("b"), "x", "y")
    lines = blocks.filter("label rlike 'analogy' and text is not null").select("block", "classifier", F.explode("text").alias("t"))
    m = lambda i: F.trim(F.regexp_extract("t", r"^(.+?)\s*\+\s*(.+?)\s*=\s*(.+?)\s*\+\s*(.+?)$", i))
    written = lines.select("block", "classifier", m(1).alias("a"), m(2).alias("b"), m(3).alias("x"), m(4).alias("y")).filter("a <> ''")
    kinds = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("k")) for kind in ("add", "mul") for k in (1, 10, 20))))
    both = semeval.union(written).select("*", kinds.alias("q")).select("block", "classifier", "q.kind", "q.k", "a", "b", "x", "y")
    order = blocks.filter("textA is not null").select("block", "classifier", F.lit("order").alias("kind"), F.size("targets").alias("k"), F.col("textA").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("x"), F.explode("targets").alias("y"))
    return both.union(order)


def four_columns(spark: SparkSession, path: str) -> DataFrame:
    """a, b, x, y of a blank-separated analogy file."""
    f = X.blank_tokens(F.col("value"))
    return spark.read.text(path).select(f.alias("f")).filter(F.size("f") == 4).select(*(F.col("f")[i].alias(n) for i, n in enumerate("abxy")))


def lexicon_tsv(spark: SparkSession, path: str) -> DataFrame:
    """word, pos of a tab-separated lexicon, marks removed, Turkish lower case."""
    d = spark.read.csv(path, sep="\t", schema="entry string, marks string, pos string", quote="")
    return d.select(F.trim(X.turkish_lower(X.clean_entry(F.col("entry")))).alias("word"), "pos").filter("word <> ''").distinct()


def phrases(spark: SparkSession, path: str) -> DataFrame:
    """phrase: entries before a colon without infinitive endings, slashes and quotes, with and without what is in brackets; under six words."""
    head = F.regexp_replace(F.regexp_replace(F.element_at(F.split("value", ":"), 1), r"(m[ae]k)\b", ""), "[/\"']", " ")
    bare = F.translate(head, "âÂ", "aA")
    both = F.array(F.regexp_replace(bare, r"[()]", ""), F.regexp_replace(bare, r"\([^)]*\)", ""))
    d = spark.read.text(path).select(F.explode(F.transform(both, X.squeeze)).alias("phrase"))
    return d.filter((F.col("phrase") != "") & (F.size(F.split("phrase", " ")) < 6)).distinct()


def word_list(spark: SparkSession, path: str, label: str) -> DataFrame:
    """form, lemma, label; verbs lose their infinitive ending."""
    lemma = F.regexp_replace("value", "m[ae]k$", "") if label == "Verb" else F.col("value")
    return spark.read.text(path).select(F.col("value").alias("form"), lemma.alias("lemma"), F.lit(label).alias("label")).filter("form <> ''")


def slash_tagged(spark: SparkSession, path: str) -> DataFrame:
    """file, sent, pos, word, tag of lines ``word/tag word/tag``; the last slash divides."""
    d = numbered_lines(spark, path).select("file", F.col("line_no").alias("sent"), F.posexplode(X.blank_tokens(F.col("value"))).alias("pos", "t"))
    return d.select("file", "sent", "pos", F.regexp_extract("t", r"^(.*)/([^/]*)$", 1).alias("word"), F.regexp_extract("t", r"^(.*)/([^/]*)$", 2).alias("tag"))


def _islands(rows: DataFrame, breaks) -> DataFrame:
    w = Window.partitionBy("file").orderBy("line_no")
    return rows.withColumn("sent", F.sum(breaks.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def column_tagged(spark: SparkSession, path: str) -> DataFrame:
    """file, sent, line_no, word, label: a word and a label a line, blank lines between sentences, order kept."""
    d = _islands(numbered_lines(spark, path), F.trim("value") == "")
    f = X.blank_tokens(F.col("value"))
    return d.withColumn("f", f).filter(F.size("f") == 2).select("file", "sent", "line_no", F.col("f")[0].alias("word"), F.col("f")[1].alias("label"))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """file, sent, line_no, form, tag: comments and blank lines divide sentences; ranges and ids with _ are skipped; the last sentence stays."""
    d = _islands(numbered_lines(spark, path), F.col("value").startswith("#") | (F.trim("value") == ""))
    f = F.split("value", "\t")
    return d.withColumn("f", f).filter((F.size("f") >= 4) & ~F.col("value").startswith("#") & ~F.col("f")[0].rlike("[_-]")).select("file", "sent", "line_no", F.col("f")[1].alias("form"), F.col("f")[3].alias("tag"))


def ner_json(spark: SparkSession, path: str) -> DataFrame:
    """text: tokens and tags of JSON lines as ``token/tag token/tag``."""
    d = spark.read.schema("tokens array<string>, tags array<string>").json(path)
    return d.select(F.array_join(F.zip_with("tokens", "tags", lambda a, b: F.concat_ws("/", a, b)), " ").alias("text"))


def sentiment(spark: SparkSession, path: str) -> DataFrame:
    """text, label: lines with a tab, the last field is the label."""
    f = F.split("value", "\t")
    return spark.read.text(path).filter(F.contains("value", F.lit("\t"))).select(F.array_join(F.slice(f, 1, F.size(f) - 1), "\t").alias("text"), F.element_at(f, -1).alias("label"))


def sentiment_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema="text string, label string, extra string").filter("extra is not null")


def morphology(spark: SparkSession, path: str) -> DataFrame:
    """file, sent, pos, ins, outs of tokens ``in:out|in:out``."""
    d = numbered_lines(spark, path).select("file", F.col("line_no").alias("sent"), F.posexplode(X.blank_tokens(F.col("value"))).alias("pos", "t"))
    p = F.transform(F.split("t", r"\|"), lambda x: F.split(x, ":"))
    return d.select("file", "sent", "pos", F.transform(p, lambda x: x[0]).alias("ins"), F.transform(p, lambda x: F.get(x, F.lit(1))).alias("outs"))


def csv_folder(spark: SparkSession, path: str) -> DataFrame:
    """text: the last quoted field of every line of a folder's files, headers left out."""
    d = numbered_lines(spark, path).filter("line_no > 0")
    last = F.element_at(F.split("value", '","'), -1)
    return d.select(F.regexp_replace(last, '"$', "").alias("text"))


def word_pairs(spark: SparkSession, name: str, words: list[str], dictionary: DataFrame) -> DataFrame:
    """name, src, dst, src_vec, dst_vec: a literal list taken two by two, the pairs of which the dictionary (word, v) knows both."""
    d = spark.createDataFrame([(name, a, b) for a, b in zip(words[::2], words[1::2])], "name string, src string, dst string")
    vec = lambda k: dictionary.select(F.col("word").alias(k), F.col("v").alias(f"{k}_vec"))
    return d.join(vec("src"), "src").join(vec("dst"), "dst").select("name", "src", "dst", "src_vec", "dst_vec")


def word_collection(spark: SparkSession, name: str, words: list[str], dictionary: DataFrame) -> DataFrame:
    """name, word, v: the words of a literal list that the dictionary knows."""
    return spark.createDataFrame([(name, w) for w in words], "name string, word string").join(dictionary.select("word", "v"), "word").select("name", "word", "v")
