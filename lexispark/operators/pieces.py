"""Counts, windows and vectors over the pieces that tokens are split into.

Splits are the frequent-stem splits of distinct tokens, joined to the lines by
token of a chunk of lines. Neighbours are counted inside the chunk, and only
packed counts are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..shipping import ship
from . import chunks as C
from .base import SQL_COUNTS, SQL_LEXICON, SQL_TOKENS, lexicon, query, read, sentences, token_counts, token_lists
from .chunks import counted, neighbours
from .segment import PIECE, frequent_stem_split, split_score, splits

_SPLIT = "fs as (select tok, list_filter([stem, tail], x -> x <> '') as ps from (select *, row_number() over (partition by tok order by length(stem) * f desc, n) as k from (select c.*, coalesce(t.cnt, 0) as f from (select tok, n, tok[1:greatest(3, length(tok) - n)] as stem, tok[greatest(3, length(tok) - n) + 1:] as tail from (select tok, unnest([9, 5, 4, 3, 2, 1, 0]) as n from tc)) c left join tc t on t.tok = c.stem)) where k = 1)".replace("x -> x <> ''", "lambda x: x <> ''")
_LINES = f"{SQL_TOKENS}, {SQL_COUNTS}, {_SPLIT}, pl as (select doc_id, line, list(ps order by pos) as pss from tk join fs using (tok) group by doc_id, line), pf as (select doc_id, line, flatten(pss) as toks from pl)"


def token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tok, ps: pieces of the frequent-stem split of every distinct token."""
    return frequent_stem_split(spark, sf_dir).select("tok", F.filter(F.split("split", "#"), lambda x: x != "").alias("ps"))


class PieceLines:
    """Lines of a chunk (doc_id and line are a key), and the pieces of their tokens, as numbers."""

    def __init__(self, t: pa.Table):
        of, self.lines = t.filter(pc.is_valid(t.column("tok"))), t.filter(pc.is_valid(t.column("text")))
        parts = C.whole(of.column("ps"))
        self.codes, self.sizes = C.line_codes(C.whole(self.lines.column("text")), C.whole(of.column("tok")))
        d = parts.flatten().dictionary_encode()
        self.piece, self.pieces = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
        self.size = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size


def over_pieces(spark: SparkSession, sf_dir: str, run, schema: str) -> DataFrame:
    """run() of every chunk's lines; the splits of a chunk's distinct tokens are joined to it, not to every token."""
    held = C.chunked(token_lists(read(spark, sf_dir, "documents")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.each_chunk(batches):
            yield run(PieceLines(t))

    return C.looked_up(held, token_pieces(spark, sf_dir)).mapInArrow(each, schema.replace("ID", dict(held.dtypes)["doc_id"]))


PACKED = "src string, tails binary, vals binary"
ROOTS = 64  # parts of the root, the one parent of all pieces


@query("piece_prefix_counts", f"with {_LINES}, w as (select unnest([toks[i:i + 1] for i in range(1, greatest(len(toks) - 1, 1) + 1)]) as win from pf) select array_to_string(win[1:i - 1], ' ') as parent, win[i] as sym, count(*) as cnt from (select win, unnest(range(1, len(win) + 1)) as i from w) group by all")
def piece_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix counts over windows of two pieces."""

    def run(c: PieceLines) -> pa.RecordBatch:
        seq = c.piece[C.ranges(c.start[c.codes], c.size[c.codes])]
        sizes, n = np.add.reduceat(c.size[c.codes], np.cumsum(c.sizes) - c.sizes), len(c.pieces)
        place = np.arange(len(seq)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key, got = np.unique(C.pair_keys(seq, sizes, 1, n), return_counts=True)
        root, first = np.unique(seq[place < np.repeat(np.maximum(sizes - 1, 1), sizes)], return_counts=True)
        part = np.array([zlib.crc32(x.encode()) % ROOTS for x in c.pieces.take(pa.array(root)).to_pylist()])
        order = np.argsort(part, kind="stable")
        roots = C.pack(c.pieces, part[order], root[order], first[order], pa.array([f"\0{k}" for k in range(ROOTS)]))
        return pa.RecordBatch.from_arrays(C.joined(C.pack(c.pieces, key // n, key % n, got), roots), names=["src", "tails", "vals"])

    got = C.added(over_pieces(spark, sf_dir, run, PACKED), [""])
    return got.select(F.when(F.col("src").startswith("\0"), "").otherwise(F.col("src")).alias("parent"), F.col("dst").alias("sym"), "cnt")


@query("piece_rank_links", f"with {_LINES}, l as (select pss[i] as x, pss[i + d] as y, d from (select pss, i, unnest(range(1, least(3, len(pss) - i) + 1)) as d from (select pss, unnest(range(1, len(pss))) as i from pl))) select src, dst, case when d > 2 then 'neig' else 'loc' end as bucket, count(*) as cnt from (select src, unnest(y) as dst, d from (select unnest(x) as src, y, d from l)) group by all")
def piece_rank_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from every piece of a token to every piece of the next three."""

    def run(c: PieceLines) -> pa.RecordBatch:
        n, m, keys, counts = len(c.size), len(c.pieces), [], []
        for kind, near in enumerate(((1, 2), (3,))):
            two, got = np.unique(np.concatenate([C.pair_keys(c.codes, c.sizes, d, n) for d in near]), return_counts=True)
            x, y = two // n, two % n
            each = c.size[x] * c.size[y]
            i, pair = C.ranges(np.zeros(len(each), np.int64), each), np.repeat(np.arange(len(each)), each)
            a, b = c.piece[c.start[x][pair] + i // c.size[y][pair]], c.piece[c.start[y][pair] + i % c.size[y][pair]]
            keys.append((a * m + b) * 2 + kind)
            counts.append(got[pair])
        key, got = C.summed(np.concatenate(keys), np.concatenate(counts))
        return pa.RecordBatch.from_arrays(C.pack(c.pieces, key // 2 // m, key // 2 % m, got * 2 + key % 2), names=["src", "tails", "vals"])

    return C.added(over_pieces(spark, sf_dir, run, PACKED), ["loc", "neig"]).withColumnRenamed("kind", "bucket")


@query("stem_windows", f"with {_LINES}, w as (select doc_id, line, generate_subscripts(pss, 1) as i, unnest(pss) as ps from pl) select doc_id, line, count(*) as n_windows, md5(string_agg(x, '|' order by win)) as windows from (select doc_id, line, (i - 1) // 5 as win, string_agg(array_to_string(ps, '#'), ' ' order by i) as x from w group by all) group by doc_id, line")
def stem_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent-stem splits in non-overlapping windows of five tokens."""

    def run(c: PieceLines) -> pa.RecordBatch:
        splits = C.rendered(pc.binary_join_element_wise(c.pieces.take(pa.array(c.piece)), "", "#"), c.size)
        either = pa.concat_arrays([pc.binary_join_element_wise(splits, "", x) for x in (" ", "|")])
        place = np.arange(len(c.codes)) - np.repeat(np.cumsum(c.sizes) - c.sizes, c.sizes)
        text = C.rendered(either.take(pa.array(c.codes + len(splits) * (place % 5 == 4))), c.sizes)
        return pa.RecordBatch.from_arrays([C.whole(c.lines.column("doc_id")), C.whole(c.lines.column("line")).cast(pa.int64()), pa.array((c.sizes - 1) // 5 + 1), text], names=["doc_id", "line", "n_windows", "windows"])

    return over_pieces(spark, sf_dir, run, "doc_id ID, line long, n_windows long, windows string").withColumn("windows", F.md5("windows"))


@query("known_pieces", f"with {SQL_LEXICON}, {_SPLIT}, p as (select tok, list_distinct(list_filter(ps, lambda x: length(x) >= 3)) as ps from fs), u as (select tok, unnest(ps) as p from p), k as (select tok, count(*) as n_known from u join lx on word = p group by tok) select tok, array_to_string(list_sort(ps), ' ') as pieces, coalesce(n_known, 0) as n_known, coalesce(n_known, 0) > 0 as any_known from p left join k using (tok)")
def known_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pieces of three letters or more, how many of them are in the lexicon, and whether any is."""
    p = token_pieces(spark, sf_dir).select("tok", F.array_distinct(F.filter("ps", lambda x: F.length(x) >= 3)).alias("ps"))
    k = p.select("tok", F.explode("ps").alias("word")).join(lexicon(read(spark, sf_dir, "documents")), "word").groupBy("tok").agg(F.count("*").alias("n_known"))
    n = F.coalesce("n_known", F.lit(0))
    return p.join(k, "tok", "left").select("tok", F.array_join(F.array_sort("ps"), " ").alias("pieces"), n.alias("n_known"), (n > 0).alias("any_known"))


#: The dictionary of the word-vector operators: the i-th word of the lexicon by frequency has the i-th vector.
_DICT = "dv as (select word, embedding::double[] as v from (select word, row_number() over (order by cnt desc, word) - 1 as id from lx) join embeddings on vec_id = id)"
_FORWARD = f"{_DICT}, pu as (select tok, unnest(list_distinct(list_filter(ps, lambda x: length(x) >= 3))) as word from fs), pd as (select tok, i, avg(v[i]) as x, any_value(n) as n from (select tok, v, count(*) over (partition by tok) as n, unnest(range(1, len(v) + 1)) as i from pu join dv using (word)) group by tok, i), fv as (select tok, list(x order by i) as v, any_value(n) as n from pd group by tok)"


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, v. Only as many words as there are vectors are numbered."""
    vecs = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    last = vecs.agg(F.max("id")).first()[0]
    top = lexicon(read(spark, sf_dir, "documents")).orderBy(F.desc("cnt"), "word").limit((last or 0) + 1)  # later words have no vector
    from .counts import row_ids

    return row_ids(top.withColumn("__cnt", -F.col("cnt")), ["__cnt", "word"]).join(vecs, "id").select("word", "v")


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tok, n_known, v: mean of the vectors of a token's known pieces; null without any."""
    p = token_pieces(spark, sf_dir).select("tok", F.explode(F.array_distinct(F.filter("ps", lambda x: F.length(x) >= 3))).alias("word"))
    got = p.join(dictionary(spark, sf_dir), "word").groupBy("tok").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # a token has two pieces at most
    total = F.aggregate(F.slice("vs", 2, 9), F.col("vs")[0], lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return got.select("tok", F.size("vs").cast("long").alias("n_known"), F.transform(total, lambda x: x / F.size("vs")).alias("v"))


@query("token_vectors", f"with {SQL_LEXICON}, {_SPLIT}, {_FORWARD} select tok, coalesce(n, 0) as n_known, round(coalesce(v[1], 0.0), 6) as first, round(coalesce(sqrt(list_dot_product(v, v)), 0.0), 5) as norm from tc left join fv using (tok)")
def token_vectors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct token's vector from its pieces; the zero vector where none is known."""
    v = token_counts(read(spark, sf_dir, "documents")).select("tok").join(token_vectors(spark, sf_dir), "tok", "left")
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    return v.select("tok", F.coalesce("n_known", F.lit(0)).alias("n_known"), F.round(F.coalesce(F.col("v")[0], F.lit(0.0)), 6).alias("first"), F.round(F.coalesce(F.sqrt(square), F.lit(0.0)), 5).alias("norm"))


@query("phrase_vectors", f"with {SQL_TOKENS}, {SQL_LEXICON}, {_SPLIT}, {_FORWARD}, n as (select doc_id, line, count(*) as n from tk group by all), s as (select doc_id, line, i, sum(c * length(tok) * v[i]) as x from (select doc_id, line, tok, c, v, unnest(range(1, len(v) + 1)) as i from (select doc_id, line, tok, count(*) as c from tk group by all) join fv using (tok)) group by all), g as (select doc_id, line, list(x order by i) as x from s group by all) select doc_id, line, n as n_tokens, round(coalesce(g.x[1], 0.0) / n, 5) as first, round(coalesce(sqrt(list_dot_product(g.x, g.x)), 0.0) / n, 4) as norm from n left join g using (doc_id, line)")
def phrase_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over a line's tokens of their vectors, each weighted by its token's length."""
    docs = read(spark, sf_dir, "documents")
    held, words = C.chunked(token_lists(docs)), dictionary(spark, sf_dir)
    known = token_pieces(spark, sf_dir).select("tok", F.explode(F.array_distinct(F.filter("ps", lambda x: F.length(x) >= 3))).alias("word")).join(words.select("word").distinct(), "word").groupBy("tok").agg(F.collect_list("word").alias("words"))
    void = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kind = dict(held.dtypes)["doc_id"]
    mine = held.filter("tok is not null").select("chunk", "tok").join(known, "tok").select("chunk", void("doc_id", kind), void("line", "int"), void("text", "string"), "tok", "words", void("v", "array<double>"))
    vecs = mine.select("chunk", F.explode("words").alias("tok")).distinct().join(words.withColumnRenamed("word", "tok"), "tok").select("chunk", void("doc_id", kind), void("line", "int"), void("text", "string"), "tok", void("words", "array<string>"), "v")
    lines = held.filter("text is not null").select("*", void("words", "array<string>"), void("v", "array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.each_chunk(batches):
            of, vec, at = (t.filter(pc.is_valid(t.column(c))) for c in ("words", "v", "text"))
            if not at.num_rows:
                continue
            codes, sizes = C.line_codes(C.whole(at.column("text")), C.whole(of.column("tok")))
            v = np.array(C.whole(vec.column("v")).to_pylist(), float).reshape(vec.num_rows, -1)
            names = C.whole(vec.column("tok")).dictionary_encode()
            total, n = np.zeros((len(names.dictionary), v.shape[1])), np.bincount(names.indices.to_numpy(zero_copy_only=False), minlength=len(names.dictionary))
            np.add.at(total, names.indices.to_numpy(zero_copy_only=False), v)
            parts = C.whole(of.column("words"))
            word, tok = pc.index_in(parts.flatten(), value_set=names.dictionary).to_numpy(zero_copy_only=False), np.repeat(np.arange(of.num_rows), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
            mean = np.zeros((of.num_rows + 1, v.shape[1]))  # the last for tokens of no known piece
            np.add.at(mean, tok, total[word])
            mean[:-1] *= (pc.utf8_length(C.whole(of.column("tok"))).to_numpy(zero_copy_only=False) / np.bincount(tok, n[word], of.num_rows))[:, None]
            first, norm, ends, i = np.zeros(len(sizes)), np.zeros(len(sizes)), np.cumsum(sizes), 0
            while i < len(sizes) and v.shape[1]:  # lines of about 65,536 tokens at a time
                j = max(int(np.searchsorted(ends, ends[i] - sizes[i] + (1 << 16))), i + 1)
                x = np.add.reduceat(mean[codes[ends[i] - sizes[i] : ends[j - 1]]], ends[i:j] - sizes[i:j] - (ends[i] - sizes[i]))
                first[i:j], norm[i:j], i = x[:, 0], np.sqrt((x * x).sum(1)), j
            yield pa.RecordBatch.from_arrays([C.whole(at.column("doc_id")), C.whole(at.column("line")).cast(pa.int64()), pa.array(sizes), pa.array(first), pa.array(norm)], names=["doc_id", "line", "n_tokens", "first", "norm"])

    got = C.together(held, lines.union(mine).union(vecs)).mapInArrow(run, f"doc_id {kind}, line long, n_tokens long, first double, norm double")
    return got.select("doc_id", "line", "n_tokens", F.round(F.col("first") / F.col("n_tokens"), 5).alias("first"), F.round(F.col("norm") / F.col("n_tokens"), 4).alias("norm"))


def variants(token: str, lex: dict[str, float], sample: int = 2, top: int = 5) -> dict[str, str]:
    """Renderings of a token's splits: by score a piece, by known pieces, sampled from the best, stem and suffix, and filtered trie splits.

    A free remainder after the last known piece is a piece of its own, as in the
    trie search; samples are taken by a hash of the split, so they repeat.
    """
    import math
    import zlib

    found = [(p, sum(math.log1p(lex[x]) for x in p if x in lex)) for p in splits(token, lex, rest=True)] or [((token,), 0.0)]
    text = lambda p: "#".join(p)
    per = sorted(found, key=lambda x: (-round(x[1] / len(x[0]), 12), text(x[0])))
    entropy = sorted(found, key=lambda x: (-round(x[1] * (sum(y in lex for y in x[0]) + 1) / len(x[0]), 12), text(x[0])))
    pick = lambda rows: sorted((text(p) for p, _ in rows[:top]), key=lambda t: (zlib.crc32(f"17:{t}".encode()), t))[:sample]
    best = min(found, key=lambda x: (-round(x[1], 12), text(x[0])))[0]
    filtered = sorted(found, key=lambda x: (-round(split_score(x[0], [lex[y] for y in x[0] if y in lex]), 12), text(x[0])))
    return {"per_piece": text(per[0][0]), "entropy": text(entropy[0][0]), "sampled": " ".join(pick(per)), "entropy_sampled": " ".join(pick(entropy)), "suffix": best[0] + "#" + "".join(best[1:]), "partition": text(filtered[0][0])}


VARIANTS = ("per_piece", "entropy", "sampled", "entropy_sampled", "suffix", "partition")


@query("split_variants")
def split_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All renderings of variants() for every distinct token; a test compares with all splits."""
    docs = read(spark, sf_dir, "documents")
    words = lexicon(docs)
    total = words.agg(F.sum("cnt")).first()[0] or 1
    n = F.length("tok")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(PIECE), n - i + 1)), lambda k: F.substring("tok", i, k))))
    tokens = token_counts(docs).select("tok")
    known = tokens.select("tok", F.explode(F.array_distinct(parts)).alias("word")).join(words, "word").groupBy("tok").agg(F.collect_list(F.struct("word", "cnt")).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [variants(t, {w["word"]: w["cnt"] / total for w in ws or ()}) for t, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.string()) for k in VARIANTS)], names=["tok", *VARIANTS])

    ship(spark)
    return tokens.join(known, "tok", "left").mapInArrow(run, "tok string, " + ", ".join(f"{k} string" for k in VARIANTS))


@query("collocate", f"with {SQL_TOKENS}, cj as (select w1, w2, count(*) as joint from (select tok as w1, lead(tok) over (partition by doc_id, line order by pos) as w2 from tk) where w2 is not null group by all), cs as (select tok as w, count(*) as f from tk group by tok), ok as (select w1, w2 from cj join cs a on a.w = w1 join cs b on b.w = w2 where round(2 * joint / (a.f * b.f)::double, 9) > 0.5), m as (select doc_id, line, pos, tok, lag(tok) over (partition by doc_id, line order by pos) as prev from tk), g as (select doc_id, line, pos, tok, sum((w1 is null)::int) over (partition by doc_id, line order by pos) as g from m left join ok on w1 = prev and w2 = tok), s as (select doc_id, line, g, count(*) as k, string_agg(tok, '_' order by pos) as span from g group by all) select doc_id, line, count(*) as n_spans, count(*) filter (k > 1) as n_joined, md5(string_agg(span, ' ' order by g)) as spans from s group by doc_id, line")
def collocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with neighbours joined whose collocation score is over 0.5; what is joined is one span."""
    from .counts import close_pairs

    s = sentences(read(spark, sf_dir, "documents"))
    mine = close_pairs(s).groupBy("doc_id", "line").agg(F.collect_set(F.concat_ws(" ", "w1", "w2")).alias("ok"))
    marks = F.zip_with(F.slice("toks", F.lit(1), F.size("toks") - 1), F.slice("toks", F.lit(2), F.size("toks") - 1), lambda x, y: F.array_contains("ok", F.concat_ws(" ", x, y)))
    joined = s.join(mine, s["doc_id"].eqNullSafe(mine["doc_id"]) & (s["line"] == mine["line"]), "left").select(s["doc_id"], s["line"], "toks", "ok").withColumn("marks", F.when(F.col("ok").isNotNull(), marks).otherwise(F.expr("cast(array() as array<boolean>)")))
    n = F.size(F.filter("marks", lambda x: x))
    ends = F.size(F.filter(F.transform("marks", lambda x, i: x & ~((i > 0) & F.element_at("marks", F.greatest(i, F.lit(1))))), lambda x: x))  # each run of marks once
    text = F.array_join(F.transform("toks", lambda t, i: F.concat(F.when(i == 0, "").when(F.coalesce(F.get("marks", i - 1), F.lit(False)), "_").otherwise(" "), t)), "")
    return joined.select("doc_id", F.col("line").cast("long").alias("line"), (F.size("toks") - n).cast("long").alias("n_spans"), ends.cast("long").alias("n_joined"), F.md5(F.when(F.col("ok").isNull(), F.array_join("toks", " ")).otherwise(text)).alias("spans"))


@query("growing_spans", f"with {SQL_TOKENS}, m as (select tok, lead(tok) over w as b, lead(tok, 2) over w as c from tk window w as (partition by doc_id, line order by pos)) select span, count(*) as cnt from (select tok as span from m union all select tok || ' ' || b from m union all select tok || ' ' || b || ' ' || c from m) where span is not null group by span having count(*) > 1")
def growing_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the spans of one to three tokens that begin at every place, those seen more than once."""
    from .counts import ngram_counts

    return ngram_counts(token_lists(read(spark, sf_dir, "documents")), 3, 2).select(F.col("ngram").alias("span"), "cnt")


@query("symbol_bigrams", f"with {SQL_TOKENS}, b as (select coalesce(lag(tok) over (partition by doc_id, line order by pos), '<start>') as s1, tok as s2 from tk) select s1, s2, count(*) as cnt from b group by all")
def symbol_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol bigrams of tagged sequences, the start symbol in front."""
    s = token_lists(read(spark, sf_dir, "documents"))
    return counted(s, neighbours({1: 0}, 1, "<start>"), [""]).select(F.col("src").alias("s1"), F.col("dst").alias("s2"), "cnt")


@query("seeded_sample", "select doc_id, md5(doc_id::varchar || ':17') < '8' as coin, row_number() over (order by md5(doc_id::varchar || ':42'), doc_id) as rank from documents qualify rank <= 100")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 100 documents by a seeded hash, and a seeded coin flip for each."""
    from pyspark.sql import Window

    key = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":42")))
    top = read(spark, sf_dir, "documents").select("doc_id").withColumn("key", key).orderBy("key", "doc_id").limit(100)
    coin = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":17"))) < "8"
    return top.select("doc_id", coin.alias("coin"), F.row_number().over(Window.orderBy("key", "doc_id")).cast("long").alias("rank"))  # 100 rows


@query("universe_report", f"with {SQL_LEXICON}, w as (select lang, unnest(regexp_split_to_array(text, '[\\x09-\\x0D\\x20]+')) as word from documents), u as (select lang, lower(word) as word, count(*) as n from w where regexp_matches(word, '^\\p{{Ll}}+$') group by all) select lang, count(*) as n_words, count(*) filter (x.word is not null) as n_known, round(count(*) filter (x.word is null) / count(*)::double, 6) as oov_rate, round(sum(n) filter (x.word is null) / sum(n)::double, 6) as oov_tokens from u left join lx x using (word) group by lang")
def universe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By language: the words of the universe, how many the dictionary knows, and the shares it doesn't."""
    d = read(spark, sf_dir, "documents")
    u = d.select("lang", F.explode(X.blank_tokens(F.col("text"))).alias("word")).filter(F.col("word").rlike(r"^\p{Ll}+$")).groupBy("lang", F.lower("word").alias("word")).agg(F.count("*").alias("n"))
    j = u.join(lexicon(d).select("word", F.lit(1).alias("known")), "word", "left")
    missing = F.col("known").isNull()
    return j.groupBy("lang").agg(F.count("*").alias("n_words"), F.count("known").alias("n_known"), F.round(F.count(F.when(missing, 1)) / F.count("*"), 6).alias("oov_rate"), F.round(F.sum(F.when(missing, F.col("n"))) / F.sum("n"), 6).alias("oov_tokens"))
