"""Splitting words into pieces, and the score of a combination of splits.

Segmentation is a function of the token, so it runs on distinct tokens, in chunks
that share the lexicon pieces that stand in them, joined by equality.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..shipping import ship
from ..sources.models import load, save
from . import chunks as C
from .base import SQL_COUNTS, SQL_LEXICON, lexicon, query, read, token_counts

PIECE = 7


def splits(token: str, lex: dict[str, float], longest: int = PIECE, rest: bool = False) -> Iterator[tuple[str, ...]]:
    """All ways to cover the token with lexicon pieces; with rest, a free remainder may follow the last of them."""
    def walk(at: int, path: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        if at == len(token):
            yield path
            return
        for end in range(at + 1, min(at + longest, len(token)) + 1):
            if token[at:end] in lex:
                yield from walk(end, (*path, token[at:end]))
        if rest and path:
            yield (*path, token[at:])

    yield from walk(0, ())


def split_score(pieces: tuple[str, ...], scores: list[float], alpha: float = 0.01) -> float:
    """Mean of the scores, each raised by its piece's share of the rendered split."""
    n = len("#".join(pieces)) + alpha
    return sum(s * math.exp(len(p) / n) for p, s in zip(pieces, scores)) / len(scores) if scores else 0.0


def best_splits(token: str, lex: dict[str, float], top: int = 3) -> list[tuple[tuple[str, ...], float]]:
    """Best splits by the sum of log(1 + share), by dynamic programming over the places of the token.

    Each place keeps its top prefixes (ties by rendered text), which is exact because
    the score adds up. A token without a cover is its own only piece.
    """
    at: list[list[tuple[float, tuple[str, ...]]]] = [[(0.0, ())]] + [[] for _ in token]
    for end in range(1, len(token) + 1):
        found = [(s + math.log1p(lex[token[b:end]]), (*p, token[b:end])) for b in range(max(0, end - PIECE), end) if token[b:end] in lex for s, p in at[b]]
        at[end] = sorted(found, key=lambda x: (-round(x[0], 12), "#".join(x[1])))[:top]
    return [(p, s) for s, p in at[-1]] or [((token,), 0.0)]


def longest_match(token: str, lex: dict[str, float]) -> tuple[str, ...]:
    """Greedy: the longest known piece at every place, unknown letters alone."""
    out, at = [], 0
    while at < len(token):
        end = next((e for e in range(min(at + PIECE, len(token)), at, -1) if token[at:e] in lex), at + 1)
        out.append(token[at:end])
        at = end
    return tuple(out)


def token_splits(tokens: DataFrame, words: DataFrame, top: int = 3) -> DataFrame:
    """tok, rank, split, n_pieces, score, greedy of distinct tokens under a lexicon (word, cnt) of any size."""
    ship(tokens.sparkSession)
    total = words.agg(F.sum("cnt")).first()[0] or 1

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for k, t in enumerate(_tables(batches)):
            at, toks = (TaskContext.get().partitionId() << 24) + k, C.whole(t.column(0))
            parts = sorted({x[i:j] for x in toks.to_pylist() if x for i in range(len(x)) for j in range(i + 1, min(i + PIECE, len(x)) + 1)})
            for tok, word in ((toks, None), (None, pa.array(parts, pa.string()))):
                n = len(word if tok is None else tok)
                yield pa.RecordBatch.from_arrays([pa.array([at] * n, pa.int64()), pa.nulls(n, pa.string()) if tok is None else tok, pa.nulls(n, pa.string()) if word is None else word], names=["chunk", "tok", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in C.each_chunk(batches):
            mine = pc.is_valid(chunk.column("word"))
            known, toks = chunk.filter(mine), chunk.filter(pc.invert(mine)).column("tok")
            lex = {w: c / total for w, c in zip(known.column("word").to_pylist(), known.column("cnt").to_pylist())}
            for i in range(0, len(toks), 4096):
                rows = [(t, k, "#".join(p), len(p), round(s, 9), greedy) for t in toks[i : i + 4096].to_pylist() for greedy in ["#".join(longest_match(t, lex))] for k, (p, s) in enumerate(best_splits(t, lex, top), 1)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.string()))], names=["tok", "rank", "split", "n_pieces", "score", "greedy"])

    held = load(save(tokens.select("tok").mapInArrow(ask, "chunk long, tok string, word string"), "tokens"))
    known = held.filter("word is not null").select("chunk", "word").join(words.select("word", "cnt"), "word").select("chunk", F.lit(None).cast("string").alias("tok"), "word", "cnt")
    own = held.filter("word is null").select("*", F.lit(None).cast("long").alias("cnt"))
    return C.together(held, own.union(known)).mapInArrow(run, "tok string, rank long, split string, n_pieces long, score double, greedy string")


TOKENS = 1 << 15  # tokens that share what they know of the lexicon


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= TOKENS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


@query("lexicon", f"with {SQL_LEXICON} select word, cnt, round(cnt / sum(cnt) over (), 9) as share from lx")
def lexicon_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lexicon(read(spark, sf_dir, "documents"))
    total = lex.agg(F.sum("cnt")).first()[0] or 1
    return lex.withColumn("share", F.round(F.col("cnt") / F.lit(total), 9))


@query("piece_matches", f"with {SQL_LEXICON}, s as (select tok, i, tok[i:i + k] as piece from (select tok, i, unnest(range(0, least(6, length(tok) - i) + 1)) as k from (select tok, unnest(range(1, length(tok) + 1)) as i from tc))) select tok, count(*) as n_pieces, count(*) filter (i = 1) as n_first, sum(length(piece))::bigint as n_letters from s join lx on piece = word group by tok")
def piece_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon pieces standing in each distinct token: substrings joined by equality."""
    docs = read(spark, sf_dir, "documents")
    n = F.length("tok")
    each = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(PIECE), n - i + 1)), lambda k: F.struct(i.alias("i"), F.substring("tok", i, k).alias("word")))))
    s = token_counts(docs).select("tok", F.inline(each))
    return s.join(lexicon(docs).select("word"), "word").groupBy("tok").agg(F.count("*").alias("n_pieces"), F.count(F.when(F.col("i") == 1, 1)).alias("n_first"), F.sum(F.length("word").cast("long")).alias("n_letters"))


@query("token_splits")
def token_splits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best splits of every distinct token, and its greedy one; a test compares with all splits."""
    docs = read(spark, sf_dir, "documents")
    return token_splits(token_counts(docs), lexicon(docs))


VOWELS, CONSONANTS = "aeıioöuü", "bcçdfgğhjklmnprsştvwyzxq"


@query("syllable_inventory", f"with v as (select unnest(string_split('{VOWELS}', '')) as v), c as (select unnest(string_split('{CONSONANTS}', '')) as c), s as (select 'V' as shape, v as syl from v union all select 'VC', v || c from v, c union all select 'CV', c || v from v, c union all select 'CVC', a.c || v || b.c from v, c a, c b union all select 'CCV', a.c || b.c || v from v, c a, c b union all select 'VCC', v || a.c || b.c from v, c a, c b union all select 'CVCC', x.c || v || a.c || b.c from v, c x, c a, c b) select shape, count(*) as n, count(distinct syl) as n_distinct, min(syl) as first, max(syl) as last from s group by shape")
def syllable_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every syllable of seven shapes over 8 vowels and 24 consonants: an array product, a fixed size."""
    letters = {"V": F.array(*map(F.lit, VOWELS)), "C": F.array(*map(F.lit, CONSONANTS))}
    shapes = ("V", "VC", "CV", "CVC", "CCV", "VCC", "CVCC")
    rows = [spark.range(1).select(F.lit(s).alias("shape"), F.explode(F.transform(X.cartesian(F.array(*(letters[x] for x in s))), lambda w: F.array_join(w, ""))).alias("syl")) for s in shapes]
    all_ = rows[0]
    for r in rows[1:]:
        all_ = all_.union(r)
    return all_.groupBy("shape").agg(F.count("*").alias("n"), F.count_distinct("syl").alias("n_distinct"), F.min("syl").alias("first"), F.max("syl").alias("last"))


@query("frequent_stem_split", f"with {SQL_COUNTS}, c as (select tok, n, tok[1:greatest(3, length(tok) - n)] as stem, tok[greatest(3, length(tok) - n) + 1:] as tail from (select tok, unnest([9, 5, 4, 3, 2, 1, 0]) as n from tc)), b as (select c.*, coalesce(t.cnt, 0) as f from c left join tc t on t.tok = c.stem), r as (select *, row_number() over (partition by tok order by length(stem) * f desc, n) as k from b) select tok, stem || '#' || tail as split, length(stem) * f as score from r where k = 1")
def frequent_stem_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each token cut after the stem with the greatest length times frequency; ties go to the smallest cut."""
    counts = token_counts(read(spark, sf_dir, "documents"))
    at = lambda n: F.greatest(F.lit(3), F.length("tok") - n)
    cuts = F.transform(F.array(*map(F.lit, (9, 5, 4, 3, 2, 1, 0))), lambda n: F.struct(n.alias("n"), F.substring("tok", F.lit(1), at(n)).alias("stem"), F.substring("tok", at(n) + 1, F.length("tok")).alias("tail")))
    c = counts.select("tok", F.inline(cuts)).join(counts.select(F.col("tok").alias("stem"), F.col("cnt").alias("f")), "stem", "left")
    score = F.length("stem") * F.coalesce("f", F.lit(0))
    return c.groupBy("tok").agg(F.max_by(F.struct(F.concat("stem", F.lit("#"), "tail").alias("split"), score.alias("score")), F.struct(score, -F.col("n"))).alias("b")).select("tok", "b.split", "b.score")


A, B = 0.85, 0.15


def mean_link(before: tuple[str, ...], after: tuple[str, ...], bucket: str, links: dict, memo: dict) -> float:
    key = before, after, bucket
    if key not in memo:
        memo[key] = sum(links.get((x, y, bucket), 0.0) for x in before for y in after) / (len(before) * len(after))
    return memo[key]


def combination_score(combo: list[tuple[tuple[str, ...], float]], links: dict, iterations: int = 3, memo: dict | None = None) -> float:
    """Closed form of the damped passes: a place's score after m passes is r^m s0 + b F (1 - r^m) / (1 - r), r = a^i."""
    total, memo = 0.0, {} if memo is None else memo
    for i, (pieces, start) in enumerate(combo):
        if not i:
            total += start
            continue
        inflow = 0.0
        for k in range(i):
            bucket = "dist" if i - k >= 5 else "neig" if i - k > 2 else "loc"
            inflow += A ** (i - 1 - k) * mean_link(combo[k][0], pieces, bucket, links, memo)
        r = A**i
        total += r**iterations * start + B * inflow * (1 - r**iterations) / (1 - r)
    return total
