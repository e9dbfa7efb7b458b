"""Queries counted or looked up by chunks: their SQL on small lines, and plans that form and shuffle no more than they need."""

import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexispark.operators import base, chunks, segment, tagging


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    at, r = str(tmp_path_factory.mktemp("lines")), random.Random(7)
    words = ["ab", "cab", "abc", "bca", "été", "abcabc", "cabab", "bcabcab", "abcabcabcabcab", "ğı"] + ["".join(r.choice("abc") for _ in range(r.randint(3, 12))) for _ in range(40)]
    text = lambda: "\n".join(" ".join(words[int(len(words) * r.random() ** 3)] for _ in range(r.choice((0, 1, 2, 3, 4, 9, 40)))) for _ in range(6))
    rows = [(k, text()) for k in range(40)] + [(50, None), (51, ""), (52, "1 2, 3"), (53, "ab"), (54, "ab cab\n\nab cab.")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, [r.random() - 0.5 for _ in range(4)]) for k in range(8)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


def same_as_sql(spark, at, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    want = c.execute(__spark_entry__.oracle_sql()[name])
    names, rows = [x[0] for x in want.description], want.fetchall()
    got = __spark_entry__.queries()[name](spark, at)
    assert sorted(got.columns) == sorted(names)
    have = Counter(tuple(x) for x in got.select(*names).collect())
    assert have == Counter(rows) and len(rows) > 5 or name == "model_roundtrip" and have == Counter(rows)
    return got


#: Query, and at most so many rows-out-of-a-row steps and shuffles by key in its plan.
LEAN = [
    ("pruned_targets", 1, 1),
    ("rank_links", 1, 1),
    ("rank_links_pruned", 1, 1),
    ("model_roundtrip", 1, 1),
    ("skip_edges", 1, 1),
    ("prefix_counts", 5, 4),
    ("growing_spans", 1, 1),
    ("cooccurrence", 2, 1),
    ("language_windows", 1, 1),
    ("symbol_bigrams", 1, 1),
    ("collocations", 3, 4),
    ("nested_window_grams", 1, 1),
    ("alternative_products", 1, 1),
    ("word_ngram_freq", 1, 1),
    ("piece_prefix_counts", 3, 4),
    ("stem_windows", 3, 3),
    ("piece_rank_links", 3, 4),
    ("collocate", 6, 5),
    ("collocation_merges", 6, 6),
    ("vocab_ids", 0, 3),
    ("path_likelihood", 0, 3),
]


@pytest.mark.parametrize("name, generates, shuffles", LEAN)
def test_lean(spark, lines, name, generates, shuffles):
    plan = same_as_sql(spark, lines, name)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") <= generates and plan.count("Exchange hashpartitioning") <= shuffles, plan


def test_sources_across_batches(monkeypatch):
    """A source's packed rows are added up wherever they are cut, and held entries are distinct."""
    monkeypatch.setattr(chunks, "HELD", 5)
    words = pa.array(list("abcd"))
    r = np.random.default_rng(3)
    want, rows = Counter(), []
    for _ in range(30):
        key, got = np.unique(r.integers(0, 16, 9), return_counts=True)
        for k, n in zip(key, got):
            want["abcd"[k // 4], "abcd"[k % 4]] += int(n)
        rows += list(zip(*(x.to_pylist() for x in chunks.pack(words, key // 4, key % 4, got))))
    rows.sort(key=lambda x: x[0])
    batches = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4]), (pa.string(), pa.binary(), pa.binary()))], names=["src", "tails", "vals"]) for k in range(0, len(rows), 4))
    have = {}
    for e in chunks.by_source(batches, 1):
        for h, t, n in zip(e.head, e.tail, e.n):
            key = e.src[h].as_py(), e.dst[t].as_py().strip()
            assert key not in have
            have[key] = n
    assert have == want


def test_rounded_as_spark(spark):
    rows = [(a, b) for a, b in itertools.product((1, 3, 5, 7, 999), (2, 3, 7, 1024, 2048, 5120, 64000, 16000000, 2000000000))]
    d = spark.createDataFrame(rows, "a long, b long").select("a", "b", F.round(F.col("a") / F.col("b"), 9).alias("r")).collect()
    assert chunks.rounded(np.array([x.a for x in d]), np.array([x.b for x in d])).tolist() == [x.r for x in d]


def test_vectors_meet_chunks(spark, lines):
    """No token of a line is shuffled by its line with a vector of its own."""
    plan = same_as_sql(spark, lines, "phrase_vectors")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" not in plan


def test_rule_tags_hold_a_document(spark, lines, monkeypatch):
    """Counts of consumed spans, none of which is a row: only counts are shuffled."""
    monkeypatch.setattr(tagging, "SPANS", 3)
    texts = spark.createDataFrame([(1, "On 01.02.2024 at 11:52, 5$ or 1,234.50€! A.B. NATO 3'üncü"), (2, None), (3, ""), (4, "x" * 9 + "... 12:30 p.m. & 7_8")], "doc_id long, text string")
    both = spark.read.parquet(f"{lines}/documents.parquet").select("doc_id", "text").filter("doc_id > 4").union(texts)
    both.write.mode("overwrite").parquet(f"{lines}/tags/documents.parquet")
    got = tagging.rule_tags(spark, f"{lines}/tags")
    want = tagging.consume(tagging.tag_spans(both)).groupBy("id", "label").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("c"))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.count() > 5
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_token_splits_by_chunks(spark, lines):
    """Splits as of the whole lexicon; no token meets its substrings as rows of its own."""
    docs = spark.read.parquet(f"{lines}/documents.parquet")
    tokens, words = base.token_counts(docs), base.lexicon(docs)
    lex = {x.word: x.cnt for x in words.collect()}
    lex = {w: n / sum(lex.values()) for w, n in lex.items()}
    d = segment.token_splits(tokens.repartition(3), words)
    got = Counter((x.tok, x.rank, x.split, x.score, x.greedy) for x in d.collect())
    assert lex and got == Counter((x.tok, k, "#".join(p), round(s, 9), "#".join(segment.longest_match(x.tok, lex))) for x in tokens.collect() for k, (p, s) in enumerate(segment.best_splits(x.tok, lex), 1))
    assert "substring" not in d._jdf.queryExecution().executedPlan().toString()
