"""Operators against brute force, hand-derived values and invariants."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexispark.operators import counts, decode, models, pieces, segment, tagging, vectors

SPANS = [("w1", 100, 200), ("w2", 150, 165), ("w3", 100, 190), ("w4", 170, 225), ("w5", 190, 220), ("w6", 75, 125)]


def test_consume_and_overlap(spark):
    d = spark.createDataFrame([(1, a, b, n, n) for n, a, b in SPANS], "id long, start int, end int, label string, value string")
    assert [r.label for r in tagging.consume(d).orderBy("start").collect()] == ["w6", "w1", "w4"]
    pairs = {(r.x, r.y) for r in d.alias("a").join(d.alias("b"), tagging.overlaps()).select(F.col("a.label").alias("x"), F.col("b.label").alias("y")).collect()}
    assert ("w3", "w4") in pairs and ("w4", "w3") in pairs and not {("w1", "w2"), ("w2", "w1"), ("w5", "w6"), ("w6", "w5")} & pairs
    assert tagging.group_spans(d).filter("start = 100").first().end == 200


def test_tags(spark):
    d = spark.createDataFrame([(1, "On 01.02.2024 at 11:52, 5$!")], "id long, text string")
    found = {(r.label, r.value) for r in tagging.consume(tagging.tag_spans(d)).collect()}
    assert {("DATE", "01.02.2024"), ("TIME", "11:52"), ("MONEY", "5$"), ("STOP", "!")} <= found


def test_best_splits_match_all_splits():
    r = random.Random(1)
    lex = {"".join(r.choice("ab") for _ in range(r.randint(1, 4))): r.random() for _ in range(9)}
    for _ in range(60):
        t = "".join(r.choice("ab") for _ in range(r.randint(1, 10)))
        every = sorted(((p, sum(math.log1p(lex[x]) for x in p)) for p in segment.splits(t, lex)), key=lambda x: (-round(x[1], 12), "#".join(x[0])))[:3]
        got = segment.best_splits(t, lex)
        assert [p for p, _ in got] == ([p for p, _ in every] or [(t,)]) and all("".join(p) == t for p, _ in got)


def test_split_score_and_remainder():
    assert abs(segment.split_score(("araba", "lar"), [0.5, 0.25]) - 0.6098456887) < 1e-9
    lex = dict.fromkeys(["araba", "lar", "lardan", "dan"], 1.0)
    assert ("araba", "lar", "danı") in set(segment.splits("arabalardanı", lex, rest=True)) and segment.longest_match("arabalardanı", lex) == ("araba", "lardan", "ı")


@pytest.mark.parametrize("passes", [1, 3, 10])
def test_closed_form_is_the_loop(passes):
    r = random.Random(passes)
    combo = [(tuple(r.choice("abc") for _ in range(r.randint(1, 3))), r.random()) for _ in range(6)]
    links = {(x, y, b): r.random() for x in "abc" for y in "abc" for b in ("loc", "neig", "dist")}
    s = [x for _, x in combo]
    for _ in range(passes):
        for i in range(1, 6):
            for k in range(i):
                b = "dist" if i - k >= 5 else "neig" if i - k > 2 else "loc"
                f = [links[x, y, b] for x in combo[k][0] for y in combo[i][0]]
                s[i] = 0.85 * s[i] + 0.15 * sum(f) / len(f)
    assert abs(sum(s) - segment.combination_score(combo, links, passes)) < 1e-12
    lex = {"a": 0.5, "b": 0.2, "ab": 0.1}
    assert "".join(decode.decode_line(["ab", "c", "ab"], {t: segment.best_splits(t, lex, 2) for t in ("ab", "c")}, links, segment.combination_score)) == "abcab"


LINES = ["abra kadabra abra kada bra", "kada bra abra", "bra", "abra kadabra simsala bim bim abra", "bim kada kada bra simsala abra kadabra bim"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("small")
    rows = [(k, "\n".join(LINES[k % 5 :])) for k in range(12)] + [(50, None), (51, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return str(at), [t.split("\n") for _, t in rows if t]


def shares(rows):
    total = collections.Counter()
    for (src, *_), n in rows.items():
        total[src] += n
    return {k: round(n / total[k[0]], 9) for k, n in rows.items()}


def trie(lines):
    c = collections.Counter()
    for t in lines:
        for i in range(max(len(t) - 1, 1)):
            win = t[i : i + 2]
            for j, x in enumerate(win):
                c[" ".join(win[:j]), x, ""] += 1
    return shares(c)


def test_path_likelihood_query(spark, small):
    at, docs = small
    lines = [[line.split() for line in d] for d in docs]
    w = trie([t for d in lines for t in d])
    got = {r.doc_id: r.likelihood for r in models.path_likelihood_query(spark, at).collect()}
    plain = {(a, b): x for (a, b, _), x in w.items()}
    assert got == {k: round(sum(models.path_likelihood(t, plain) for t in d), 5) for k, d in enumerate(lines)}
    assert abs(models.path_likelihood(["a", "b", "c", "d"], {("", "a"): 0.5, ("", "c"): 0.5, ("a", "b"): 1.0, ("b", "c"): 1.0, ("c", "d"): 1.0}) - 2 * (math.log1p(0.5) + math.log1p(1))) < 1e-12


@pytest.mark.parametrize("scorer", ["rank", "path", "skip", "damped"])
def test_decoders_against_collected_models(spark, small, scorer):
    """The joined models give what whole models in one place give."""
    at, docs = small
    lines = [(k, i, line.split()) for k, d in enumerate(docs) for i, line in enumerate(d)]
    count = collections.Counter(t for _, _, ts in lines for t in ts)
    lex = {t: n for t, n in count.items() if n >= 20 and 2 <= len(t) <= 7}
    lex = {t: n / sum(lex.values()) for t, n in lex.items()}
    alts = {t: segment.best_splits(t, lex, 2) for t in count}
    assert any(len(a) > 1 for a in alts.values())
    if scorer == "rank":
        c = collections.Counter()
        for _, _, ts in lines:
            f = ["<s>", *ts, "</s>"]
            c.update((f[i], f[j], decode.bucket(j - i)) for i in range(len(f)) for j in range(i + 1, min(i + 7, len(f))))
    else:
        pieces = [[p for t in ts for p in alts[t][0][0]] for _, _, ts in lines]
        w = trie(pieces)
        c = collections.Counter((f[i], f[j], decode.bucket(j - i)) for f in pieces for i in range(len(f)) for j in range(i + 1, min(i + 7, len(f))))
    kept = {}
    for src in {k[0] for k in c}:
        mine = sorted((k for k in c if k[0] == src), key=lambda k: (-c[k], k[1], k[2]))
        kept |= {k: c[k] for k in (mine if src in ("<s>", "</s>") else mine[:20])}
    links = {k: -math.log(x) for k, x in shares(kept).items()} if scorer == "rank" else w if scorer == "path" else w | shares(kept)
    want = {(k, i): " ".join(decode.decode_line(ts, alts, links, decode.SCORERS[scorer])) for k, i, ts in lines}
    got = {(r.doc_id, r.line): r.pieces for r in decode._decode(spark, at, scorer).collect()}
    assert got == want


def test_ranked_candidates(spark, small):
    got = decode.ranked_candidates(spark, small[0]).filter("tok = 'kadabra'").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, len(got) + 1)) and [r.likelihood for r in got] == sorted((r.likelihood for r in got), reverse=True)


def test_split_variants(spark, small):
    """Against all ways to cut a token into pieces of which each but the last is known."""
    count = collections.Counter(t for d in small[1] for line in d for t in line.split())
    lex = {t: n for t, n in count.items() if n >= 20 and 2 <= len(t) <= 7}
    lex = {t: n / sum(lex.values()) for t, n in lex.items()}
    got = {r.tok: r for r in pieces.split_variants(spark, small[0]).collect()}
    assert set(got) == set(count)
    for t, r in got.items():
        cuts = [c for n in range(len(t)) for c in itertools.combinations(range(1, len(t)), n)]
        every = [tuple(t[i:j] for i, j in zip((0, *c), (*c, len(t)))) for c in cuts]
        every = [p for p in every if all(x in lex for x in p[:-1]) and (p[-1] in lex or len(p) > 1)] or [(t,)]
        like = lambda p: sum(math.log1p(lex[x]) for x in p if x in lex)
        assert r.per_piece == "#".join(min(every, key=lambda p: (-round(like(p) / len(p), 12), "#".join(p))))
        assert r.entropy == "#".join(min(every, key=lambda p: (-round(like(p) * (sum(x in lex for x in p) + 1) / len(p), 12), "#".join(p))))
        assert r.suffix.replace("#", "") == t and r.partition in {"#".join(p) for p in every} and set(r.sampled.split(" ")) <= {"#".join(p) for p in every}


def test_viterbi_is_best_path(spark):
    obs = spark.createDataFrame([(s, p, "xyz"[(s * p + s) % 3], "AB"[(s + p) % 2 if s % 3 else 0]) for s in range(12) for p in range(5)], "seq long, pos long, sym string, label string")
    e, t = tagging.smoothed(tagging.hmm_emissions(obs), "label"), tagging.smoothed(tagging.hmm_transitions(obs), "l1")
    em, tr = {(r.sym, r.label): -math.log(r.prob) for r in e.collect()}, {(r.l1, r.l2): -math.log(r.prob) for r in t.collect()}
    none = -math.log(tagging.UNSEEN)
    got = {}
    for r in tagging.viterbi(obs, e, t).orderBy("seq", "pos").collect():
        got.setdefault(r.seq, []).append(r.label)
    syms = {}
    for r in obs.orderBy("seq", "pos").collect():
        syms.setdefault(r.seq, []).append(r.sym)
    cost = lambda path, s: sum(em.get((x, y), none) for x, y in zip(s, path)) + sum(tr.get(p, none) for p in zip(path, path[1:]))
    for q, s in syms.items():
        assert abs(cost(got[q], s) - min(cost(p, s) for p in itertools.product("AB", repeat=5))) < 1e-6


def test_counts_and_cooccurrence(spark):
    s = spark.createDataFrame([(1, 0, ["a", "b", "c", "b"])], "doc_id long, line int, toks array<string>")
    x = {(r.w1, r.w2): r.x for r in counts.cooccurrence(s, 2).collect()}
    assert x["a", "b"] == x["b", "a"] == 1 and x["a", "c"] == 0.5 and x["b", "c"] == x["c", "b"] == 2 and x["b", "b"] == 1
    edges = counts.trie_edges(spark.createDataFrame([(list("ab"),), (list("ac"),)], "path array<string>"))
    assert {(r.parent, r.sym): r.cnt for r in edges.collect()} == {("", "a"): 2, ("a", "b"): 1, ("a", "c"): 1}
    links = counts.link_counts(s)
    total = counts.normalise(links, ["src"]).groupBy("src").agg(F.sum("score").alias("t")).collect()
    assert all(abs(r.t - 1) < 1e-6 for r in total)
    assert counts.prune(links, "src", 1, ["dst", "bucket"]).groupBy("src").count().agg(F.max("count")).first()[0] == 1
    both = counts.merge([links, links], ["src", "dst", "bucket"])
    assert both.agg(F.sum("cnt")).first()[0] == 2 * links.agg(F.sum("cnt")).first()[0]
    assert [r.id for r in counts.row_ids(spark.range(50).select((50 - F.col("id")).alias("k")), ["k"]).orderBy("k").collect()] == list(range(50))


def test_models():
    assert models.syllables("elle") == "el#le" and models.syllables("xyz") == "xyz"
    assert abs(models.path_likelihood(["a", "b", "c"], {("", "a"): 0.5, ("a", "b"): 1.0}) - math.log1p(0.5) - math.log1p(1.0)) < 1e-12


def test_glove_and_word2vec(spark):
    s = spark.createDataFrame([(["sun", "is", "hot"] * 5,), (["ice", "is", "cold"] * 5,)], "toks array<string>")
    a, b = (models.glove(counts.cooccurrence(s)).orderBy("word").collect() for _ in range(2))
    assert a == b and len(a) == 5
    assert models.skip_gram(s, dim=4).getVectors().count() == 5


def test_classify(spark):
    d = spark.createDataFrame([("good fine nice word%s" % chr(97 + k % 26), 1) for k in range(60)] + [("bad poor ugly word%s" % chr(97 + k % 26), 0) for k in range(60)], "text string, label int")
    assert models.classify(d)["accuracy"] > 0.9


def test_vectors(spark):
    v = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)], "vec_id long, v array<double>")
    got = vectors.most_similar(v, v.filter("vec_id % 20 = 0"), 3).collect()
    assert len(got) == 9 and all(-1 <= r.sim <= 1 and r.query != r.vec_id for r in got)
    r = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>").select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine(F.col("a"), F.col("z")).alias("n"), vectors.angular(vectors.cosine(F.col("a"), F.col("a"))).alias("one")).first()
    assert abs(r.c - math.sqrt(0.5)) < 1e-12 and r.n is None and r.one == 1


def test_model_round_trip(spark):
    from lexispark.sources.models import load, save

    d = spark.createDataFrame([("a", 1)], "w string, cnt int")
    assert load(save(d, "t")).collect() == d.collect()


def test_streaming_counts(spark, tmp_path):
    from lexispark.streaming.counts import current_counts, update_counts

    spark.createDataFrame([(1, "One two"), (2, "two three")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    update_counts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.tok: r.cnt for r in current_counts(spark, str(tmp_path / "out")).collect()} == {"one": 1, "two": 2, "three": 1}


def test_entry_names():
    names = set(__spark_entry__.queries())
    assert len(names) > 50 and set(__spark_entry__.oracle_sql()) <= names
