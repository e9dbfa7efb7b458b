"""Scores of many rows at once against those of one line, and models without a cap."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
import test_operators

from lexispark.operators import decode, segment


def _chunk(r, n=40):
    toks = sorted({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(n)})
    cut = lambda t: sorted({"#".join(x for x in (t[:i], t[i:j], t[j:]) if x) for i, j in ((0, len(t)), tuple(sorted(r.choices(range(len(t) + 1), k=2))))})
    alts = [[{"split": s, "score": round(r.random(), 2)} for s in cut(t)] for t in toks]
    lines = [[r.choice(toks[: r.choice((3, n))]) for _ in range(r.choice((1, 2, 3, 7, 20)))] for _ in range(30)]
    return toks, alts, lines


@pytest.mark.parametrize("scorer", ["rank", "path", "skip", "damped"])
def test_many_as_one(scorer):
    """The same splits, with weights of a few values, so that many combinations tie."""
    r = random.Random(5)
    toks, alts, lines = _chunk(r)
    c = decode.Chunk(pa.array(toks), pa.array(alts, pa.list_(pa.struct([("split", pa.string()), ("score", pa.float64())]))), pa.array([" ".join(t) for t in lines]))
    names, k = c.pieces.to_pylist(), len(c.pieces) + 1
    edges = {(a, b): r.choice((0.0, 0.1, 0.25, 0.3)) for a in range(k - 1) for b in range(k) if r.random() < (0.8 if b == k - 1 else 0.3)}
    links = {(a, b, d): r.choice((0.1, 0.2, 1.7)) for a in range(k - 1) for b in range(k - 1) for d in (0, 1) if r.random() < 0.3}
    value = (lambda x: x) if scorer == "rank" else math.log1p
    w = decode.Weights.__new__(decode.Weights)
    w.k = k
    w.edge = decode.Look(np.array([a * k + b for a, b in edges]), np.array([math.log1p(x) for x in edges.values()]))
    w.link = decode.Look(np.array([(a * k + b) * 3 + d for a, b, d in links]), np.array([value(x) for x in links.values()]))
    w.head = w.edge(np.arange(k) * k + k - 1)
    one = {(names[a], names[b], ("loc", "neig")[d]): x for (a, b, d), x in links.items()}
    if scorer != "rank":
        one |= {("" if b == k - 1 else names[a], names[a] if b == k - 1 else names[b], ""): x for (a, b), x in edges.items()}
    choices = {t: [(tuple(x["split"].split("#")), x["score"]) for x in a] for t, a in zip(toks, alts)}
    want = ["#".join(decode.decode_line(t, choices, one, decode.SCORERS[scorer])) for t in lines]
    chosen, splits = decode.decode_chunk(c, w, scorer), c.splits.to_pylist()
    at = np.cumsum(c.sizes)
    assert ["#".join(splits[x] for x in chosen[j - n : j]) for j, n in zip(at, c.sizes)] == want


def test_all_edges_of_a_source(spark, tmp_path):
    """hub has 30 edges, more than links are kept; the last one decides between hub#xud and hubx#ud."""
    after = [f"x{a}{b}" for a in "aeiou" for b in "bcdfgh"]
    after = after[:-4] + after[-3:] + ["xud"]
    rows = [" ".join(f"hub {f}" for f in sorted(after))] * 20 + [" ".join(f"hub {f}" for f in sorted(after)[:-1])] * 2 + ["hubx " * 34] * 20 + ["ud " * 3] * 7 + ["hubxud"]
    spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for scorer in ("path", "skip", "damped"):
        got = decode._decode(spark, str(tmp_path), scorer).filter(f"doc_id = {len(rows) - 1}").first().pieces
        assert got == "hub xud", scorer


def test_candidates_know_all_edges(spark, tmp_path):
    """The likelihood of a split whose second piece is the 25th of its first one's edges."""
    after = [f"{a}{b}" for a in "bcdfgh" for b in "aeiou"]
    rows = [" ".join(f"hub {f}" for f in after)] * 21 + ["hubhu hubba hubbe"]
    spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    w = test_operators.trie([t.split() for t in rows[:-1]] + [["hub", "hu", "hub", "ba", "hub", "be"]])
    found = {(x.tok, x.split): x.likelihood for x in decode.ranked_candidates(spark, str(tmp_path)).collect()}
    for f in ("ba", "be"):
        assert found[f"hub{f}", f"hub#{f}"] == round(decode.path_score(["hub", f], w), 9)
    more = " ".join(f"hub{f}" for f in after)
    spark.createDataFrame([(k, t) for k, t in enumerate([*rows[:-1], more])], "doc_id long, text string").write.parquet(f"{tmp_path}/more/documents.parquet")
    w = test_operators.trie([t.split() for t in rows[:-1]] + [[x for f in after for x in ("hub", f)]])
    found = {(x.tok, x.split): x.likelihood for x in decode.ranked_candidates(spark, f"{tmp_path}/more").collect()}
    assert all(found[f"hub{f}", f"hub#{f}"] == round(decode.path_score(["hub", f], w), 9) for f in after)
