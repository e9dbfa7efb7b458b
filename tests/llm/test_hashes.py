"""Sequences that a polynomial modulo 2**64 takes for equal are told apart by every operator that hashes."""

from lexispark.llm import decontam, neardup, quality, repeats

from test_edges import removed


def thue_morse(n, x, y):
    return "".join((x, y)[bin(i).count("1") & 1] for i in range(n))


PAIRS = [tuple(thue_morse(n, *xy) for xy in (z, z[::-1])) for n in (512, 1024, 2048) for z in ("ab", "Y-")]


def test_lines_and_sets(spark):
    rows = [(2 * k + j, f"{x} own words of this text here") for k, p in enumerate(PAIRS) for j, x in enumerate(p)]  # one of six shingles differs
    rows += [(100 + k, "\n".join(p)) for k, p in enumerate(PAIRS)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_dup_lines for r in quality.judge_quality(d).collect()} == {0}
    got = {r.doc_id: r for r in neardup.near_duplicates(d).collect()}
    assert all(got[i].component_id == i for i, _ in rows)


def test_windows(spark):
    rows = [(2 * k + j, f"{x} b c d e f g h i j".replace("-", "z")) for k, p in enumerate(PAIRS) for j, x in enumerate(p)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = d.filter("doc_id % 2 = 0").selectExpr("doc_id as item_id", "text")
    got = {r.doc_id: r.contaminated for r in decontam.contamination(d, bench).collect()}
    assert got == {i: i % 2 == 0 for i, _ in rows}


def test_repeats(spark):
    texts = [(k, x + f"#{k}#") for k, x in enumerate(x for p in PAIRS for x in p)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    for bins in (4096, 1):
        got = repeats.remove_repeats(d, bin_segments=bins).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(removed(texts, 200))
