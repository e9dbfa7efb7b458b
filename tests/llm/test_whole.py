"""Whole results where a shortcut would lose some."""

import itertools
import math
import random

import numpy as np

from lexispark.llm import passages, repeats
from lexispark.operators import segment

VOCAB = ["".join(random.Random(k).choice("abdeilmnorstu") for _ in range(6)) + str(k) for k in range(3000)]


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCAB) for _ in range(n)]


def test_passage_whose_seeds_stand_in_other_documents(spark):
    """The halves of a passage stand in other documents, first and just before, so neither is the right partner."""
    rows, want = [], {}
    for t in range(12):
        h1, h2 = words(30, f"a{t}"), words(30, f"b{t}")
        for k, body in enumerate((h1, h2, h1 + h2, h1, h2, h1 + h2), 1):
            rows.append((10 * t + k, " ".join(words(40, f"l{t},{k}") + body + words(40, f"r{t},{k}"))))
        want[10 * t + 3], want[10 * t + 6] = [], [(40, 100)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in passages.dedup_passages(d).collect()}
    for i, _ in rows:
        assert [(s.start, s.end) for s in got[i].removed] == want.get(i, []) and got[i].n_links == (i in want)
        assert got[i].class_id == (i - 3 if i % 10 == 6 else i)


def test_passage_of_which_every_seed_is_hot(spark):
    """Every part of the fuzzy passages stands in 40 other documents, too, each in words of its own: no partner is near in order of context."""
    rows = []
    for t in range(8):
        parts = [words(11, f"p{t},{k}") for k in range(6)]
        for side in range(2):
            body = [w for k, part in enumerate(parts) for w in [*part, f"own{t}x{side}x{k}"]]
            rows.append((1000 * t + 500 * side, words(40, f"l{t},{side}") + body + words(40, f"r{t},{side}")))
        for k in range(40):
            body = [w for j, part in enumerate(parts) for w in [*part, *words(30, f"f{t},{k},{j}")]]
            rows.append((1000 * t + 1 + 20 * k, body))
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    for p in (passages.PassageParams(), passages.PassageParams(block=7)):
        found = {(r.a, r.b) for r in passages.fuzzy_passages(d, p).collect()}
        assert found == {(1000 * t, 1000 * t + 500) for t in range(8)}


def test_texts_that_share_a_line_alone_are_not_aligned(spark, monkeypatch):
    r = random.Random(8)
    some = ["".join(r.choices("abcdefghijklmnop", k=7)) for _ in range(150)]
    line = words(12, 81)
    texts = [" ".join([*r.choices(some, k=70), *line, *r.choices(some, k=70)]) for _ in range(200)]
    shared = texts[100].split()
    texts += [" ".join([*words(9, 82), *shared[40:110], *words(9, 83)])]
    met, chained = [], passages.chained
    monkeypatch.setattr(passages, "chained", lambda m, p: met.append(m.select("a", "b").distinct().count()) or chained(m, p))
    got = passages.fuzzy_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {(x.a, x.b) for x in got.select("a", "b").collect()} == {(100, 200)}
    assert met[1] < 20, met  # of 20,100 pairs of leads, hundreds with bits in common


def test_edits_and_extension_as_defined():
    r = random.Random(9)
    for _ in range(300):
        x, y = (np.array(r.choices(range(3), k=r.randrange(30)), np.int64) for _ in range(2))
        row = list(range(len(y) + 1))
        for i, v in enumerate(x, 1):
            last, row = row, [i]
            for j, u in enumerate(y, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (v != u)))
        assert passages._edits(x.tolist(), y.tolist()) == row[-1]
        best, score, top = (0, 0, 0), 0, 0
        for i, same in enumerate(x[: len(y)] == y[: len(x)], 1):
            score += 1 if same else -2
            top = max(top, score)
            if top - score > 4:
                break
            if score > best[2]:
                best = (i, int((x[:i] == y[:i]).sum()), score)
        assert passages._straight(x, y, 2, 4) == best


def test_full_alignments_are_worked_out_together(monkeypatch):
    """Many at once give what each gives by itself, whatever their sizes."""
    r = random.Random(10)

    def best(x, y, cost, floor):
        table = [[0 if floor else -cost * j for j in range(len(y) + 1)]]
        for i, v in enumerate(x):
            row = [0 if floor else table[i][0] - cost]
            for j, u in enumerate(y):
                row.append(max(table[i][j + 1] - cost, row[-1] - cost, table[i][j] + (1 if u == v else -cost), *[0] * floor))
            table.append(row)
        return min((-s, i, j) for i, row in enumerate(table) for j, s in enumerate(row))

    for cost, floor in itertools.product((1, 2, 4), (False, True)):
        pairs = [tuple(np.array(r.choices(range(r.choice((2, 9))), k=r.randrange(25)), np.uint32) for _ in range(2)) for _ in range(40)]
        assert [(-s, i, j) for s, i, j in passages._rows(pairs, cost, floor)] == [best(x.tolist(), y.tolist(), cost, floor) for x, y in pairs]

    # Extension stops at seven other words on either side of the seed, so all need the alignment in full.
    calls, rows, p, works = [], passages._rows, passages.PassageParams(), []
    monkeypatch.setattr(passages, "_rows", lambda pairs, *kind: calls.append(len(pairs)) or rows(pairs, *kind))
    texts = []
    for k in range(100):
        x = np.array(r.choices(range(1000), k=300), np.uint32)
        y = x.copy()
        y[133:140] += 5000
        y[146 : 153 + k % 3] += 5000
        texts.append((x, y, [(140, 140)]))
    alone = [passages.align(*t, p) for t in texts]
    assert all(alone)
    asked, calls[:] = len(calls), []
    assert list(passages._together(passages._align(*t, p, []) for t in texts)) == alone
    assert sum(calls) == asked and len(calls) < asked / 4, (asked, calls)


def test_index_sorts_again_only_suffixes_that_are_alike(monkeypatch):
    r, sizes, sort = random.Random(11), [], np.argsort
    strings = [bytes(r.choices(range(97, 123), k=300)) for _ in range(60)]
    strings.append(strings[5][:40] + b"#" + strings[5][41:290])
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sizes.append(len(x)) or sort(x, *a, **k))
    got = {(s, at) for s, start, n in zip(*repeats.long_matches(strings, 200)) for at in range(start, start + n)}
    assert got == {(5, at) for at in range(41, 290)} | {(60, at) for at in range(41, 290)}
    assert len(sizes) > 4 and sum(sizes) < 1.5 * sizes[0], sizes


def test_token_splits_use_the_whole_lexicon(spark, tmp_path):
    """More than 50,000 lexicon words, all equally frequent: the last ones count too, and shares are taken over all."""
    lex = ["".join(w) for w in itertools.islice(itertools.product("bcdfghjklmnpqrst", repeat=4), 50_100)]
    last = lex[-1] + lex[-2]
    d = spark.createDataFrame([(k, " ".join(lex)) for k in range(20)] + [(99, last)], "doc_id long, text string")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = segment.token_splits_query(spark, str(tmp_path)).filter(f"tok = '{last}' and rank = 1").first()
    assert got.split == got.greedy == f"{lex[-1]}#{lex[-2]}" and got.score == round(2 * math.log1p(1 / len(lex)), 9)
