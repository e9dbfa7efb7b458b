"""Decoding lines with models of pieces: path, skip, damped and rank scores of window combinations.

Every token has alternative splits; windows of tokens are scored over all choices
of one split a token, and a line is the first window's best choice followed by
the last token's of each further window. Lines are decoded a chunk at a time: the
splits of its tokens are joined to it, and it asks the models for the edges that
may stand between their pieces, all of them, and for the kept links of its pieces
(``KEEP`` a source). Neither lexicon nor links are collected or cut. The scores
of one line (``SCORERS``) say what the scores of many rows at once must give.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.models import load, save
from . import chunks as C
from .base import lexicon, query, read, token_counts, token_lists
from .counts import END, START
from .segment import A, B, combination_score, token_splits

KEEP = 20
PATH = ""  # kind of trie edges; those of links are the distance buckets
Weights = dict[tuple[str, str, str], float]
Scorer = Callable[[list[tuple[tuple[str, ...], float]], Weights], float]


def bucket(d: int) -> str:
    return "dist" if d >= 5 else "neig" if d > 2 else "loc"


def walk(pieces: list[str], w: Weights) -> Iterator[tuple[str, str, float | None]]:
    """State before, state after and weight at every piece of a trie two deep; without an edge the walk starts again at the root."""
    at = ""
    for p in pieces:
        start = at
        if (at, p, PATH) not in w:
            at = start = ""
        got = w.get((at, p, PATH))
        if got is not None:
            at = p if not at else f"{at} {p}"
        yield start, at, got


def path_score(pieces: list[str], w: Weights) -> float:
    return sum(math.log1p(x) for _, _, x in walk(pieces, w) if x is not None)


def skip_score(pieces: list[str], w: Weights, distance: int = 3) -> float:
    """The path without restarts within a step, and skip links back to a distance, over the square of the number of pieces."""
    at, total = "", 0.0
    for i, p in enumerate(pieces):
        got = w.get((at, p, PATH))
        total += math.log1p(got) if got is not None else 0.0
        for k in range(max(0, i - distance), i):
            total += math.log1p(w.get((pieces[k], p, bucket(i - k)), 0.0))
        at = "" if got is None else (p if not at else f"{at} {p}")
    return total / len(pieces) ** 2 if pieces else 0.0


def damped_score(pieces: list[str], w: Weights, distance: int = 3, iterations: int = 3) -> float:
    """Scores of states passed on along the path and its skip links, forward and then backward, damped by 0.85."""
    score = {"": 1.0}
    for backward in (False, True):
        at = ""
        for _ in range(iterations):
            for i, p in enumerate(pieces):
                got = w.get((at, p, PATH))
                to = "" if got is None else (p if not at else f"{at} {p}")
                total = 0.85 * score[at] + 0.15 * (math.log1p(got) if got is not None else 0.0)
                for k in range(max(0, i - distance), i):
                    pair = (p, pieces[k]) if backward else (pieces[k], p)
                    total += 0.85 * score[at] + 0.15 * math.log1p(w.get((*pair, bucket(i - k)), 0.0))
                score[to] = total / iterations
                at = to
    return sum(score.values()) / len(pieces) ** 2 if pieces else 0.0


def _flat(f: Callable[[list[str], Weights], float], times: bool = False) -> Scorer:
    def run(combo, w: Weights) -> float:
        pieces = [p for c, _ in combo for p in c]
        return f(pieces, w) * (len(pieces) if times else 1)

    return run


SCORERS: dict[str, Scorer] = {"rank": combination_score, "path": _flat(path_score, True), "skip": _flat(skip_score), "damped": _flat(damped_score)}


def decode_line(toks: list[str], alts: dict[str, list[tuple[tuple[str, ...], float]]], w: Weights, score: Scorer, window: int = 3) -> list[str]:
    """Pieces of a line; ties go to the later combination."""
    out = []
    for i in range(max(len(toks) - window, 0) + 1):
        combos = (tuple(reversed(c)) for c in product(*reversed([alts[t] for t in toks[i : i + window]])))
        best = max(enumerate(combos), key=lambda x: (round(score(list(x[1]), w), 9), x[0]))[1]
        for pieces, _ in best if not i else best[-1:]:
            out.extend(pieces)
    return out


def alternatives(tokens: DataFrame, words: DataFrame, top: int = 2) -> DataFrame:
    """tok, alts: array of (split, score), best first."""
    rows = token_splits(tokens, words, top).groupBy("tok").agg(F.array_sort(F.collect_list(F.struct("rank", "split", "score"))).alias("alts"))
    return rows.withColumn("alts", F.transform("alts", lambda x: F.struct(x["split"].alias("split"), x["score"].alias("score"))))


class Chunk:
    """Lines and the splits of their tokens as numbers: pieces of a split, splits of a token, tokens of a line."""

    def __init__(self, toks: pa.Array, alts: pa.Array, text: pa.Array | None = None):
        self.toks, self.splits = toks, pc.struct_field(alts.flatten(), 0)
        self.score = pc.struct_field(alts.flatten(), 1).to_numpy(zero_copy_only=False)
        self.choices = pc.list_value_length(alts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.choices) - self.choices
        parts = pc.split_pattern(self.splits, "#")
        d = parts.flatten().dictionary_encode()
        self.piece, self.pieces = d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary
        self.size = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size
        if text is not None:
            self.codes, self.sizes = C.line_codes(text, toks)
            self.place = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
            self.left = np.repeat(self.sizes, self.sizes) - self.place

    def pairs(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """All pairs (last piece, first piece) of the splits of two tokens, as numbers."""
        n, k = len(self.toks), len(self.pieces) + 1
        two = np.unique(before * n + after)
        a, b = two // n, two % n
        each = self.choices[a] * self.choices[b]
        i = C.ranges(np.zeros(len(each), np.int64), each)
        a, b = np.repeat(a, each), np.repeat(b, each)
        x, y = self.first[a] + i % self.choices[a], self.first[b] + i // self.choices[a]
        return np.unique(self.piece[self.start[x] + self.size[x] - 1] * k + self.piece[self.start[y]])

    def inner(self) -> np.ndarray:
        """Pairs of neighbours within splits, and every piece below the root (a pair with the last number)."""
        k, ends = len(self.pieces) + 1, self.start + self.size - 1
        at = np.setdiff1d(np.arange(len(self.piece)), ends, assume_unique=True)
        return np.concatenate([self.piece[at] * k + self.piece[at + 1], np.arange(k - 1) * k + k - 1])

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of the best splits of the lines' tokens, and how many a line has."""
        alt = self.first[self.codes]
        return self.piece[C.ranges(self.start[alt], self.size[alt])], np.add.reduceat(self.size[alt], np.cumsum(self.sizes) - self.sizes)

    def windows(self, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First places of windows and their lengths, the shorter ones of lines that are shorter."""
        for m in range(1, window + 1):
            at = np.flatnonzero(((self.place == 0) & (self.left == m)) if m < window else self.left >= m)
            if len(at):
                yield at, m


def _sequences(c: Chunk, alts: np.ndarray) -> np.ndarray:
    """Pieces of combinations of splits, a row each; all have as many."""
    flat = alts.ravel()
    return c.piece[C.ranges(c.start[flat], c.size[flat])].reshape(len(alts), -1)


class Sum:
    """Float sums as the built-in sum takes them, with what each addition lost."""

    def __init__(self, n: int):
        self.total, self.lost = np.zeros(n), np.zeros(n)

    def add(self, x: np.ndarray) -> None:
        t = self.total + x
        self.lost += np.where(np.abs(self.total) >= np.abs(x), (self.total - t) + x, (x - t) + self.total)
        self.total = t

    def get(self) -> np.ndarray:
        return self.total + self.lost


class Look:
    """Values of whole numbers in an open hash table; nan where there is none."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        bits = max(int(4 * len(key)).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.full(1 << bits, np.nan)
        at = self._slot(key)
        while len(key):
            free = self.key[at] == -1
            self.key[at[free]] = key[free]
            mine = self.key[at] == key
            self.value[at[mine]] = value[mine]
            key, value, at = key[~mine], value[~mine], (at[~mine] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = self._slot(key)
        found = self.key[at]
        out = np.where(found == key, self.value[at], np.nan)
        rest = np.flatnonzero((found != key) & (found != -1))
        while len(rest):
            at[rest] = (at[rest] + 1) & self.mask
            found = self.key[at[rest]]
            hit = found == key[rest]
            out[rest[hit]] = self.value[at[rest[hit]]]
            rest = rest[~hit & (found != -1)]
        return out


class Weights:
    """log(1 + weight) of trie edges (edge; head below the root), and weights of links by kind (of rank as they are), between a chunk's pieces."""

    def __init__(self, c: Chunk, rows: pa.Table):
        self.k = len(c.pieces) + 1
        path = pc.equal(rows.column("kind"), "path")
        self.edge, self.link = (Look(*self._of(c, rows.filter(m))) for m in (path, pc.invert(path)))
        self.head = self.edge(np.arange(self.k) * self.k + self.k - 1)

    def _of(self, c: Chunk, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        if not rows.num_rows:
            return np.empty(0, np.int64), np.empty(0)
        tails = C.whole(rows.column("tails"))
        d = C.words_in(tails).dictionary_encode()
        names = pa.concat_arrays([c.pieces, pa.array([""])])
        to = pc.index_in(pc.utf8_rtrim(d.dictionary, " "), value_set=names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[d.indices.to_numpy(zero_copy_only=False)]
        src = pc.index_in(C.whole(rows.column("text")), value_set=c.pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        src = np.repeat(src, pc.count_substring(tails, b" ").to_numpy(zero_copy_only=False))
        kind, value = C._data(C.whole(rows.column("kinds")), np.uint8)[0].astype(np.int64), C._data(C.whole(rows.column("ws")), np.float64)[0]
        keep = to >= 0
        return ((src * self.k + to) * 3 + kind)[keep] if rows.column("kind")[0].as_py() != "path" else (src * self.k + to)[keep], value[keep]

    def between(self, a: np.ndarray, b: np.ndarray, kind: int) -> np.ndarray:
        return np.nan_to_num(self.link((a * self.k + b) * 3 + kind), nan=0.0)


def _steps(p: np.ndarray, j: int, w: Weights, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edge from a lone piece before, and the one below the root, to the j-th piece; nan where there is none."""
    return np.where(depth == 1, w.edge(p[:, j - 1] * w.k + p[:, j]), np.nan), w.head[p[:, j]]


def path_scores(p: np.ndarray, w: Weights) -> np.ndarray:
    """path_score of rows of pieces times their number."""
    depth, total = np.zeros(len(p), np.int8), Sum(len(p))
    for j in range(p.shape[1]):
        on, head = _steps(p, j, w, depth)
        depth = np.where(~np.isnan(on), 2, np.where(np.isnan(head), 0, 1))
        total.add(np.nan_to_num(np.where(depth == 2, on, head), nan=0.0))
    return total.get() * p.shape[1]


def _kind(d: int) -> int:
    return 1 if d > 2 else 0


def skip_scores(p: np.ndarray, w: Weights, distance: int = 3) -> np.ndarray:
    """skip_score of rows of pieces."""
    depth, total = np.zeros(len(p), np.int8), np.zeros(len(p))
    for j in range(p.shape[1]):
        on, head = _steps(p, j, w, depth)
        got = np.where(depth == 0, head, on)
        total = total + np.nan_to_num(got, nan=0.0)
        for k in range(max(0, j - distance), j):
            total = total + w.between(p[:, k], p[:, j], _kind(j - k))
        depth = np.where(np.isnan(got), 0, depth + 1)
    return total / p.shape[1] ** 2


def damped_scores(p: np.ndarray, w: Weights, distance: int = 3, iterations: int = 3) -> np.ndarray:
    """damped_score of rows of pieces: the states of three walks, the same backward, each with its place among the distinct ones."""
    n, size = p.shape
    state, own, got, depth = [np.zeros(n, np.int64)], [np.zeros(n, np.int64)], [], np.zeros(n, np.int8)
    for step in range(iterations * size):
        j = step % size
        on, head = _steps(p, j, w, depth)  # the piece before the first is the last
        got.append(np.where(depth == 0, head, on))
        depth = np.where(np.isnan(got[-1]), 0, depth + 1)
        state.append(np.where(depth == 0, 0, np.where(depth == 1, p[:, j] + 1, (p[:, j - 1] + 1) * (w.k + 1) + p[:, j] + 1)))
        at = np.full(n, step + 1)
        for k in range(step, -1, -1):
            at = np.where(state[k] == state[-1], k, at)
        own.append(at)
    gain = [0.15 * np.nan_to_num(x, nan=0.0) for x in got]
    score, rows = np.zeros((n, len(state))), np.arange(n)
    score[:, 0] = 1.0
    for backward in (False, True):
        links = {(j, k): 0.15 * (w.between(p[:, j], p[:, k], _kind(j - k)) if backward else w.between(p[:, k], p[:, j], _kind(j - k))) for j in range(size) for k in range(max(0, j - distance), j)}
        for step in range(iterations * size):
            j = step % size
            passed = 0.85 * score[rows, own[step]]
            total = passed + gain[step]
            for k in range(max(0, j - distance), j):
                total = total + (passed + links[j, k])
            score[rows, own[step + 1]] = total / iterations
    total = Sum(n)
    for k in range(len(state)):
        total.add(score[:, k])
    return total.get() / size**2


def rank_scores(c: Chunk, alts: np.ndarray, w: Weights, iterations: int = 3) -> np.ndarray:
    """combination_score of rows of splits, of three at most, so that all links are near."""
    mean = {}
    for i in range(alts.shape[1]):
        for k in range(i):
            two, which = np.unique(alts[:, k] * len(c.size) + alts[:, i], return_inverse=True)
            a, b = two // len(c.size), two % len(c.size)
            each = c.size[a] * c.size[b]
            at = C.ranges(np.zeros(len(each), np.int64), each)
            pair = np.repeat(np.arange(len(two)), each)
            value = w.between(c.piece[c.start[a][pair] + at // c.size[b][pair]], c.piece[c.start[b][pair] + at % c.size[b][pair]], 0)
            total, first = Sum(len(two)), np.cumsum(each) - each
            for step in range(int(each.max())):
                has = step < each
                total.add(np.where(has, value[np.minimum(first + step, len(value) - 1)], 0.0))
            mean[k, i] = (total.get() / each)[which]
    out = 0.0 + c.score[alts[:, 0]]
    for i in range(1, alts.shape[1]):
        inflow = np.zeros(len(alts))
        for k in range(i):
            inflow = inflow + A ** (i - 1 - k) * mean[k, i]
        r = A**i
        out = out + (r**iterations * c.score[alts[:, i]] + B * inflow * (1 - r**iterations) / (1 - r))
    return out


FLAT = {"path": path_scores, "skip": skip_scores, "damped": damped_scores}
ROWS, CELLS = 1 << 16, 1 << 21  # combinations, and their pieces, scored at a time


def scored(c: Chunk, alts: np.ndarray, w: Weights, scorer: str) -> np.ndarray:
    """Scores of combinations (rows of splits), those of one number of pieces together."""
    out, size = np.empty(len(alts)), c.size[alts].sum(1)
    order = np.argsort(size, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(size[order])) + 1, [len(alts)]])
    for i, j in zip(cuts[:-1], cuts[1:]):
        step = max(min(ROWS, CELLS // max(int(size[order[i]]), 1) // 4), 1) if j > i else 1
        for k in range(i, j, step):
            at = order[k : min(k + step, j)]
            out[at] = rank_scores(c, alts[at], w) if scorer == "rank" else FLAT[scorer](_sequences(c, alts[at]), w)
    return out


def decode_chunk(c: Chunk, w: Weights, scorer: str, window: int = 3) -> np.ndarray:
    """The split of every token, as decode_line chooses it; equal windows are scored once."""
    chosen, n = np.empty(len(c.codes), np.int64), len(c.toks)
    for at, m in c.windows(window):
        key = c.codes[at]
        for k in range(1, m):
            key = key * n + c.codes[at + k]  # a chunk has a million tokens, so that three fit
        _, one, which = np.unique(key, return_index=True, return_inverse=True)
        best = np.empty((len(one), m), np.int64)
        for i in range(0, len(one), ROWS):
            tok = np.stack([c.codes[at[one[i : i + ROWS]] + k] for k in range(m)], 1)
            each = c.choices[tok].prod(1)
            first, combo = np.cumsum(each) - each, C.ranges(np.zeros(len(each), np.int64), each)
            tok, rest, alts = np.repeat(tok, each, 0), combo.copy(), np.empty((len(combo), m), np.int64)
            for k in range(m):
                alts[:, k] = c.first[tok[:, k]] + rest % c.choices[tok[:, k]]
                rest //= c.choices[tok[:, k]]
            score = scored(c, alts, w, scorer)
            near = score >= np.repeat(np.maximum.reduceat(score, first), each) - 2e-9
            row = np.repeat(np.arange(len(each)), each)
            best[i + row[near]] = alts[near]  # of several, settled below
            several = np.bincount(row[near], minlength=len(each)) > 1
            held: dict[int, tuple[float, int]] = {}
            for x in np.flatnonzero(near & several[row]).tolist():
                r = int(row[x])
                held[r] = max(held.get(r, (-math.inf, -1)), (round(float(score[x]), 9), x))
            for r, (_, x) in held.items():
                best[i + r] = alts[x]
        best = best[which]
        start = c.place[at] == 0
        for k in range(m):
            of = start if k < m - 1 else slice(None)
            chosen[at[of] + k] = best[of, k]
    return chosen


def _models(held: DataFrame, alts: DataFrame, scorer: str, window: int = 3) -> DataFrame:
    """Chunks with the splits of their tokens (kind tok), and what they ask of models (asked: path, link) and add to them (counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: str, chunk: int, rows: int, **cols: pa.Array) -> pa.RecordBatch:
            base = {"chunk": pa.array(np.full(rows, chunk)), "kind": pa.array([kind] * rows)} | cols
            return pa.RecordBatch.from_arrays([base.get(f.name, pa.nulls(rows, f.type)).cast(f.type) for f in fields], schema=pa.schema(fields))

        for t in C.each_chunk(batches):
            fields = [pa.field("chunk", pa.int64()), pa.field("kind", pa.string()), t.schema.field("doc_id"), pa.field("line", pa.int32()), pa.field("text", pa.string()), t.schema.field("alts"), pa.field("tails", pa.binary()), pa.field("vals", pa.binary()), pa.field("n", pa.int64())]
            chunk, of = t.column("chunk")[0].as_py(), t.filter(pc.is_valid(t.column("tok")))
            lines = t.filter(pc.is_valid(t.column("text")))
            c = Chunk(C.whole(of.column("tok")), C.whole(of.column("alts")), C.whole(lines.column("text")))
            yield out("tok", chunk, of.num_rows, text=c.toks, alts=C.whole(of.column("alts")))
            yield out("line", chunk, lines.num_rows, **{k: C.whole(lines.column(k)) for k in ("doc_id", "line", "text")})
            names = pa.concat_arrays([c.pieces, pa.array([""])])
            if scorer == "rank":
                src, tails, vals = C.neighbours(PLACES, 3, START, END)(c.codes, c.sizes, c.toks)
                yield out("link counts", chunk, len(src), text=src, tails=tails, vals=vals)
            else:
                seq, sizes = c.best()
                k = len(names)
                place = np.arange(len(seq)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                heads = seq[place < np.repeat(np.maximum(sizes - 1, 1), sizes)]
                key, got = np.unique(np.concatenate([C.pair_keys(seq, sizes, 1, k), heads * k + k - 1]), return_counts=True)
                src, tails, vals = C.pack(names, key // k, key % k, got)
                yield out("path counts", chunk, len(src), text=src, tails=tails, vals=vals, n=pa.array(np.append(np.zeros(len(src) - 1, np.int64), len(heads))))
                next_, ends = np.flatnonzero(c.left > 1), []
                if scorer == "damped":
                    ends = [c.pairs(c.codes[at + m - 1], c.codes[at]) for at, m in c.windows(window)]
                key = np.unique(np.concatenate([c.inner(), c.pairs(c.codes[next_], c.codes[next_ + 1]), *ends]))
                src, tails, _ = C.pack(names, key // k, key % k, key)
                yield out("path", chunk, len(src), text=src, tails=tails)
                if scorer != "path":
                    src, tails, vals = C.neighbours(PLACES, 3)(seq, sizes, c.pieces)
                    yield out("link counts", chunk, len(src), text=src, tails=tails, vals=vals)
            if scorer != "path":
                yield out("link", chunk, len(c.pieces), text=c.pieces)

    kinds = dict(held.dtypes)
    got = C.looked_up(held, alts).mapInArrow(run, f"chunk long, kind string, doc_id {kinds['doc_id']}, line int, text string, alts {dict(alts.dtypes)['alts']}, tails binary, vals binary, n long")
    return load(save(got, "decode"))


PLACES = {d: 2 if d >= 5 else 1 if d > 2 else 0 for d in range(1, 7)}
_NAMES = ["loc", "neig", "dist"]


def _path_weights(rows: DataFrame, heads: int) -> DataFrame:
    """Answers to what chunks ask of the trie of windows of two pieces: logarithms of 1 and the edges' shares."""

    def weigh(e: C.Entries) -> np.ndarray:
        root = pc.equal(e.dst, " ").to_numpy(zero_copy_only=False)[e.tail]
        total = np.bincount(e.head[~root], e.n[~root], len(e.src))[e.head]
        share = C.rounded(e.n, np.where(root, heads, total))
        return np.array([math.log1p(x) for x in share.tolist()])

    return C.answered(rows, 1, weigh)


def _link_weights(rows: DataFrame, scorer: str) -> DataFrame:
    """The best links of a source to chunks that have it: negative logarithms of their shares, so that rare ones weigh more, or log(1 + share)."""

    def change(e: C.Entries) -> C.Entries:
        return e.best(KEEP, _NAMES, (START, END) if scorer == "rank" else ())

    def weigh(e: C.Entries) -> np.ndarray:
        share = C.rounded(e.n, e.totals())
        return np.array([(-math.log(x) if x > 0 else 0.0) if scorer == "rank" else math.log1p(x) for x in share.tolist()])

    return C.answered(rows, 3, weigh, change, asked=False)


def _asked(coded: DataFrame, kind: str) -> DataFrame:
    """Counts of a model, and what chunks ask of it."""
    return coded.filter(F.col("kind").isin(kind, f"{kind} counts")).select(F.col("text").alias("src"), F.when(F.col("kind") == kind, F.col("chunk")).alias("chunk"), "tails", "vals")


def _weights(coded: DataFrame, scorer: str) -> DataFrame:
    """chunk, kind (path, link), text (the source), tails, kinds, ws."""
    parts = []
    if scorer != "rank":
        heads = coded.filter("kind = 'path counts'").agg(F.sum("n")).first()[0] or 1
        parts.append(_path_weights(_asked(coded, "path"), heads).withColumn("kind", F.lit("path")))
    if scorer != "path":
        parts.append(_link_weights(_asked(coded, "link"), scorer).withColumn("kind", F.lit("link")))
    got = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    return got.withColumnRenamed("src", "text")


def _decode(spark: SparkSession, sf_dir: str, scorer: str) -> DataFrame:
    """doc_id, line, n_pieces, pieces of every line."""
    docs = read(spark, sf_dir, "documents")
    coded = _models(C.chunked(token_lists(docs)), alternatives(token_counts(docs), lexicon(docs)), scorer)
    kinds = dict(coded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.each_chunk(batches):
            of, lines = (t.filter(pc.equal(t.column("kind"), k)) for k in ("tok", "line"))
            c = Chunk(C.whole(of.column("text")), C.whole(of.column("alts")), C.whole(lines.column("text")))
            chosen = decode_chunk(c, Weights(c, t.filter(pc.is_in(t.column("kind"), value_set=pa.array(["path", "link"])))), scorer)
            spaced = pc.binary_join_element_wise(pc.replace_substring(c.splits, "#", " "), "", " ")
            pieces = C.rendered(spaced.take(pa.array(chosen)), c.sizes)
            n = np.add.reduceat(c.size[chosen], np.cumsum(c.sizes) - c.sizes)
            yield pa.RecordBatch.from_arrays([C.whole(lines.column("doc_id")), C.whole(lines.column("line")).cast(pa.int64()), pa.array(n), pieces], names=["doc_id", "line", "n_pieces", "pieces"])

    own = coded.filter("kind in ('tok', 'line')").select("chunk", "kind", "doc_id", "line", "text", "alts", *(F.lit(None).cast("binary").alias(x) for x in ("tails", "kinds", "ws")))
    weights = _weights(coded, scorer).select("chunk", "kind", *(F.lit(None).cast(kinds[x]).alias(x) for x in ("doc_id", "line")), "text", F.lit(None).cast(kinds["alts"]).alias("alts"), "tails", "kinds", "ws")
    return C.together(coded, own.union(weights)).mapInArrow(run, f"doc_id {kinds['doc_id']}, line long, n_pieces long, pieces string")


@query("window_decode")
def window_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line rewritten as pieces: splits ranked by the links between neighbours."""
    return _decode(spark, sf_dir, "rank")


@query("path_decode")
def path_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line by the path likelihood of its pieces times their number."""
    return _decode(spark, sf_dir, "path")


@query("skip_decode")
def skip_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line by path and skip links."""
    return _decode(spark, sf_dir, "skip")


@query("damped_decode")
def damped_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line by damped ranking of the states of its pieces."""
    return _decode(spark, sf_dir, "damped")


@query("ranked_candidates")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best splits of every distinct token, ranked by the path likelihood of their pieces; ties by score, then text."""
    docs = read(spark, sf_dir, "documents")
    alts = alternatives(token_counts(docs), lexicon(docs), 3)
    coded = _models(C.chunked(token_lists(docs)), alts, "path").filter("kind = 'path counts'")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for k, b in enumerate(batches):
            c = Chunk(b.column(0), b.column(1))
            key, n = np.unique(c.inner()), len(c.pieces) + 1
            src, tails, _ = C.pack(pa.concat_arrays([c.pieces, pa.array([""])]), key // n, key % n, key)
            at, m = (TaskContext.get().partitionId() << 24) + k, b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, at)), pa.array(["tok"] * m), b.column(0), b.column(1), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=["chunk", "kind", "text", "alts", "tails", "vals"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), at)), pa.array(["path"] * len(src)), src, pa.nulls(len(src), b.column(1).type), tails, pa.nulls(len(src), pa.binary())], names=["chunk", "kind", "text", "alts", "tails", "vals"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in C.each_chunk(batches):
            own = pc.equal(t.column("kind"), "tok")
            of = t.filter(own)
            c = Chunk(C.whole(of.column("text")), C.whole(of.column("alts")))
            like = scored(c, np.arange(len(c.size))[:, None], Weights(c, t.filter(pc.invert(own))), "path") / c.size
            like = np.array([round(x, 9) for x in like.tolist()])
            tok = np.repeat(np.arange(len(c.toks)), c.choices)
            place = pc.sort_indices(pa.table({"t": tok, "l": -like, "s": -c.score, "x": c.splits}), [("t", "ascending"), ("l", "ascending"), ("s", "ascending"), ("x", "ascending")]).to_numpy()
            rank = C.ranges(np.ones(len(c.choices), np.int64), c.choices)
            yield pa.RecordBatch.from_arrays([c.toks.take(pa.array(tok)), pa.array(rank), c.splits.take(pa.array(place)), pa.array(like[place])], names=["tok", "rank", "split", "likelihood"])

    shape = dict(alts.dtypes)["alts"]
    tokens = load(save(alts.select("tok", "alts").mapInArrow(ask, f"chunk long, kind string, text string, alts {shape}, tails binary, vals binary"), "candidates"))
    asked = _asked(coded, "path").union(_asked(tokens, "path"))
    heads = coded.agg(F.sum("n")).first()[0] or 1
    own = tokens.filter("kind = 'tok'").select("chunk", "kind", "text", "alts", *(F.lit(None).cast("binary").alias(x) for x in ("tails", "kinds", "ws")))
    weights = _path_weights(asked, heads).select("chunk", F.lit("path").alias("kind"), F.col("src").alias("text"), F.lit(None).cast(shape).alias("alts"), "tails", "kinds", "ws")
    return C.together(tokens, own.union(weights)).mapInArrow(run, "tok string, rank long, split string, likelihood double")
