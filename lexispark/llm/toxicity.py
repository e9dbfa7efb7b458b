"""Operator 10, toxicity: Levenshtein automata over a lexicon trie, scored in context.

The lexicon is learned from labelled training rows (crc32 of doc_id as text not
divisible by 5), at most ``fit_rows`` of them, those with the least hash of
doc_id, one for each text. Its terms are prefixes of words that stand in toxic
documents and hardly in others, chosen greedily by the toxic documents that no
earlier term explains and lengthened while nearly all of their documents agree.
Terms that are mostly whole words may be misspelled (one edit, two from eight
letters on, none to the first letter; a swap of neighbours is one edit); the others are stems, matched as
exact beginnings. Words that match but are as much at home in clean training
documents (by rate for exact matches, by number for misspelled ones) are set
apart as harmless.

Trie and automaton are intersected lazily: a state is the set of (node, edits)
places reachable, determinised when first met, so a word costs one step a
letter until no term is within reach. Each distinct word of a chunk is walked
once. A hit inside quotation marks that open and close within
``context_words`` words counts as quoted; a logistic model over plain hits
(a misspelled one counts less), their density and quoted hits, fitted on the
same sample and centred where its balanced accuracy is best, gives the score. Labels, language, source and doc_id are not inputs of a score.

One streamed pass over all documents, without a shuffle.

Defined results: a null or empty text is scored as one without hits; a null
doc_id is held out if the checksum of the empty string says so; repeated rows
score alike; without toxic training rows every score is 0; an empty table gives
an empty table; other columns are not read; contradictory labels of a doc_id
count as toxic.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import doc_texts, map_batches, table, written


@dataclass(frozen=True)
class ToxicityParams:
    fit_rows: int = 20_000
    min_prefix: int = 4
    max_prefix: int = 14
    min_support: int = 2
    min_precision: float = 0.9
    #: A term of so large a share of the toxic documents is taken even if others explain all of them.
    common: float = 0.05
    #: What a misspelled hit counts beside an exact one.
    misspelled: float = 0.7
    context_words: int = 8
    ridge: float = 0.05


class Lexicon:
    """Terms in a trie; match() is the lazily determinised automaton."""

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems = words, stems
        self.harmless: frozenset[str] = frozenset()
        self.child: list[dict[str, int]] = [{}]
        self.stop: list[int] = [0]  # 0 no term, 1 stem, 2 word; length of the term at the node
        self.depth = [0]
        for terms, kind in ((stems, 1), (words, 2)):
            for t in terms:
                n = 0
                for ch in t:
                    if ch not in self.child[n]:
                        self.child[n][ch] = len(self.child)
                        self.child.append({})
                        self.stop.append(0)
                        self.depth.append(self.depth[n] + 1)
                    n = self.child[n][ch]
                self.stop[n] = max(self.stop[n], kind)
        self.table: list[dict[str, int]] = []
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.exact: list[bool] = []
        self.near: list[bool] = []
        self.first = self._state({(0, 0, "")})

    def _allowed(self, node: int) -> int:
        return 1 if self.depth[node] < 8 else 2

    def _state(self, places: set[tuple[int, int, str]]) -> int:
        todo = list(places)
        while todo:  # letters of the term left out
            node, e, wait = todo.pop()
            if not wait and e < 2 and node:
                for n in self.child[node].values():
                    if (n, e + 1, "") not in places:
                        places.add((n, e + 1, ""))
                        todo.append((n, e + 1, ""))
        key = frozenset(places)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.table.append({})
            self.exact.append(any(e == 0 and not w and self.stop[n] for n, e, w in key))
            self.near.append(any(not w and self.stop[n] == 2 and e <= self._allowed(n) for n, e, w in key))
        return self.number[key]

    def _step(self, state: int, ch: str) -> int:
        out: set[tuple[int, int, str]] = set()
        for node, e, wait in self.states[state]:
            if wait:
                if wait == ch:
                    out.add((node, e, ""))
                continue
            for x, n in self.child[node].items():
                if x == ch:
                    out.add((n, e, ""))
                elif e < 2 and node:  # the first letter stands
                    out.add((n, e + 1, ""))
                    if ch in self.child[n]:
                        out.add((self.child[n][ch], e + 1, x))
            if e < 2 and node:
                out.add((node, e + 1, ""))
        self.table[state][ch] = to = self._state(out) if out else -1
        return to

    def match(self, word: str) -> int:
        """2: a term stands at the word's beginning; 1: the word is a term misspelled; 0: neither, or known harmless."""
        if word in self.harmless:
            return 0
        s = self.first
        for ch in word:
            t = self.table[s].get(ch)
            s = self._step(s, ch) if t is None else t
            if s < 0:
                return 0
            if self.exact[s]:
                return 2
        return int(self.near[s])


_QUOTES = ('"', "“", "”", "„", "«", "»")


def _quotes(c: K.Chunk) -> np.ndarray:
    b, found = c.buf, [np.flatnonzero(c.buf == 34)]
    if len(b) > 1:
        found.append(np.flatnonzero((b[:-1] == 0xC2) & ((b[1:] == 0xAB) | (b[1:] == 0xBB))))
    if len(b) > 2:
        found.append(np.flatnonzero((b[:-2] == 0xE2) & (b[1:-1] == 0x80) & (b[2:] >= 0x9C) & (b[2:] <= 0x9E)))
    return np.sort(np.concatenate(found))


class Features:
    """Hits of a document, plain (their weight and their density) and quoted; and counts of all four kinds."""

    def __init__(self, lexicon: Lexicon, p: ToxicityParams):
        self.lexicon, self.context, self.misspelled, self.known = lexicon, p.context_words, p.misspelled, {}

    def __call__(self, c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
        w = c.words(K.ALNUM_WORD, lower=True)
        kinds, first, back = np.unique(w.key, return_index=True, return_inverse=True)
        if len(self.known) > 1_000_000:
            self.known.clear()
        known, hit = self.known, np.zeros(len(kinds), np.int8)
        for i, k in enumerate(kinds.tolist()):
            got = known.get(k)
            if got is None:
                at = first[i]
                known[k] = got = self.lexicon.match(c.buf[w.start[at] : w.end[at]].tobytes().decode().lower())
            hit[i] = got
        per_word = hit[back]
        at = np.flatnonzero(per_word)
        out = np.zeros((c.n, 4), np.int64)
        if len(at):
            row = np.searchsorted(w.offs, at, "right") - 1
            q = _quotes(c)
            lo = w.start[np.maximum(at - self.context, w.offs[row])]
            lo = np.maximum(np.where(at - self.context <= w.offs[row], c.offs[row], lo), c.offs[row])
            last = np.minimum(at + self.context, w.offs[row + 1] - 1)
            hi = np.where(at + self.context >= w.offs[row + 1], c.offs[row + 1], w.end[last])
            quoted = (np.searchsorted(q, w.start[at]) > np.searchsorted(q, lo)) & (np.searchsorted(q, hi) > np.searchsorted(q, w.end[at]))
            np.add.at(out, (row, np.where(per_word[at] == 2, 0, 1) + 2 * quoted), 1)
        plain, quoted = out[:, 0] + self.misspelled * out[:, 1], out[:, 2] + self.misspelled * out[:, 3]
        return np.log1p(np.stack([plain, 100 * plain / np.maximum(w.count, 1), quoted], axis=1)), out


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, p: ToxicityParams) -> DataFrame:
    """text, toxic of at most p.fit_rows labelled training rows, as a written table."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.fit_rows)
    text = doc_texts(docs).join(F.broadcast(known), "doc_id").groupBy(F.xxhash64("text").alias("key")).agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return written(text.select("text", "toxic"), "sample")


def _prefixes(text: str | None, p: ToxicityParams) -> set[str]:
    out: set[str] = set()
    for c in K.chunks(pa.array([text], pa.string())):
        w = c.words(K.ALNUM_WORD, lower=True)
        _, at = np.unique(w.key, return_index=True)
        for i in at.tolist():
            t = c.buf[w.start[i] : w.end[i]].tobytes().decode().lower()
            out.update(t[:k] for k in range(p.min_prefix, min(len(t), p.max_prefix) + 1))
            if p.min_prefix <= len(t) <= p.max_prefix:
                out.add(t + " ")  # the whole word
    return out


def _backwards(t: str) -> tuple[int, ...]:
    """Sorts strings in falling order."""
    return tuple(-ord(ch) for ch in t) + (1,)


def learn_lexicon(sample: DataFrame, p: ToxicityParams) -> Lexicon:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: dict[str, int] = {}
        for b in batches:
            for text, label in zip(*(b.column(k).to_pylist() for k in (0, 1))):
                if label == 1:
                    for x in _prefixes(text, p):
                        toxic[x] = toxic.get(x, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(toxic), pa.string()), pa.array(list(toxic.values()), pa.int64())], names=["term", "n"])

    n_toxic = sample.filter("toxic = 1").count()
    n_clean = sample.filter("toxic <> 1").count()
    if not n_toxic:
        return Lexicon([], [])
    rows = sample.filter("toxic = 1").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= p.min_support)
    support = {r.term: r.n for r in rows.collect()}  # no more than the sample's words have
    wanted = frozenset(support)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[str, int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                for x in _prefixes(text, p) & wanted:
                    got[x] = got.get(x, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], names=["term", "n"])

    false = {r.term: r.n for r in sample.filter("toxic <> 1").mapInArrow(clean, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    rate = lambda t: support[t] / n_toxic / (support[t] / n_toxic + (false.get(t, 0) + 0.01) / max(n_clean, 1))
    good = sorted((t for t in support if not t.endswith(" ") and rate(t) >= p.min_precision), key=lambda t: (-support[t], len(t), t))
    keep = frozenset(good)

    def who(b: pa.RecordBatch):
        for text in b.column(0).to_pylist():
            hits = sorted(_prefixes(text, p) & keep)
            yield pa.RecordBatch.from_arrays([pa.array([hits], pa.list_(pa.string()))], names=["terms"])

    holders: dict[str, list[int]] = {}
    for i, r in enumerate(map_batches(sample.filter("toxic = 1").select("text"), who, "terms array<string>").collect()):
        for t in r.terms:
            holders.setdefault(t, []).append(i)
    left, words, stems = set(range(n_toxic)), [], []
    open_ = {t: set(h) for t, h in holders.items()}
    rank = {t: k for k, t in enumerate(sorted(open_, key=lambda t: (-support[t], len(t), _backwards(t))))}
    heap = [(-len(h), rank[t], t) for t, h in open_.items()]  # gains only fall, so a gain is counted anew when it is on top
    heapq.heapify(heap)
    frequent = sorted(open_, key=rank.get, reverse=True)
    while open_:
        while heap and heap[0][2] not in open_:
            heapq.heappop(heap)
        gain, at, t = heap[0]
        if -gain >= p.min_support and (now := len(open_[t] & left)) < -gain:
            heapq.heapreplace(heap, (-now, at, t))
            continue
        if -gain < p.min_support:  # nothing new but what is common by itself
            while frequent[-1] not in open_:
                frequent.pop()
            t = frequent[-1]
            if support[t] < p.common * n_toxic:
                break
        longer = [x for x in open_ if x.startswith(t) and support[x] >= 0.8 * support[t]]
        term = max(longer, key=len)
        (words if support.get(term + " ", 0) >= 0.5 * support[term] else stems).append(term)
        left -= open_[t]
        for x in [x for x in open_ if x.startswith(t)]:
            del open_[x]
    return Lexicon(words, stems)


def harmless_words(sample: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Words near or within reach of terms that clean training documents hold at least as readily as toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[str, int], int] = {}
        for b in batches:
            for text, toxic in zip(*(b.column(k).to_pylist() for k in (0, 1))):
                for c in K.chunks(pa.array([text], pa.string())):
                    w = c.words(K.ALNUM_WORD, lower=True)
                    _, at = np.unique(w.key, return_index=True)
                    for i in at.tolist():
                        word = c.buf[w.start[i] : w.end[i]].tobytes().decode().lower()
                        if lexicon.match(word):
                            got[word, int(toxic == 1)] = got.get((word, int(toxic == 1)), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.int64()), pa.array(list(got.values()), pa.int64())], names=["word", "toxic", "n"])

    size = {r.toxic: r.n for r in sample.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    counts = sample.mapInArrow(run, "word string, toxic long, n long").groupBy("word").pivot("toxic", [0, 1]).agg(F.sum("n")).filter("`0` is not null").collect()
    ratio = max(size.get(1, 0), 1) / max(size.get(0, 0), 1)
    return frozenset(r["word"] for r in counts if r["0"] * (ratio if lexicon.match(r["word"]) == 2 else 1) >= (r["1"] or 0))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights with the intercept last, by Newton steps; none but the intercept is negative, since no hit speaks for a text."""
    free = np.ones(x.shape[1], bool)
    while True:
        w = np.zeros(x.shape[1] + 1)
        w[np.append(free, True)] = _newton(x[:, free], y, ridge)
        if (w[:-1] >= 0).all():
            return w
        free &= w[:-1] >= 0


def centred(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights whose intercept puts the score 0.5 where the sample's balanced accuracy is best, in the middle of a gap; toxic rows are rare."""
    z = x @ w[:-1]
    at = np.unique(z)
    if len(at) < 2 or not (y < 1).any():
        return w
    cuts = (at[1:] + at[:-1]) / 2
    below = lambda v: np.searchsorted(np.sort(v), cuts)
    good = below(z[y < 1]) / (y < 1).sum() - below(z[y == 1]) / y.sum()
    return np.append(w[:-1], -cuts[int(np.argmax(good))])


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    weights: np.ndarray
    params: ToxicityParams


def fit(docs: DataFrame, labels: DataFrame, p: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    sample = training_sample(docs, labels, p)
    lexicon = learn_lexicon(sample, p)
    lexicon.harmless = harmless_words(sample, lexicon)

    def run(b: pa.RecordBatch):
        features = Features(lexicon, p)
        for c in K.chunks(b.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(list(features(c)[0]), pa.list_(pa.float64())), b.column(1).slice(c.first, c.n)], names=["x", "toxic"])

    rows = map_batches(sample, run, "x array<double>, toxic int").collect()
    y = np.array([float(r.toxic == 1) for r in rows])
    if not y.any():
        return ToxicityModel(lexicon, np.array([0.0] * 3 + [-30.0]), p)
    x = np.array([r.x for r in rows])
    return ToxicityModel(lexicon, centred(fit_logistic(x, y, p.ridge), x, y), p)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, n_exact, n_misspelled, n_quoted for every row of docs."""
    w, sent = model.weights, docs.sparkSession.sparkContext.broadcast(model)  # as large as the words of fit_rows texts allow

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(sent.value.lexicon, sent.value.params)
        for b in batches:
            for c in K.chunks(b.column(1)):
                x, n = features(c)
                s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n), pa.array(s), pa.array(n[:, 0] + n[:, 2]), pa.array(n[:, 1] + n[:, 3]), pa.array(n[:, 2] + n[:, 3])], names=["doc_id", "score", "n_exact", "n_misspelled", "n_quoted"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, score double, n_exact long, n_misspelled long, n_quoted long")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_exact", "n_misspelled", "n_quoted")
