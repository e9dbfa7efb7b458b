"""Operator 3, benchmark decontamination with suffix arrays of the training text.

Words are runs of letters, digits and everything beyond ASCII, A-Z lowered.
Each shard of the training text (a chunk of a partition) gets a suffix array
over its words. It is sparse: a suffix is entered only if its first words
(as many as the shortest benchmark window has, three at most) begin some
benchmark suffix, since no other can match. Every benchmark suffix is
binary-searched in every shard; the range found gives the occurrences of its
window, and extending them word by word gives the longest verbatim matches
with their places.

The benchmark is the stated query set. It is sent to the executors in blocks
of at most ``block_words`` words, one broadcast each, so no broadcast grows
with the benchmark; the training text is read once and never shuffled.

Defined results: a null or empty text, of a document or an item, has no words
and no windows; an item shorter than the window is one window; a null item_id
counts and is written as the empty string; items sharing an id are one item;
repeated rows are reported row by row; empty tables give no hits or no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import doc_texts, filter_batches, map_batches, table

WINDOW = 10
BLOCK_WORDS = 1 << 20


class Suffixes:
    """Suffixes of one block of benchmark items, and their windows by length."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        self.window = window
        keys, offs = [], [0]
        for c in K.chunks(pa.array(texts, pa.string())):
            w = c.words(K.ALNUM_WORD, lower=True)
            keys.append(w.key)
            offs += list(offs[-1] + w.offs[1:])
        self.key = np.concatenate([*keys, np.zeros(1, np.uint64)])
        self.offs, self.ids = np.array(offs), ids
        count = np.diff(self.offs)
        self.item = np.repeat(np.arange(len(count)), count)
        left = np.repeat(self.offs[1:], count) - np.arange(len(self.item))  # words from a suffix's start to its end
        length = np.minimum(window, count)[self.item]
        start = np.flatnonzero(left >= length)
        self.by_length = {int(n): start[length[start] == n] for n in np.unique(length[start])}
        self.head = min([3, *self.by_length])
        self.heads = np.unique(np.concatenate([K.gram_hash([self.key[s + j] for j in range(self.head)]) for s in self.by_length.values()])) if self.by_length else np.empty(0, np.uint64)


def _columns(key: np.ndarray, at: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The first width words of suffixes, 0 beyond the text's end."""
    place = at[None, :] + np.arange(width)[:, None]
    return np.where(place < end[None, :], key[np.minimum(place, len(key) - 1)], np.uint64(0))


def _search(rows: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of all wanted prefixes (columns) at once in sorted suffixes."""
    lo, hi = np.zeros(want.shape[1], np.int64), np.full(want.shape[1], rows.shape[1], np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        less, tied = np.zeros(len(open_), bool), np.ones(len(open_), bool)
        for k in range(want.shape[0]):
            a, b = rows[k, mid], want[k, open_]
            less |= tied & (a < b)
            tied &= a == b
        up = less | (tied if right else False)
        lo[open_[up]] = mid[up] + 1
        hi[open_[~up]] = mid[~up]


def occurrences(c: K.Chunk, w: K.Words, s: Suffixes) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(word place in the chunk, suffix place in the block, length) of every window found."""
    if not len(s.heads) or len(w.key) < s.head:
        return
    gram, at = w.grams(s.head)
    i = np.searchsorted(s.heads, gram)
    i[i == len(s.heads)] = 0
    at = at[s.heads[i] == gram]
    if not len(at):
        return
    end = np.repeat(w.offs[1:], w.count)[at]
    rows = _columns(w.key, at, end, s.window)
    order = np.lexsort(rows[::-1])
    rows, at, end = rows[:, order], at[order], end[order]
    for n, start in s.by_length.items():
        want = np.stack([s.key[start + j] for j in range(n)])
        lo, hi = _search(rows, want, False), _search(rows, want, True)
        found = np.flatnonzero(hi > lo)
        size = (hi - lo)[found]
        if not len(size):
            continue
        place = np.repeat(lo[found] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        ok = at[place] + n <= end[place]
        yield at[place][ok], np.repeat(start[found], size)[ok], n


def blocks(bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> list[Broadcast]:
    """The benchmark as broadcasts of bounded size."""
    sc, out, ids, texts, size = bench.sparkSession.sparkContext, [], [], [], 0
    rows = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").cast("string").alias("t"))
    for r in rows.toLocalIterator():
        ids.append(r.i)
        texts.append(r.t)
        size += len(r.t or "") // 2
        if size >= block_words:
            out.append(sc.broadcast(Suffixes(ids, texts, window)))
            ids, texts, size = [], [], 0
    if ids:
        out.append(sc.broadcast(Suffixes(ids, texts, window)))
    return out


def _hits(c: K.Chunk, sent: list[Broadcast]) -> tuple[K.Words, np.ndarray, list[set[str]], list[tuple | None]]:
    """Words, words hit and items of each row, and its longest match (-length, word place, item, item's word place)."""
    w = c.words(K.ALNUM_WORD, lower=True)
    d = np.zeros(len(w.key) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(c.n)]
    best: list[tuple | None] = [None] * c.n
    for b in sent:
        s = b.value
        for at, suffix, n in occurrences(c, w, s):
            np.add.at(d, at, 1)
            np.add.at(d, at + n, -1)
            row = np.searchsorted(w.offs, at, "right") - 1
            for r, i in np.unique(np.stack([row, s.item[suffix]]), axis=1).T:
                items[r].add(s.ids[i])
            for r, p, i, q, k in zip(*(x.tolist() for x in maximal(w, s, at, suffix, n))):
                if best[r] is None or -k <= best[r][0]:
                    now = (-k, p, s.ids[i], q)
                    best[r] = now if best[r] is None else min(best[r], now)
    return w, K.span_sums(np.cumsum(d[:-1]) > 0, w.offs), items, best


def maximal(w: K.Words, s: Suffixes, at: np.ndarray, suffix: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Row, word place in the row, item, word place in the item and length of the maximal matches that begin with windows found."""
    row, item = np.searchsorted(w.offs, at, "right") - 1, s.item[suffix]
    lo, q0 = w.offs[row], s.offs[item]
    inner = (at > lo) & (suffix > q0)
    first = ~inner | (w.key[np.maximum(at - 1, 0)] != s.key[np.maximum(suffix - 1, 0)])  # others are reported from further left
    at, suffix, row, item = at[first], suffix[first], row[first], item[first]
    room = np.minimum(w.offs[row + 1] - at, s.offs[item + 1] - suffix)
    size = np.full(len(at), n)
    alive = np.flatnonzero(size < room)
    while len(alive):
        alive = alive[w.key[at[alive] + size[alive]] == s.key[suffix[alive] + size[alive]]]
        size[alive] += 1
        alive = alive[size[alive] < room[alive]]
    return row, at - w.offs[row], item, suffix - s.offs[item], size


LONGEST = ["longest_match", "longest_item", "longest_doc_word", "longest_item_word"]


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs: words, words hit, items found, whether contaminated, and the longest verbatim match.

    Of longest matches the first in the document counts, of its items the least
    id as a string, then the first place; without a match its length is 0, its item the empty string and its places -1.
    """
    sent = blocks(bench, window, block_words)

    def run(b: pa.RecordBatch):
        for c in K.chunks(b.column(1)):
            w, hit, items, best = _hits(c, sent)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(c.first, c.n), pa.array(w.count, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]), pa.array(hit > 0),
                    *(pa.array([(-x[k] if k == 0 else x[k]) if x else none for x in best], t) for k, t, none in ((0, pa.int64(), 0), (2, pa.string(), ""), (1, pa.int64(), -1), (3, pa.int64(), -1))),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *LONGEST],
            )

    return map_batches(doc_texts(docs), run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_item string, longest_doc_word long, longest_item_word long")


def longest_matches(docs: DataFrame, bench: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Maximal verbatim matches of at least a window: doc_id, word place, item_id, item word place, length in words."""
    sent = blocks(bench, window, block_words)

    def run(b: pa.RecordBatch):
        for c in K.chunks(b.column(1)):
            w = c.words(K.ALNUM_WORD, lower=True)
            out: list[list] = [[], [], [], [], []]
            for s in (x.value for x in sent):
                for at, suffix, n in occurrences(c, w, s):
                    row, place, item, item_place, size = maximal(w, s, at, suffix, n)
                    for col, v in zip(out, (row + c.first, place, [s.ids[i] for i in item], item_place, size)):
                        col.extend(v if isinstance(v, list) else v.tolist())
            if out[0]:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(out[0])), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], names=["doc_id", "doc_word", "item_id", "item_word", "n_match"])

    return map_batches(doc_texts(docs), run, "doc_id long, doc_word long, item_id string, item_word long, n_match long")


def keep_uncontaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """Docs' own columns, rows with any word hit removed."""
    sent = blocks(bench, window)
    return filter_batches(docs, lambda c: _hits(c, sent)[1] == 0)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def cte_sql(docs: str = "documents", p: str = "", window: int = WINDOW) -> str:
    """DuckDB: CTEs giving {p}hits(rid, doc_id, ...)."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
{p}cd as (select row_number() over () as rid, doc_id, {words} as ws from {docs}),
{p}cb as (select coalesce(item_id::varchar, '') as item, ws, least({window}, len(ws)) as n from (select item_id, {words} as ws from benchmark) where len(ws) > 0),
{p}cw as (select distinct item, n, array_to_string(ws[i:i + n - 1], ' ') as win from (select item, n, ws, unnest(range(1, len(ws) - n + 2)) as i from {p}cb)),
{p}cn as (select distinct n from {p}cb),
{p}cg as (select rid, n, i, array_to_string(ws[i:i + n - 1], ' ') as win from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) as i from {p}cd, {p}cn where len(ws) >= n)),
{p}cm as (select g.rid, g.i, g.n, w.item from {p}cg g join {p}cw w using (n, win)),
{p}ch as (select rid, count(distinct k) as n_hit from (select rid, unnest(range(i, i + n)) as k from {p}cm) group by rid),
{p}ci as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from {p}cm) group by rid),
{p}cp as (select rb, item, n, j, array_to_string(ws[j:j + n - 1], ' ') as win from (select rb, item, n, ws, unnest(range(1, len(ws) - n + 2)) as j from (select row_number() over () as rb, * from {p}cb))),
{p}cr as (select rid, item, i, j, n, i - row_number() over (partition by rid, rb, i - j order by i) as island, rb from {p}cg join {p}cp using (n, win)),
{p}cl as (select rid, item, min(i) - 1 as di, min(j) - 1 as dj, count(*) + max(n) - 1 as k from {p}cr group by rid, rb, item, i - j, island),
{p}cx as (select rid, k as longest_match, item as longest_item, di as longest_doc_word, dj as longest_item_word from (select *, row_number() over (partition by rid order by k desc, di, item, dj) as r from {p}cl) where r = 1),
{p}hits as (select rid, doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(longest_match, 0) as longest_match, coalesce(longest_item, '') as longest_item, coalesce(longest_doc_word, -1) as longest_doc_word, coalesce(longest_item_word, -1) as longest_item_word
  from {p}cd left join {p}ch using (rid) left join {p}ci using (rid) left join {p}cx using (rid))"""


def oracle() -> str:
    return f"with {cte_sql().strip()} select * exclude (rid) from hits"
