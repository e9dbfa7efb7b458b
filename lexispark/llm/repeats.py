"""Operator 9, suffix-array dedup with a run-length index.

Every byte covered by a ``length``-byte string that also starts elsewhere (in
any document, or in the same one) is removed. Windows of that length are
routed by their anchor, the least hash among their ``ANCHOR``-byte substrings:
equal windows have equal anchors, so only windows that share one need meet.
Consecutive windows with one anchor form a segment, about one for every
80 bytes of text, and only its hashes and place are shuffled at first.
Anchors seen once are dropped by an aggregation; where all segments of an
anchor are equal, or a segment occurs twice, it is marked by its hash. Distinct
segments that share an anchor are fetched as text, once each, and indexed:
a bin of them gets a run-compressed Burrows-Wheeler transform with suffix
positions sampled at the run ends. Matching statistics are streamed from those
samples: within a run the match with the neighbouring suffix only loses its
first byte, so the matches at the run ends cover all others. Matches of at
least ``length`` bytes are marked on both sides.

An anchor with more than ``BIN_SEGMENTS`` distinct segments is not indexed in
one task: the hashes of its windows are counted instead, which is as exact and
may be split at will.

A text moves only if its document has a distinct segment to index or a mark;
the set of those documents is broadcast if it has at most ``BROADCAST_IDS``
members, else the join shuffles.

Defined results: a null text is empty; a text shorter than the window keeps
all; rows that are equal are each other's repeats; rows sharing a doc_id but not
a text are judged apart; null doc_ids are carried; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .common import doc_texts, forget, map_batches, table, written

LENGTH = 200
ANCHOR = 40
BIN_SEGMENTS = 4096
BIN_BYTES = 1 << 20
BROADCAST_IDS = 1 << 20


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least of h[i:i + w] for every i that has so many."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    blocks = np.full(-(-len(h) // w) * w, np.iinfo(h.dtype).max, h.dtype)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def segments(c: K.Chunk, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Row, start (in the row), size, anchor hash, segment hash of every segment, and whether its anchor stands in it twice."""
    span, empty = length - anchor + 1, (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2 + (np.empty(0, bool),)
    if len(c.buf) < length:
        return empty
    prefix = K.prefix_hash(K.BYTE_CODE[c.buf])
    at = np.arange(len(c.buf) - anchor + 1)
    value = K.span_hash(prefix, at, at + anchor)
    least = sliding_min(value, span)
    # A place is an anchor of some window if it equals the greatest of the minima of the windows it is in.
    edge = np.zeros(span - 1, np.uint64)
    spots = np.flatnonzero(value == ~sliding_min(~np.concatenate([edge, least, edge]), span))
    twin = np.flatnonzero((value[spots[1:]] == value[spots[:-1]]) & (np.diff(spots) < span))
    twin, twin_end = spots[twin], spots[twin + 1] + anchor
    room = np.diff(c.offs) - length + 1
    rows = np.flatnonzero(room > 0)
    if not len(rows):
        return empty
    first, room = c.offs[rows], room[rows]
    base = np.cumsum(room) - room
    place = np.arange(room.sum()) + np.repeat(first - base, room)  # starts of windows
    value = least[place]
    cut = np.append(True, value[1:] != value[:-1])
    cut[base] = True
    start = np.flatnonzero(cut)
    n = np.diff(np.append(start, len(place)))
    pieces = -(-n // span)  # longer runs come from periodic text
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    n = np.minimum(span, np.repeat(n, pieces) - nth * span)
    start = np.repeat(start, pieces) + nth * span
    row = rows[np.searchsorted(base, start, "right") - 1]
    begin = place[start]
    size = n - 1 + length
    near = np.searchsorted(twin, begin)
    own = np.append(twin_end, len(c.buf) + 1)[near] <= begin + size
    return row, begin - c.offs[row], size, value[start], K.span_hash(prefix, begin, begin + size), own


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of some strings, sampled at its run ends.

    Suffixes with fewer than length bytes left in their string are left out:
    they can't begin a match, and none of the others needs them, since a suffix
    that stands left of an entered one is entered.
    """

    def __init__(self, strings: list[bytes], length: int):
        sizes = np.array([len(s) for s in strings])
        ends = np.cumsum(sizes + 1) - 1  # places of separators
        raw = np.frombuffer(b"\0".join([*strings, b""]), np.uint8)
        sym = raw.astype(np.int64) + 1
        sym[ends] = 0
        n = len(sym)
        self.starts = ends - sizes
        self.string = np.repeat(np.arange(len(strings)), sizes + 1)
        left = ends[self.string] - np.arange(n)
        padded = np.append(sym, np.zeros(8, np.int64))
        key = np.zeros(n, np.int64)
        for j in range(7):
            key = (key << 9) | padded[j : j + n]
        h, self.levels, rank = 7, [], np.empty(n, np.int64)
        order, spots = np.argsort(key), np.arange(n)
        part, k = order, key[order]
        # A suffix that is like no other has its place in the order; only the others' places (spots) are sorted again.
        while True:
            new = np.append(True, (k[1:] != k[:-1]) | (left[part[1:]] < h))  # a separator is like no other
            rank[part] = spots[np.maximum.accumulate(np.where(new, np.arange(len(spots)), 0))]
            self.levels.append((h, rank.copy()))
            alike = np.append(~new[1:], False) | ~new
            spots, part = spots[alike], part[alike]
            if not len(spots):
                break
            key = rank[part] * (n + 1) + np.where(part + h < n, rank[np.minimum(part + h, n - 1)], 0)
            by = np.argsort(key)
            part, k = part[by], key[by]
            order[spots] = part
            h *= 2
        order = order[left[order] >= length]
        before = np.where(order == self.starts[self.string[order]], -1 - np.arange(len(order)), padded[order - 1])
        heads = np.flatnonzero(before[1:] != before[:-1]) + 1
        self.run_start, self.run_end = order[heads], order[heads - 1]  # samples on both sides of every run boundary
        self.runs, self.size = len(heads) + bool(len(order)), len(order)

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffixes i and j, separators matching nothing."""
        i, j, total = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        last = len(self.string) - 1
        for h, rank in reversed(self.levels):
            same = rank[np.minimum(i, last)] == rank[np.minimum(j, last)]
            step = np.where(same & (i <= last) & (j <= last), h, 0)
            i, j, total = i + step, j + step, total + step
        return total

    def statistics(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches (place, place, size) at the run ends, from which all others follow by dropping first bytes."""
        return self.run_start, self.run_end, self.extension(self.run_start, self.run_end)


def long_matches(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, start and size of stretches that cover all bytes of substrings of at least length that occur again."""
    ix = RunIndex(strings, length)
    i, j, size = ix.statistics()
    # Extension is exact to seven bytes; the rest is compared byte by byte.
    raw = b"\0".join([*strings, b""])
    text = np.frombuffer(raw, np.uint8)
    ends = np.append(ix.starts[1:] - 1, len(text) - 1)
    close = size >= length - 7
    i, j, size = i[close], j[close], size[close]
    room = np.minimum(ends[ix.string[i]] - i, ends[ix.string[j]] - j)
    alive = np.arange(len(i))
    for _ in range(7):
        alive = alive[size[alive] < room[alive]]
        alive = alive[text[i[alive] + size[alive]] == text[j[alive] + size[alive]]]
        size[alive] += 1
    ok = size >= length
    place, size = np.concatenate([i[ok], j[ok]]), np.tile(size[ok], 2)
    s = ix.string[place]
    return s, place - ix.starts[s], size


def _keyed(docs: DataFrame) -> DataFrame:
    d = doc_texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    return d.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("did"), F.xxhash64("doc_id", "text").alias("rid"), "text")


def _index(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Segments sorted by anchor, to marks of those that occur once; whole anchors at a time."""
    held: list[tuple] = []
    size = 0

    def marks() -> Iterator[pa.RecordBatch]:
        s, start, n = long_matches([r[5] for r in held], length)
        keep = [k for k in range(len(s)) if held[s[k]][1] == 1]
        if keep:
            rows = [held[s[k]] for k in keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] + int(start[k]) for r, k in zip(rows, keep)], pa.int32()), pa.array([int(n[k]) for k in keep], pa.int32())],
                names=["did", "rid", "start", "size"],
            )

    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(6))):
            if size > BIN_BYTES and r[0] != held[-1][0]:
                yield from marks()
                held, size = [], 0
            held.append(r)
            size += len(r[5])
    if held:
        yield from marks()


def marks(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, bin_segments: int = BIN_SEGMENTS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """did, rid, spans: for each document with a repeated window, the stretches that repeat."""
    d = _keyed(docs)
    place = ["did", "rid", "start", "size"]

    def cut(b: pa.RecordBatch):
        for c in K.chunks(b.column(2)):
            row, start, size, a, seg, own = segments(c, length, anchor)
            if len(row):
                at = pa.array(row + c.first)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(seg.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(own)], names=["anchor", "seg", *place, "own"])

    rows = map_batches(d.select("did", "rid", "text"), cut, "anchor long, seg long, did long, rid long, start int, size int, own boolean")
    again = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("seg").alias("lo"), F.max("seg").alias("hi"), F.max("own").alias("own")).filter("n > 1 or own").select("anchor", (F.expr("own or lo <> hi")).alias("many"))
    cand = written(rows.drop("own").join(again, "anchor"), "segments")
    segs = written(cand.filter("many").groupBy("anchor", "seg").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("at")), "distinct")
    hot = segs.groupBy("anchor").agg(F.count("*").alias("k")).filter(F.col("k") > bin_segments).select("anchor", F.lit(True).alias("hot"))
    equal = cand.filter("not many").select(*place).union(cand.filter("many").join(segs.filter("n > 1").select("anchor", "seg"), ["anchor", "seg"]).select(*place))

    wanted = segs.join(hot, "anchor", "left").select("anchor", "n", "at.*", F.coalesce("hot", F.lit(False)).alias("hot"))
    wanted = written(wanted.groupBy("did", "rid").agg(F.collect_list(F.struct("anchor", "n", "start", "size", "hot")).alias("cuts")), "wanted")
    picked = some(d, wanted, broadcast_ids).join(wanted, ["did", "rid"]).select("did", "rid", "text", "cuts")

    def fetch(b: pa.RecordBatch):
        out: list[list] = [[] for _ in range(7)]
        for did, rid, text, cuts in zip(*(b.column(k).to_pylist() for k in range(4))):
            raw = text.encode()
            for x in cuts:
                for col, v in zip(out, (x["anchor"], x["n"], did, rid, x["start"], raw[x["start"] : x["start"] + x["size"]], x["hot"])):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()))], names=["anchor", "n", "did", "rid", "start", "bytes", "hot"])

    cuts = written(map_batches(picked, fetch, "anchor long, n long, did long, rid long, start int, bytes binary, hot boolean").dropDuplicates(["anchor", "did", "rid", "start"]), "cuts")
    bins = cuts.filter("not hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor")
    indexed = bins.mapInArrow(lambda batches: _index(batches, length), "did long, rid long, start int, size int")

    def windows(b: pa.RecordBatch):
        for c in K.chunks(b.column(5)):
            prefix = K.prefix_hash(K.BYTE_CODE[c.buf])
            n = np.diff(c.offs) - length + 1
            row = np.repeat(np.arange(c.n), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            key = K.span_hash(prefix, c.offs[row] + at, c.offs[row] + at + length)
            take = pa.array(row + c.first)
            start = b.column(4).take(take).to_numpy() + at
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(key.view(np.int64)), b.column(1).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(start, pa.int32())], names=["anchor", "key", "n", "did", "rid", "start"])

    each = map_batches(cuts.filter("hot").drop("hot"), windows, "anchor long, key long, n long, did long, rid long, start int")
    twice = each.groupBy("anchor", "key").agg(F.sum("n").alias("all")).filter(F.col("all") > 1).select("anchor", "key")
    counted = each.filter("n = 1").join(twice, ["anchor", "key"]).select("did", "rid", "start", F.lit(length).alias("size"))

    out = equal.union(indexed).union(counted).groupBy("did", "rid").agg(F.collect_set(F.struct("start", "size")).alias("spans"))
    out = written(out, "marks")
    for t in (cand, segs, wanted, cuts):
        forget(t)
    return out


def some(d: DataFrame, ids: DataFrame, bound: int) -> DataFrame:
    """Rows of d whose (did, rid) is in ids, if those are few enough to broadcast; else d as it is."""
    return d.join(F.broadcast(ids.select("did", "rid")), ["did", "rid"], "left_semi") if ids.count() <= bound else d


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, bin_segments: int = BIN_SEGMENTS, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, which may split a character) per row of docs."""
    d = _keyed(docs)
    found = marks(docs, length, anchor, bin_segments, broadcast_ids)
    if found.count() <= broadcast_ids:
        ids = F.broadcast(found.select("did", "rid"))
        clean = d.join(ids, ["did", "rid"], "left_anti").withColumn("spans", F.lit(None).cast(found.schema["spans"].dataType))
        both = d.join(ids, ["did", "rid"], "left_semi").join(found, ["did", "rid"]).select(*clean.columns).union(clean)
    else:
        both = d.join(found, ["did", "rid"], "left")

    def run(b: pa.RecordBatch):
        out: list[list] = [[], [], [], []]
        for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw, kept, end, removed, n = text.encode(), [], 0, 0, 0
            for s in sorted((x["start"], x["start"] + x["size"]) for x in spans or ()):
                if s[0] > end or not n:
                    kept.append(raw[end : s[0]])
                    n += 1
                    end = s[0]
                if s[1] > end:
                    removed += s[1] - end
                    end = s[1]
            kept.append(raw[end:])
            for col, v in zip(out, (len(raw), removed, n, b"".join(kept))):
                col.append(v)
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return map_batches(both.select("doc_id", "text", "spans"), run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = remove_repeats(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
