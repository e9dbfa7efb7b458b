"""Counts of neighbours and look-ups of tokens, a chunk of lines at a time.

A chunk's tokens become numbers, its pairs are counted as numbers, and what is
shuffled is one packed row a source: its destinations in one string, their
counts in one block of integers. A source's rows meet sorted, so its totals and
its best links need no further shuffle; of a source only distinct entries are
held. Tokens are letters and marks without blanks, which part packed words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.models import load, save

CHUNK = 1 << 20  # tokens counted at a time
ROW = 1024  # entries of a packed row
HELD = 1 << 21  # entries of packed rows added up at a time


def pieces_of(batches: Iterator[pa.RecordBatch], at: int, limit: int = 0) -> Iterator[pa.Table]:
    """The rows in tables of about limit tokens in the list column; a single row may have more."""
    limit = limit or CHUNK
    held, n = [], 0
    for b in batches:
        first, sizes = 0, np.cumsum(pc.list_value_length(b.column(at)).fill_null(0).to_numpy(zero_copy_only=False))
        while first < b.num_rows:
            gone = sizes[first - 1] if first else 0
            last = min(max(int(np.searchsorted(sizes, gone + limit - n)) + 1, first + 1), b.num_rows)
            held.append(b.slice(first, last - first))
            n += int(sizes[last - 1] - gone)
            first = last
            if n >= limit:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def coded(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Number of every token, length of every list, and the distinct words."""
    whole = lists.combine_chunks()
    d = whole.flatten().dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_value_length(whole).to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def framed(codes: np.ndarray, sizes: np.ndarray, first: int | None, last: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a code before and after them, and their lengths."""
    before, after = int(first is not None), int(last is not None)
    line = np.repeat(np.arange(len(sizes)), sizes)
    out = np.empty(len(codes) + (before + after) * len(sizes), np.int64)
    out[np.arange(len(codes)) + before + (before + after) * line] = codes
    ends = np.cumsum(sizes + before + after)
    if before:
        out[ends - sizes - 1 - after] = first
    if after:
        out[ends - 1] = last
    return out, sizes + before + after


def pair_keys(codes: np.ndarray, sizes: np.ndarray, d: int, n: int) -> np.ndarray:
    line = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    same = line[d:] == line[:-d]
    return codes[:-d][same] * n + codes[d:][same]


def summed(key: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their weights."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(weight[order], first) if len(key) else weight


def rounded(cnt: np.ndarray, total: np.ndarray, digits: int = 9) -> np.ndarray:
    """cnt / total as Spark rounds it, halves up by the shortest decimals of the ratio."""
    x = cnt / total
    scaled = x * 10.0**digits
    out = np.floor(scaled + 0.5) / 10.0**digits
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[k] = float(Decimal(repr(float(x[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def joined(*batches: list[pa.Array]) -> list[pa.Array]:
    return [pa.concat_arrays([b[k] for b in batches]) for k in range(3)]


def pack(words: pa.StringArray, head: np.ndarray, tail: np.ndarray, value: np.ndarray, heads: pa.StringArray | None = None) -> list[pa.Array]:
    """Sources (of heads, or of words), their destinations and values; entries come sorted by head."""
    new = np.flatnonzero(head[1:] != head[:-1]) + 1
    starts = np.concatenate([[0], new]).astype(np.int64) if len(head) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(head)))
    parts = -(-sizes // ROW)
    starts = np.repeat(starts, parts) + ROW * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    cuts = np.append(starts, len(head)).astype(np.int64)
    spaced = pc.binary_join_element_wise(words, "", " ").take(pa.array(tail))
    at = np.frombuffer(spaced.buffers()[1], np.int32)[: len(tail) + 1] if len(tail) else np.zeros(1, np.int32)
    tails = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at[cuts].astype(np.int32)), spaced.buffers()[2]])
    values = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((cuts * 4).astype(np.int32)), pa.py_buffer(value.astype(np.uint32))])
    return [(words if heads is None else heads).take(pa.array(head[starts])), tails, values]


def _data(c: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    whole = np.frombuffer(c.buffers()[2], np.uint8) if c.buffers()[2] is not None else np.empty(0, np.uint8)
    return np.frombuffer(whole[at[0] : at[-1]].tobytes(), kind), np.diff(at)


def words_in(c: pa.Array) -> pa.StringArray:
    """All words of packed strings, each with its blank."""
    text, _ = _data(c, np.uint8)
    ends = np.concatenate([[0], np.flatnonzero(text == 32) + 1]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(text)])


class Entries:
    """Sources in order, destinations, kinds and sums, each source and destination once a kind."""

    def __init__(self, src: pa.StringArray, dst: pa.StringArray, head: np.ndarray, tail: np.ndarray, kind: np.ndarray, n: np.ndarray):
        self.src, self.dst, self.head, self.tail, self.kind, self.n = src, dst, head, tail, kind, n

    @staticmethod
    def of(parts: list[tuple[pa.Array, pa.Array, pa.Array, np.ndarray, np.ndarray]], kinds: int) -> Entries:
        """Of source, row size, destination, kind and count; sources come in order."""
        s = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
        d = pa.chunked_array([p[2] for p in parts]).combine_chunks().dictionary_encode()
        head = np.repeat(s.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([p[1] for p in parts]))
        key = (head * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False)) * kinds + np.concatenate([p[3] for p in parts])
        n = np.concatenate([p[4] for p in parts])
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        n = np.add.reduceat(n[order], first) if len(key) else n
        key = key[first]
        head, rest = np.divmod(key, len(d.dictionary) * kinds or 1)
        return Entries(s.dictionary, d.dictionary, head, rest // kinds, rest % kinds, n)

    def part(self) -> tuple:
        return self.src.take(pa.array(self.head)), np.ones(len(self.head), np.int64), self.dst.take(pa.array(self.tail)), self.kind, self.n

    def where(self, keep: np.ndarray) -> Entries:
        return Entries(self.src, self.dst, self.head[keep], self.tail[keep], self.kind[keep], self.n[keep])

    def best(self, top: int, names: list[str], exempt: tuple[str, ...]) -> Entries:
        """The top entries of each source by sum, then destination, then kind; exempt sources keep all."""
        place = np.empty(len(self.dst), np.int64)
        place[pc.sort_indices(pc.utf8_rtrim(self.dst, " ")).to_numpy()] = np.arange(len(self.dst))
        kind = np.argsort(np.argsort(names))[self.kind]
        order = np.lexsort((kind, place[self.tail], -self.n, self.head))
        head = self.head[order]
        first = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(head) else np.empty(0, np.int64)
        rank = np.arange(len(head)) - np.repeat(first, np.diff(np.append(first, len(head))))
        free = pc.is_in(self.src, value_set=pa.array(exempt, pa.string())).to_numpy(zero_copy_only=False)[head] if exempt else False
        return self.where(np.sort(order[(rank < top) | free]))

    def totals(self) -> np.ndarray:
        return np.bincount(self.head, self.n, len(self.src)).astype(np.int64)[self.head] if len(self.head) else self.n


def unpacked(b: pa.RecordBatch, kinds: int) -> tuple:
    """Source, row size, destination, kind and count of packed rows (src, tails, vals)."""
    value, size = _data(b.column("vals"), np.uint32)
    value = value.astype(np.int64)
    return b.column("src"), size // 4, words_in(b.column("tails")), value % kinds, value // kinds


def by_source(batches: Iterator[pa.RecordBatch], kinds: int) -> Iterator[Entries]:
    """Entries of sorted packed rows added up, all of a source's together."""
    held: list[tuple] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(unpacked(b, kinds))
        n += len(held[-1][2])
        if n >= HELD:
            e = Entries.of(held, kinds)
            last = e.head == len(e.src) - 1  # its other rows may follow
            if not last.all():
                yield e.where(~last)
            held = [e.where(last).part()]
            n = 0  # what is held is distinct, so it counts no more
    if held:
        yield Entries.of(held, kinds)


def counted(sents: DataFrame, count: Callable[[np.ndarray, np.ndarray, pa.StringArray], list[pa.Array]], names: list[str], top: int = 0, exempt: tuple[str, ...] = (), own: bool = False, least: int = 0) -> DataFrame:
    """src, dst, kind, cnt, total, score: packed counts of chunks added up, the source's total (with top, of its best entries alone) and the share in it.

    count gets a chunk's codes, line lengths and words, and packs entries whose value is the count times the number of names plus the kind's place.
    With own, entries without a destination are no rows: their counts are the sources' totals. Counts below least are dropped.
    """
    ship(sents.sparkSession)
    kinds = len(names)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces_of(batches, 0):
            codes, sizes, words = coded(t.column(0))
            if len(codes):
                yield pa.RecordBatch.from_arrays(count(codes, sizes[sizes > 0], words), names=["src", "tails", "vals"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = pa.array(names, pa.string())
        for e in by_source(batches, kinds):
            e = e.best(top, names, exempt) if top else e
            dst = pc.utf8_rtrim(e.dst, " ")
            if own:
                alone = (pc.binary_length(dst).to_numpy(zero_copy_only=False) == 0)[e.tail]
                of = np.zeros(len(e.src), np.int64)
                of[e.head[alone]] = e.n[alone]
                e = e.where(~alone)
                total = of[e.head]
            else:
                total = e.totals()
            if least:
                keep = e.n >= least
                e, total = e.where(keep), total[keep]
            for k in range(0, len(e.head), 1 << 16):
                x = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([e.src.take(pa.array(e.head[x])), dst.take(pa.array(e.tail[x])), label.take(pa.array(e.kind[x])), pa.array(e.n[x]), pa.array(total[x]), pa.array(rounded(e.n[x], total[x]))], names=["src", "dst", "kind", "cnt", "total", "score"])

    packed = sents.select("toks").mapInArrow(chunk, "src string, tails binary, vals binary")
    return packed.repartition("src").sortWithinPartitions("src").mapInArrow(finish, "src string, dst string, kind string, cnt long, total long, score double")


def added(packed: DataFrame, names: list[str]) -> DataFrame:
    """src, dst, kind, cnt of packed counts (src, tails, vals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = pa.array(names, pa.string())
        for e in by_source(batches, len(names)):
            dst = pc.utf8_rtrim(e.dst, " ")
            for k in range(0, len(e.head), 1 << 16):
                x = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([e.src.take(pa.array(e.head[x])), dst.take(pa.array(e.tail[x])), label.take(pa.array(e.kind[x])), pa.array(e.n[x])], names=["src", "dst", "kind", "cnt"])

    return packed.repartition("src").sortWithinPartitions("src").mapInArrow(run, "src string, dst string, kind string, cnt long")


def neighbours(distances: dict[int, int], kinds: int, first: str | None = None, last: str | None = None):
    """A count of pairs of tokens by distance: the kind's place of each, lines framed by first and last."""

    def count(codes: np.ndarray, sizes: np.ndarray, words: pa.StringArray) -> list[pa.Array]:
        extra = [x for x in (first, last) if x is not None]
        n = len(words)
        codes, sizes = framed(codes, sizes, n if first is not None else None, n + len(extra) - 1 if last is not None else None)
        words = pa.concat_arrays([words, pa.array(extra, pa.string())]) if extra else words
        key, got = np.unique(np.concatenate([pair_keys(codes, sizes, d, len(words)) * kinds + k for d, k in distances.items()]), return_counts=True)
        pair = key // kinds
        return pack(words, pair // len(words), pair % len(words), got * kinds + key % kinds)

    return count


def _places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every token in its line, and the line's length."""
    first = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - np.repeat(first, sizes), np.repeat(sizes, sizes)


def _pairs_then(codes: np.ndarray, at: np.ndarray, words: pa.StringArray, weight: np.ndarray) -> list[pa.Array]:
    """Packed counts of three tokens from the given places: the source is the first two."""
    n = len(words)
    first, which = np.unique(codes[at] * n + codes[at + 1], return_inverse=True)
    key, got = summed(which * n + codes[at + 2], weight)
    heads = pc.binary_join_element_wise(words.take(pa.array(first // n)), words.take(pa.array(first % n)), " ")
    return pack(words, key // n, key % n, got, heads)


def grams(longest: int, window: int = 0):
    """A count of runs of up to three tokens, each with as many as there are windows around it; single tokens have no destination."""

    def count(codes: np.ndarray, sizes: np.ndarray, words: pa.StringArray) -> list[pa.Array]:
        place, size = _places(sizes)
        words, n = pa.concat_arrays([words, pa.array([""])]), len(words) + 1

        def weigh(at: np.ndarray, length: int) -> np.ndarray:
            if not window:
                return np.ones(len(at), np.int64)
            p, last = place[at], np.maximum(size[at] - window, 0)
            return np.minimum(p, last) - np.maximum(p + length - window, 0) + 1

        one, two = np.arange(len(codes)), np.flatnonzero(place + 1 < size)
        key, got = summed(np.concatenate([codes * n + n - 1, codes[two] * n + codes[two + 1]]), np.concatenate([weigh(one, 1), weigh(two, 2)]))
        out = pack(words, key // n, key % n, got)
        if longest < 3:
            return out
        three = np.flatnonzero(place + 2 < size)
        return joined(out, _pairs_then(codes, three, words, weigh(three, 3)))

    return count


def prefixes(codes: np.ndarray, sizes: np.ndarray, words: pa.StringArray) -> list[pa.Array]:
    """Packed counts of the edges below the root of a trie of windows of three tokens."""
    place, size = _places(sizes)
    two, three = np.flatnonzero((place + 1 < size) & ((place + 3 <= size) | (place == 0))), np.flatnonzero(place + 2 < size)
    n = len(words)
    key, got = summed(codes[two] * n + codes[two + 1], np.ones(len(two), np.int64))
    return joined(pack(words, key // n, key % n, got), _pairs_then(codes, three, words, np.ones(len(three), np.int64)))


def nearness(window: int):
    """A count of unordered pairs weighted by sixtieths over their distance, the lesser token first."""

    def count(codes: np.ndarray, sizes: np.ndarray, words: pa.StringArray) -> list[pa.Array]:
        n = len(words)
        order = pc.sort_indices(words).to_numpy()
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        key = [pair_keys(place[codes], sizes, d, n) for d in range(1, window + 1)]
        weight = np.concatenate([np.full(len(k), 60 // d, np.int64) for d, k in enumerate(key, 1)])
        a, b = np.divmod(np.concatenate(key), n)
        key, got = summed(np.minimum(a, b) * n + np.maximum(a, b), weight)
        return pack(words.take(pa.array(order)), key // n, key % n, got)

    return count


def runs(length: int, spread: int = 4096):
    """A count of whole runs, packed under the remainder of their first three words' hash; a run's words are joined by _."""

    def count(codes: np.ndarray, sizes: np.ndarray, words: pa.StringArray) -> list[pa.Array]:
        place, size = _places(sizes)
        at = np.flatnonzero(place + length <= size)
        _, which = np.unique(codes[at] * len(words) + codes[at + 1], return_inverse=True)
        for k in range(2, length):
            _, which = np.unique(which * len(words) + codes[at + k], return_inverse=True)
        _, one, got = np.unique(which, return_index=True, return_counts=True)
        at = at[one]
        crc = np.array([zlib.crc32(w.encode()) for w in words.to_pylist()], np.uint64)
        bucket = (((crc[codes[at]] * np.uint64(31) + crc[codes[at + 1]]) * np.uint64(31) + crc[codes[at + 2]]) % np.uint64(spread)).astype(np.int64)
        order = np.lexsort((codes[at + 2], codes[at + 1], codes[at], bucket))
        text = pc.binary_join_element_wise(*(words.take(pa.array(codes[at[order] + k])) for k in range(length)), "_")
        return pack(text, bucket[order], np.arange(len(at)), got[order], pa.array([str(k) for k in range(spread)]))

    return count


def chunked(sents: DataFrame) -> DataFrame:
    """Lines (chunk, doc_id, line, text: their tokens) and the distinct tokens of every chunk (chunk, tok), written, so that chunks stay what they are."""
    ship(sents.sparkSession)
    id_type = dict(sents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for k, t in enumerate(pieces_of(batches, 2)):
            t = t.filter(pc.greater(pc.list_value_length(t.column(2)), 0)).combine_chunks()
            if not t.num_rows:
                continue
            chunk = (TaskContext.get().partitionId() << 24) + k
            toks = t.column(2).combine_chunks()
            words, n = toks.flatten().unique(), t.num_rows
            text = rendered(pc.binary_join_element_wise(toks.flatten(), "", " "), pc.list_value_length(toks).to_numpy(zero_copy_only=False))
            ids, m = t.column(0).combine_chunks(), len(words)
            none = lambda size, kind: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, chunk)), none(m, ids.type), none(m, pa.int32()), none(m, pa.string()), words], names=["chunk", "doc_id", "line", "text", "tok"])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), ids, t.column(1).combine_chunks(), text, none(n, pa.string())], names=["chunk", "doc_id", "line", "text", "tok"])

    return load(save(sents.select("doc_id", "line", "toks").mapInArrow(run, f"chunk long, doc_id {id_type}, line int, text string, tok string"), "chunks"))


def together(held: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of chunks with the same columns, every chunk in one place and in order."""
    n = max(2 * held.select("chunk").distinct().count(), 1)
    return rows.repartition(n, "chunk").sortWithinPartitions("chunk")


def looked_up(held: DataFrame, values: DataFrame) -> DataFrame:
    """Lines of chunks, and the values (tok and others) of their tokens, chunk by chunk."""
    others = [(c, t) for c, t in values.dtypes if c != "tok"]
    found = held.filter("tok is not null").select("chunk", "tok").join(values, "tok").select("chunk", *(F.lit(None).cast(t).alias(c) for c, t in held.dtypes[1:4]), "tok", *(c for c, _ in others))
    lines = held.filter("text is not null").select("*", *(F.lit(None).cast(t).alias(c) for c, t in others))
    return together(held, found.unionByName(lines))


def each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """All rows of a chunk at a time; the first column is the chunk."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        c = b.column(0).to_numpy()
        cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
        for i, j in zip([0, *cuts], [*cuts, b.num_rows]):
            if i == j:
                continue
            if held and held[-1].column(0)[0] != b.column(0)[int(i)]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole(c: pa.ChunkedArray) -> pa.Array:
    c = c.combine_chunks()
    return c if isinstance(c, pa.Array) else pa.concat_arrays(c.chunks)


def line_codes(text: pa.Array, toks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The place in toks of every token of the lines, -1 for none, and the lines' lengths."""
    d = words_in(pc.binary_join_element_wise(text, "", " ").cast(pa.binary())).dictionary_encode()
    at = pc.index_in(pc.utf8_rtrim(d.dictionary, " "), value_set=toks).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    return at[d.indices.to_numpy(zero_copy_only=False)], pc.count_substring(text, " ").to_numpy(zero_copy_only=False).astype(np.int64) + 1


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, sizes long, one after the other."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def rendered(parts: pa.StringArray, sizes: np.ndarray) -> pa.StringArray:
    """Strings of so many parts each, without the last one's last character, a separator."""
    out = parts.take(pa.array(np.arange(len(parts))))
    at, ends = np.frombuffer(out.buffers()[1], np.int32)[: len(out) + 1], np.cumsum(sizes)
    joined_ = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(at[np.concatenate([[0], ends])].astype(np.int32)), out.buffers()[2]])
    return pc.utf8_slice_codeunits(joined_, 0, -1)


def pack_rows(words: pa.StringArray, rows: np.ndarray, n: int, value: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Packed words, that have their blanks, and values of any type, for n rows; rows says in order where each belongs."""
    cuts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)
    words = words.take(pa.array(np.arange(len(words))))
    at = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1] if len(words) else np.zeros(1, np.int32)
    tails = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at[cuts].astype(np.int32)), words.buffers()[2]])
    return tails, pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((cuts * value.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(value))])


def answered(rows: DataFrame, kinds: int, weigh: Callable[[Entries], np.ndarray], change: Callable[[Entries], Entries] | None = None, asked: bool = True) -> DataFrame:
    """chunk, src, tails, kinds, ws: what chunks ask of the counts of sources.

    rows: src, chunk (null in counts), tails, vals. A chunk asks for the destinations in its tails or, without asked, for all. Counts of a source
    come before what is asked of it, so they alone are held on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[tuple] = []
        n = 0
        held: list[pa.RecordBatch] = []

        def answer(e: Entries) -> Iterator[pa.RecordBatch]:
            e = change(e) if change else e
            w, first = weigh(e), np.searchsorted(e.head, np.arange(len(e.src) + 1))
            for q in held:
                head = pc.index_in(q.column("src"), value_set=e.src).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                if asked:
                    dst = words_in(q.column("tails"))
                    size = pc.count_substring(q.column("tails"), b" ").to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(q.num_rows), size)
                    d = pc.index_in(dst, value_set=e.dst).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                    key, own = head[row] * len(e.dst) + d, e.head * len(e.dst) + e.tail
                    at = np.minimum(np.searchsorted(own, key), max(len(own) - 1, 0))
                    ok = (head[row] >= 0) & (d >= 0) & (own[at] == key if len(own) else False)
                    row, at = row[ok], at[ok]
                else:
                    size = np.where(head >= 0, first[head + 1] - first[head], 0)
                    row, at = np.repeat(np.arange(q.num_rows), size), ranges(first[head], size)
                tails, ws = pack_rows(e.dst.take(pa.array(e.tail[at])), row, q.num_rows, w[at])
                _, kind = pack_rows(e.dst.take(pa.array(e.tail[at])), row, q.num_rows, e.kind[at].astype(np.uint8))
                yield pa.RecordBatch.from_arrays([q.column("chunk"), q.column("src"), tails, kind, ws], names=["chunk", "src", "tails", "kinds", "ws"])

        for b in batches:
            mine = pc.is_null(b.column("chunk"))
            c, q = b.filter(mine), b.filter(pc.invert(mine))
            if c.num_rows:
                counts.append(unpacked(c, kinds))
                n += len(counts[-1][2])
            if q.num_rows:
                held.append(q)
                n += sum(len(x) for x in (words_in(q.column("tails")),)) if asked else q.num_rows
            if n >= HELD and counts:
                e = Entries.of(counts, kinds)
                yield from answer(e)
                last = e.head == e.head[-1] if len(e.head) else np.zeros(0, bool)
                counts, held, n = [e.where(last).part()], [], 0
        if held and counts:
            yield from answer(Entries.of(counts, kinds))

    ship(rows.sparkSession)
    ordered = rows.repartition("src").sortWithinPartitions("src", F.col("chunk").isNotNull())
    return ordered.select("src", "chunk", "tails", "vals").mapInArrow(run, "chunk long, src string, tails binary, kinds binary, ws binary")


def rare_pairs(sents: DataFrame, most: int) -> DataFrame:
    """doc_id, line, w1, w2, n: neighbours of which each token stands at most so many times in its chunk, and so maybe in all."""
    ship(sents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces_of(batches, 2):
            codes, sizes, words = coded(t.column(2))
            rare, line = np.bincount(codes, minlength=len(words)) <= most, np.repeat(np.arange(len(sizes)), sizes)
            at = np.flatnonzero(rare[codes[:-1]] & rare[codes[1:]] & (line[1:] == line[:-1]))
            where = pa.array(line[at])
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks().take(where), t.column(1).combine_chunks().take(where), words.take(pa.array(codes[at])), words.take(pa.array(codes[at + 1]))], names=["doc_id", "line", "w1", "w2"])

    got = sents.select("doc_id", "line", "toks").mapInArrow(run, f"doc_id {dict(sents.dtypes)['doc_id']}, line int, w1 string, w2 string")
    return got.groupBy("doc_id", "line", "w1", "w2").agg(F.count("*").alias("n"))


def first_places(sents: DataFrame) -> DataFrame:
    """tok, freq, doc_id, line, pos of every chunk's distinct tokens: how often they stand in it, and the first place."""
    ship(sents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in pieces_of(batches, 2):
            codes, sizes, words = coded(t.column(2))
            ids, lines = (t.column(k).combine_chunks() for k in (0, 1))
            least = pc.sort_indices(pa.table({"d": ids, "l": lines}), [("d", "ascending"), ("l", "ascending")], null_placement="at_start").to_numpy()
            size, first = sizes[least], (np.cumsum(sizes) - sizes)[least]
            at = ranges(first, size)
            _, one, freq = np.unique(codes[at], return_index=True, return_counts=True)
            row = pa.array(np.repeat(least, size)[one])
            yield pa.RecordBatch.from_arrays([words, pa.array(freq), ids.take(row), lines.take(row), pa.array(at[one] - np.repeat(first, size)[one], pa.int32())], names=["tok", "freq", "doc_id", "line", "pos"])

    return sents.select("doc_id", "line", "toks").mapInArrow(run, f"tok string, freq long, doc_id {dict(sents.dtypes)['doc_id']}, line int, pos int")
