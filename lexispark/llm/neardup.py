"""Operator 5, MinHash near-dedup with sequential Bayesian verification.

A document's set holds the hashes of its distinct 2-word shingles (words split
at ASCII white space, A-Z lowered; one word alone is its own shingle). Equal
sets are collapsed to their least doc_id first, so thousands of copies cost one
signature. Signatures of ``bands * rows`` minima are banded; within a band
bucket each member is first paired with the bucket's least member only (a star,
found by aggregation and a join that may split hot keys, never all pairs). What
the star links is a component. Members of a bucket that still lie in different
components are compared where the bucket is: they carry their signatures, and only
pairs that these don't rule out leave the task. A bucket is cut into blocks of
about ``block`` members and each two blocks meet in a task; one of more than
``bucket`` members is first divided by every second band that members share, and
what is then still larger by a third.
Pairs are verified sequentially: signature batches of ``batch`` minima (their
low bytes) are compared, and a pair is dropped as soon as the posterior
probability of a similarity of at least the threshold is under ``miss``.
Survivors are compared on their full sets, so every link is exact; those of different
components, of which few are links, on the first bits of their hashes before, which can only add similarity.

A pair at the very threshold stays unbanded with probability
(1 - 0.8**rows)**bands, 6e-7 with the defaults; it shares fewer than two bands with
probability 1.1e-5 and fewer than three with 1e-4, which counts only where all buckets that hold
it are so large.

Defined results: a null or empty text has an empty set, is linked with nothing
and kept; rows that share a doc_id are one node; a null doc_id is linked with
nothing and kept; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from ..shipping import ship
from .common import doc_texts, forget, map_batches, table, written
from .graph import components


#: At most so many ids of documents in candidate pairs are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1 << 20
#: About so many documents of candidate pairs make a group; their sets meet in tiles of two groups.
TILE = 1024


@dataclass(frozen=True)
class MinHashParams:
    percent: int = 80
    bands: int = 36
    rows: int = 5
    batch: int = 30
    block: int = 256
    bucket: int = 4096
    miss: float = 1e-9
    seed: int = 11


def shingle_sets(c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and each row's first one."""
    w = c.words(K.SPACE_WORD, lower=True)
    gram, at = w.grams(2)
    lone = w.offs[:-1][w.count == 1]
    keys = np.concatenate([gram, K.gram_hash([w.key[lone]])])
    row = w.rows()[np.concatenate([at, lone])]
    if not len(keys):
        return keys, np.zeros(c.n + 1, np.int64)
    count = np.bincount(row, minlength=c.n)
    if len(lone):
        keys = keys[np.argsort(row, kind="stable")]
    ends = np.cumsum(count)
    out, sizes = [], np.zeros(c.n, np.int64)
    for i in np.flatnonzero(count):
        s = np.sort(keys[ends[i] - count[i] : ends[i]])
        s = s[np.append(True, s[1:] != s[:-1])]
        sizes[i] = len(s)
        out.append(s)
    return np.concatenate(out), np.append(0, np.cumsum(sizes))


def min_hashes(keys: np.ndarray, offs: np.ndarray, p: MinHashParams) -> np.ndarray:
    """uint32 minima, a row for each row with a non-empty set."""
    n = p.bands * p.rows
    rng = np.random.Generator(np.random.PCG64(p.seed))
    a = rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    at = offs[:-1][np.diff(offs) > 0]
    low = (keys >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(at), n), np.uint32)
    x = np.empty_like(low)
    for i in range(n):
        np.multiply(low, a[i], out=x)
        np.add(x, b[i], out=x)
        out[:, i] = np.minimum.reduceat(x, at)
    return out


BASE = "doc_id long, n long, k1 long, k2 long, bands array<long>, sig binary"


def signatures(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """doc_id, set size, two hashes of the whole set, band keys, signature (low bytes of the minima)."""

    def run(b: pa.RecordBatch):
        for c in K.chunks(b.column(1)):
            keys, offs = shingle_sets(c)
            n = np.diff(offs)
            full = np.flatnonzero(n)
            k1, k2 = np.zeros(c.n, np.uint64), np.zeros(c.n, np.uint64)
            bands, sig = [None] * c.n, [None] * c.n
            if len(full):
                at = offs[:-1][full]
                k1[full] = K.mix(np.add.reduceat(K.mix(keys ^ np.uint64(0xA5A5)), at))
                k2[full] = K.mix(np.add.reduceat(K.mix(keys ^ np.uint64(0x5A5A0000)), at))
                mins = min_hashes(keys, offs, p)
                wide = mins.astype(np.uint64).reshape(len(full), p.bands, p.rows)
                key = np.tile(np.arange(1, p.bands + 1, dtype=np.uint64), (len(full), 1))
                for r in range(p.rows):
                    key = K.mix(key ^ (wide[:, :, r] + np.uint64(0x632BE59BD9B4E019)))
                low = K.mix(mins.astype(np.uint64)).astype(np.uint8)
                for j, i in enumerate(full):
                    bands[i], sig[i] = key[j].view(np.int64), low[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(c.first, c.n), pa.array(n, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["doc_id", "n", "k1", "k2", "bands", "sig"],
            )

    return map_batches(doc_texts(docs), run, BASE)


def needed_matches(p: MinHashParams) -> list[tuple[int, int]]:
    """(minima compared, matches needed): fewer leave a posterior under p.miss.

    Uniform prior over the similarity; a byte also matches by chance.
    """
    j = (np.arange(4000) + 0.5) / 4000
    match = j + (1 - j) / 256
    high = j >= p.percent / 100
    out, n = [], p.bands * p.rows
    for size in range(p.batch, n + p.batch, p.batch):
        size = min(size, n)
        for m in range(size + 1):
            like = m * np.log(match) + (size - m) * np.log1p(-match)
            like = np.exp(like - like.max())
            if like[high].sum() / like.sum() >= p.miss:
                out.append((size, m))
                break
    return out


def alive_pairs(x: np.ndarray, y: np.ndarray, need: list[tuple[int, int]]) -> np.ndarray:
    """Rows of two signature tables that no batch rules out."""
    alive, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for size, least in need:
        matches[alive] += (x[alive, done:size] == y[alive, done:size]).sum(1)
        alive, done = alive[matches[alive] >= least], size
    return alive


def plausible(pairs: DataFrame, sigs: DataFrame, p: MinHashParams) -> DataFrame:
    """Pairs (a, b) that no batch of their signatures rules out."""
    need = needed_matches(p)
    s = sigs.select("rep", "sig")
    both = pairs.join(s.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(b: pa.RecordBatch):
        x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
        yield b.select([0, 1]).take(pa.array(alive_pairs(x, y, need)))

    return map_batches(both, run, "a long, b long")


#: Pairs that are held at once.
PAIRS = 1 << 16
_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def first_words(sig: np.ndarray, size: int) -> np.ndarray:
    """The first bytes of signatures as 64-bit words, one row a word; the last word is filled with zeros."""
    out = np.zeros((len(sig), -(-size // 8) * 8), np.uint8)
    out[:, :size] = sig[:, :size]
    return np.ascontiguousarray(out.view(np.uint64).T)


def equal_bytes(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal bytes of rows i and j of first_words(); fillers count."""
    same = np.full(len(i), 8 * len(words), np.int16)
    for w in words:
        z = w[i] ^ w[j]
        same -= np.bitwise_count((((z & _LOW) + _LOW) | z) & _HIGH)
    return same


def pairs_within(band: np.ndarray, x: np.ndarray, y: np.ndarray, own: np.ndarray, rep: np.ndarray, root: np.ndarray, n: np.ndarray, sig: np.ndarray, need: list[tuple[int, int]], percent: int) -> np.ndarray:
    """Pairs (a < b) of rows with the same (band, x, y), sorted by these and own, that have different roots and that no batch rules out.

    Rows of two blocks x and y meet across them only. All groups are gone through at once, ``PAIRS`` pairs at a time, so
    neither small groups nor large ones cost more than their pairs.
    """
    rows = len(band)
    start = np.flatnonzero(np.append(True, (band[1:] != band[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    sizes = np.diff(np.append(start, rows))
    lo, hi = np.arange(1, rows + 1), np.repeat(start + sizes, sizes)
    cross = x != y
    if cross.any():
        left = np.add.reduceat((own == x).astype(np.int64), start)
        lo = np.where(cross, np.where(own == x, np.repeat(start + left, sizes), hi), lo)
    count = hi - lo
    ends = np.cumsum(count)
    size, least = need[0]
    words = first_words(sig, size)
    least += 8 * len(words) - size
    out = []
    for at in range(0, int(ends[-1]) if rows else 0, PAIRS):
        k = np.arange(at, min(at + PAIRS, int(ends[-1])))
        u, v = (int(np.searchsorted(ends, e, "right")) for e in (k[0], k[-1]))
        part = np.minimum(ends[u : v + 1], k[-1] + 1) - np.maximum(ends[u : v + 1] - count[u : v + 1], at)
        i = np.repeat(np.arange(u, v + 1), part)
        j = k - (ends - count)[i] + lo[i]
        ok = np.flatnonzero(root[i] != root[j])
        i, j = i[ok], j[ok]
        ok = np.flatnonzero(equal_bytes(words, i, j) >= least)
        i, j = i[ok], j[ok]
        ok = np.flatnonzero((rep[i] != rep[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])))
        i, j = i[ok], j[ok]
        live = alive_pairs(sig[i], sig[j], need)
        if len(live):
            out.append(np.stack([rep[i[live]], rep[j[live]]]))
    return np.unique(np.sort(np.concatenate(out, axis=1), axis=0), axis=1) if out else np.zeros((2, 0), np.int64)


def plausible_within(placed: DataFrame, reps: DataFrame, p: MinHashParams) -> DataFrame:
    """Pairs (a, b) of members (band, rep, n, root) of a bucket that lie in different components and that no batch rules out."""
    need, found = needed_matches(p), []
    whole = placed.select("band", "rep", "root")
    for level in range(3):
        sizes = whole.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1")
        if level:
            sizes = written(sizes, "sizes")
        small = sizes if level == 2 else sizes.filter(F.col("m") <= p.bucket)
        found.append(whole.join(small, "band"))
        if level == 2 or sizes.filter(F.col("m") > p.bucket).isEmpty():
            break
        large = whole.join(sizes.filter(F.col("m") > p.bucket).select("band"), "band").join(reps.select("rep", F.explode(F.array_distinct("bands")).alias("other")), "rep")
        whole = written(large.select(F.xxhash64("band", "other").alias("band"), "rep", "root").distinct(), "divided")
    rows = found[0]
    for f in found[1:]:
        rows = rows.union(f)
    blocks = F.ceil(F.col("m") / p.block).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    rows = rows.select("band", "rep", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "root").distinct()
    rows = rows.join(reps.select("rep", "n", "sig"), "rep").select("band", "x", "y", "own", "rep", "root", "n", "sig")
    rows = rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y", "own", "rep")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def emit(t: pa.Table):
            sig = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint8).reshape(t.num_rows, -1)
            got = pairs_within(*(t.column(k).to_numpy() for k in range(7)), sig, need, p.percent)
            if got.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            key = np.stack([t.column(k).to_numpy() for k in (0, 1, 2)])
            other = np.flatnonzero((key != key[:, -1:]).any(0))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from emit(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held))

    ship(placed.sparkSession)
    return rows.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, p: MinHashParams, broadcast_ids: int = BROADCAST_IDS, tile: int = TILE, short: bool = False) -> DataFrame:
    """Pairs whose full sets are similar enough; each document's set is made once, only if some pair needs it.

    Short sets hold the first 16 bits of each hash, a quarter of the bytes. Hashes that are equal have equal first bits, so no pair
    seems less similar by them than it is, and none that is similar enough is lost.
    """
    ids = written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "ids")
    d = doc_texts(docs)
    if ids.count() <= broadcast_ids:  # the others' texts aren't shuffled
        d = d.join(F.broadcast(ids), "doc_id", "left_semi")
    else:
        d = d.join(ids, "doc_id", "left_semi")

    def sets(b: pa.RecordBatch):
        for c in K.chunks(b.column(1)):
            keys, offs = shingle_sets(c)
            if short:
                keys = (keys >> np.uint64(48)).astype(np.uint16)  # still in order
            yield pa.RecordBatch.from_arrays([b.column(0).slice(c.first, c.n), pa.array([keys[offs[i] : offs[i + 1]].tobytes() for i in range(c.n)], pa.binary())], names=["doc_id", "set"])

    # A pair belongs to the tile of its documents' groups, and a document's set goes to each of its tiles once, however many pairs it has there.
    found = written(map_batches(d, sets, "doc_id long, set binary"), "sets")
    groups = max(1, -(-ids.count() // tile))
    tiled = pairs.select(*(F.pmod(F.xxhash64(k), F.lit(groups)).cast("int").alias(f"g{k}") for k in "ab"), "a", "b")
    members = tiled.select("ga", "gb", F.col("a").alias("doc_id")).union(tiled.select("ga", "gb", "b")).distinct().join(found, "doc_id")
    rows = members.select("ga", "gb", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "set").union(tiled.select("ga", "gb", "a", "b", F.lit(None).cast("binary")))
    rows = rows.repartition("ga", "gb").sortWithinPartitions("ga", "gb", F.col("b").asc_nulls_first(), "a")

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        if not len(small) or 100 * len(small) < p.percent * len(large):
            return False
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        common = int((large[at] == small).sum())
        return 100 * common >= p.percent * (len(x) + len(y) - common)

    def run(batches):
        at, held = None, {}
        for b in batches:
            keep = []
            for i, (ga, gb, x, y, s) in enumerate(zip(*(b.column(k).to_pylist() for k in range(5)))):
                if at != (ga, gb):
                    at, held = (ga, gb), {}
                if y is None:
                    held.setdefault(x, []).append(np.frombuffer(s, np.uint16 if short else np.uint64))
                elif any(similar(u, v) for u in held.get(x, ()) for v in held.get(y, ())):
                    keep.append(i)
            if keep:
                yield b.select([2, 3]).take(pa.array(keep, pa.int64()))

    ship(docs.sparkSession)
    links = written(rows.mapInArrow(run, "a long, b long").distinct(), "links")
    forget(found)
    forget(ids)
    return links


def near_duplicates(docs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, n_linked.

    n_linked is the number of other doc_ids in its class, to which links lead.
    """
    base = written(signatures(docs, p), "signatures")
    named = base.filter("doc_id is not null and n > 0")
    groups = named.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = named.select("doc_id", "k1", "k2").join(groups.filter("copies > 1"), ["k1", "k2"]).filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    copies = written(copies.distinct(), "copies")
    reps = named.join(copies.select(F.col("b").alias("doc_id"), F.lit(1).alias("copy")), "doc_id", "left").filter("copy is null").select(F.col("doc_id").alias("rep"), "n", "bands", "sig")
    # A doc_id with several texts may be a copy by one of them and not by another: both sets stay.
    many = named.select("doc_id", "k1", "k2").distinct().groupBy("doc_id").count().filter("count > 1").select("doc_id")
    reps = reps.union(named.join(many, "doc_id").select("doc_id", "n", "bands", "sig"))
    reps = written(reps, "representatives")
    rows = reps.select("rep", "n", F.explode("bands").alias("band"))
    keys = rows.groupBy("band").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead <> last").select("band", "lead")
    cand = written(rows.join(keys, "band"), "buckets")

    star = cand.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    first = confirmed(written(plausible(star, reps, p), "plausible"), docs, p)
    roots = components(first)
    placed = cand.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select("band", "rep", "n", F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("band")
    placed = written(placed.join(mixed, "band").distinct(), "mixed")
    second = written(plausible_within(placed, reps, p), "plausible")
    second = confirmed(confirmed(second, docs, p, short=True), docs, p)  # few of these pairs are links
    for t in (cand, placed, reps):
        forget(t)

    links = first.union(second).distinct().union(copies)
    found = components(links)
    for t in (first, second, copies):
        forget(t)
    degree = found.groupBy("root").agg((F.count("*") - 1).alias("n_linked"))
    out = base.select("doc_id", F.col("n").alias("n_shingles")).join(found.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id")), "doc_id", "left")
    out = out.join(degree.select(F.col("root").alias("component_id"), "n_linked"), "component_id", "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0)).cast("long"))
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "n_linked")


def keep_distinct(docs: DataFrame, p: MinHashParams = MinHashParams()) -> DataFrame:
    """Docs' own columns; of each component only the rows of its least doc_id."""
    gone = near_duplicates(docs, p).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def cte_sql(p: MinHashParams = MinHashParams(), docs: str = "documents", pre: str = "") -> str:
    """DuckDB: CTEs giving {pre}classes(doc_id, n_shingles, component_id); texts with common shingles are counted in full."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
{pre}dw as (select doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') as ws from {docs}),
{pre}ds as (select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then [md5(ws[1])] else list_sort(list_distinct([md5(ws[i] || ' ' || ws[i + 1]) for i in range(1, len(ws))])) end as st from {pre}dw),
{pre}gs as (select st, min(doc_id) as rep, len(st) as n from {pre}ds where len(st) > 0 group by st),
{pre}sh as (select rep, n, unnest(st) as s from {pre}gs),
{pre}pr as (select x.rep as a, y.rep as b, count(*) as c, any_value(x.n) as na, any_value(y.n) as nb from {pre}sh x join {pre}sh y on x.s = y.s and x.rep < y.rep and 100 * least(x.n, y.n) >= {p.percent} * greatest(x.n, y.n) group by x.rep, y.rep),
{pre}lk as (select a, b from {pre}pr where 100 * c >= {p.percent} * (na + nb - c) union select b, a from {pre}pr where 100 * c >= {p.percent} * (na + nb - c)),
{pre}rc as (select rep as node, rep as root from {pre}gs union select l.b, r.root from {pre}rc r join {pre}lk l on l.a = r.node),
{pre}rt as (select node, min(root) as root from {pre}rc group by node),
{pre}classes as (select d.doc_id, len(d.st)::bigint as n_shingles, coalesce(r.root, d.doc_id) as component_id from {pre}ds d left join {pre}gs g on g.st = d.st left join {pre}rt r on r.node = g.rep)"""


def oracle() -> str:
    return f"with recursive {cte_sql().strip()} select *, doc_id = component_id as kept, count(*) over (partition by component_id) - 1 as n_linked from classes"
