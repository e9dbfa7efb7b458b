"""Vector algebra, nearest neighbours and analogies over the embedding table.

Aggregates over all pairs are taken by algebra (a mean cosine is the squared
length of the mean unit vector), never by forming pairs. Searches have a stated
query set, every vec_id divisible by 20 (as first word of an analogy, with its
three successors), sent in blocks of bounded size against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .base import query, read

BLOCK = 4096
TILE = 512  # rows that meet a block of queries at a time


def doubles(c: str | Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def angular(c: Column) -> Column:
    return 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))) / F.pi()


def kl(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.when(a == 0, 0.0).otherwise(a * F.ln(a / b))), F.lit(0.0), lambda acc, v: acc + v)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", doubles("embedding").alias("v"))


_V = "v as (select vec_id, label, embedding::double[] as v from embeddings)"


def _matrix(c: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in c.to_pylist()]) if len(c) else np.empty((0, 0))


@query("vec_mean", f"with {_V}, e as (select label, generate_subscripts(v, 1) - 1 as dim, unnest(v) as x from v) select label, dim, count(*) as n, round(avg(x), 6) as mean from e group by label, dim")
def vec_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vectors(spark, sf_dir).select("label", F.posexplode("v").alias("dim", "x"))
    return e.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"))


@query("vec_covariance", f"with {_V}, e as (select vec_id, generate_subscripts(v, 1) - 1 as dim, unnest(v) as x from v) select a.dim as i, b.dim as j, round(covar_samp(a.x, b.x), 6) as cov from e a join e b using (vec_id) group by a.dim, b.dim")
def vec_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial products X'X and sums by batch, added up: one small row a cell and batch."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx = x1 = None
        n = 0
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                xx, x1, n = (m.T @ m if xx is None else xx + m.T @ m), (m.sum(0) if x1 is None else x1 + m.sum(0)), n + len(m)
        if xx is not None:
            d = len(x1)
            i, j = np.divmod(np.arange(d * d), d)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(xx.ravel()), pa.array(x1[i]), pa.array(x1[j]), pa.array(np.full(d * d, n))], names=["i", "j", "xy", "x", "y", "n"])

    cells = vectors(spark, sf_dir).select("v").mapInArrow(partial, "i long, j long, xy double, x double, y double, n long")
    s = cells.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("xy", "x", "y", "n")))
    return s.select("i", "j", F.round(F.try_divide(F.col("xy") - F.col("x") * F.col("y") / F.col("n"), F.col("n") - 1), 6).alias("cov"))


@query("mean_pairwise_cosine", f"with {_V} select a.label, count(*) as n_pairs, round(avg(list_cosine_similarity(a.v, b.v)), 6) as mean_cosine, round(avg(list_distance(a.v, b.v) ** 2), 4) as mean_square_distance from v a join v b using (label) group by a.label")
def mean_pairwise_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all ordered pairs of a label, each with itself too, without forming them."""
    v = vectors(spark, sf_dir).withColumn("n", norm(F.col("v")))
    e = v.select("label", F.posexplode(F.arrays_zip("v", F.transform("v", lambda x: F.try_divide(x, F.col("n"))).alias("u"))).alias("dim", "z"))
    m = e.groupBy("label", "dim").agg(F.avg("z.u").alias("u"), F.avg("z.v").alias("x"), F.avg(F.pow("z.v", F.lit(2))).alias("xx"), F.count("*").alias("k"))
    return m.groupBy("label").agg(F.pow(F.max("k"), F.lit(2)).cast("long").alias("n_pairs"), F.round(F.sum(F.pow("u", F.lit(2))), 6).alias("mean_cosine"), F.round(2 * F.sum(F.col("xx") - F.pow("x", F.lit(2))), 4).alias("mean_square_distance"))


@query("vector_algebra", f"""with {_V}, c as (select label, list(m order by dim) as c from (select label, dim, avg(x) as m from (select label, generate_subscripts(v, 1) as dim, unnest(v) as x from v) group by all) group by label),
j as (select vec_id, v, c, list_cosine_similarity(v, c) as cs from v join c using (label))
select vec_id, round(list_dot_product(v, c), 5) as dot, round(sqrt(list_dot_product(v, v)), 6) as norm, round(list_distance(v, c), 6) as euclid, round(cs, 6) as cosine, round(1 - acos(greatest(-1.0, least(1.0, cs))) / pi(), 6) as angular,
  round(list_sum([x + 2 * y for x, y in list_zip(v, c)]), 5) as added, round(sqrt(list_sum([(z[1] - z[2] * list_dot_product(v, c) / list_dot_product(c, c)) ** 2 for z in list_zip(v, c)])), 5) as rest from j""".replace("[x + 2 * y for x, y in list_zip(v, c)]", "[z[1] + 2 * z[2] for z in list_zip(v, c)]"))
def vector_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector beside its label's mean: products, lengths, distances, sum, and what is left after projection."""
    v = vectors(spark, sf_dir)
    m = v.select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.avg("x").alias("m"))
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("c"))
    j, x, c = v.join(m, "label"), F.col("v"), F.col("c")
    along = dot(x, c) / dot(c, c)
    return j.select(
        "vec_id", F.round(dot(x, c), 5).alias("dot"), F.round(norm(x), 6).alias("norm"), F.round(norm(F.zip_with(x, c, lambda a, b: a - b)), 6).alias("euclid"), F.round(cosine(x, c), 6).alias("cosine"), F.round(angular(cosine(x, c)), 6).alias("angular"),
        F.round(F.aggregate(F.zip_with(x, c, lambda a, b: a + 2 * b), F.lit(0.0), lambda s, z: s + z), 5).alias("added"), F.round(norm(F.zip_with(x, F.transform(c, lambda b: b * along), lambda a, b: a - b)), 5).alias("rest"),
    )


_P = "[abs(x) / list_sum([abs(y) for y in v]) for x in v]"


@query("divergences", f"with {_V}, p as (select vec_id, {_P} as p, len(v) as n from v) select vec_id, round(list_sum([case when x = 0 then 0 else x * ln(x * n) end for x in p]), 6) as kl, round(0.5 * list_sum([case when x = 0 then 0 else x * ln(x / ((x + 1.0 / n) / 2)) end for x in p]) + 0.5 * list_sum([1.0 / n * ln((1.0 / n) / ((x + 1.0 / n) / 2)) for x in p]), 6) as js from p")
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of the normalised absolute values from the uniform distribution."""
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.abs(x))
    p = F.transform("v", lambda x: F.try_divide(F.abs(x), total))
    d = vectors(spark, sf_dir).select("vec_id", p.alias("p"), F.transform("v", lambda x: F.lit(1.0) / F.size("v")).alias("u"))
    mid = F.zip_with("p", "u", lambda a, b: (a + b) / 2)
    return d.select("vec_id", F.round(kl(F.col("p"), F.col("u")), 6).alias("kl"), F.round(0.5 * kl(F.col("p"), mid) + 0.5 * kl(F.col("u"), mid), 6).alias("js"))


@query("dimension_projection", f"with {_V} select vec_id, round(list_sum(v[1:10]), 5) as first10, round(list_sum(list_concat(v[1:5], v[7:])), 5) as without5, round(list_sum([case when i in (1, 3, 5) then v[i] else 0 end for i in range(1, len(v) + 1)]), 5) as chosen, len([v[i:i + 7] for i in range(1, len(v) - 6)])::bigint as n_windows from v")
def dimension_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), 5)
    v = F.col("v")
    windows = F.transform(F.sequence(F.lit(0), F.size(v) - 8), lambda i: F.slice(v, i + 1, 8))
    return vectors(spark, sf_dir).select("vec_id", total(F.slice(v, 1, 10)).alias("first10"), total(F.filter(v, lambda x, i: i != 5)).alias("without5"), total(F.transform(v, lambda x, i: F.when(i.isin(0, 2, 4), x).otherwise(0.0))).alias("chosen"), F.size(windows).cast("long").alias("n_windows"))


@query("outer_products", f"with {_V}, e as (select label, generate_subscripts(v, 1) - 1 as i, unnest(v) as x from v), m as (select label, i, sum(x) as s from e group by all) select a.label, a.i, round(sum(a.s * b.s), 3) as row_sum from m a join m b using (label) where b.i < 8 group by a.label, a.i")
def outer_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outer product of each label's sum with its first eight dimensions, summed by row."""
    m = vectors(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"))
    head = m.filter("i < 8").groupBy("label").agg(F.sum("s").alias("h"))
    return m.join(head, "label").select("label", F.col("i").cast("long").alias("i"), F.round(F.col("s") * F.col("h"), 3).alias("row_sum"))


@query("collection_setops", "with a as (select vec_id from embeddings where label < 5), b as (select vec_id from embeddings where label % 2 = 0) select 'union' as op, count(*) as n, sum(vec_id)::bigint as ids from (select * from a union all select * from b) union all select 'intersect', count(*), sum(vec_id)::bigint from (select * from a intersect select * from b) union all select 'except', count(*), sum(vec_id)::bigint from (select * from a except select * from b) union all select 'distinct', count(*), sum(vec_id)::bigint from (select * from a union select * from b)")
def collection_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    a, b = v.filter("label < 5").select("vec_id"), v.filter("label % 2 = 0").select("vec_id")
    parts = {"union": a.union(b), "intersect": a.join(b, "vec_id", "left_semi"), "except": a.join(b, "vec_id", "left_anti"), "distinct": a.union(b).distinct()}
    out = [d.agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids")).select(F.lit(k).alias("op"), "n", "ids") for k, d in parts.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def query_blocks(rows: DataFrame, block: int = BLOCK) -> list[Broadcast]:
    """A stated query set as broadcasts of at most block rows (id and doubles columns)."""
    sc, out, held = rows.sparkSession.sparkContext, [], []
    for r in rows.toLocalIterator():
        held.append(tuple(np.asarray(x, float) if isinstance(x, list) else x for x in r))
        if len(held) == block:
            out.append(sc.broadcast(held))
            held = []
    return out + ([sc.broadcast(held)] if held else [])


def most_similar(v: DataFrame, queries: DataFrame, k: int = 5, unit: bool = True) -> DataFrame:
    """query, vec_id, sim, rank: the k nearest by cosine, or by dot product; each tile of rows keeps its own k for every query."""
    ship(v.sparkSession)
    sent = query_blocks(queries.select("vec_id", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(at, TILE) for x in batches for at in range(0, x.num_rows, TILE)):
            ids, m = b.column(0).to_numpy(), _matrix(b.column(1))
            if unit:
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            for s in sent:
                q = np.stack([x[1] for x in s.value])
                if unit:
                    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
                own = np.array([x[0] for x in s.value])
                sim = np.round(q @ m.T, 6)
                sim[own[:, None] == ids[None, :]] = -np.inf
                best = np.stack([np.lexsort((ids, -row))[:k] for row in sim])
                value = np.take_along_axis(sim, best, 1)
                ok = np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, best.shape[1])[ok.ravel()]), pa.array(ids[best][ok]), pa.array(value[ok])], names=["query", "vec_id", "sim"])

    near = v.select("vec_id", "v").mapInArrow(run, "query long, vec_id long, sim double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "vec_id"))
    return near.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


@query("most_similar", f"with {_V}, s as (select q.vec_id as query, c.vec_id, round(list_cosine_similarity(q.v, c.v), 6) as sim from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0) select query, vec_id, sim, rank from (select *, row_number() over (partition by query order by sim desc, vec_id) as rank from s) where rank <= 5")
def most_similar_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return most_similar(v, v.filter("vec_id % 20 = 0"))


@query("dot_similar", f"with {_V}, s as (select q.vec_id as query, c.vec_id, round(list_dot_product(q.v, c.v), 6) as sim from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0) select query, vec_id, sim, rank from (select *, row_number() over (partition by query order by sim desc, vec_id) as rank from s) where rank <= 5")
def dot_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five others with the greatest dot product."""
    v = vectors(spark, sf_dir)
    return most_similar(v, v.filter("vec_id % 20 = 0"), unit=False)


def analogy_queries(v: DataFrame) -> DataFrame:
    """a and its three successors b, x, y for every a divisible by 20: one aggregate, no self-joins."""
    g = v.filter(F.col("vec_id") % 20 < 4).groupBy((F.col("vec_id") - F.col("vec_id") % 20).alias("a")).agg(*(F.max(F.when(F.col("vec_id") % 20 == i, F.col("v"))).alias(n) for i, n in enumerate(("va", "vb", "vx", "vy"))))
    return g.filter("va is not null and vb is not null and vx is not null and vy is not null")


def _cosines(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    return x @ m.T / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(m, axis=1)[None, :], 1e-300)


def _angles(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1 - np.arccos(np.clip(_cosines(x, m), -1, 1)) / np.pi


def analogies(v: DataFrame, kind: str, digits: int = 6, queries: DataFrame | None = None) -> DataFrame:
    """a, sim (score of the wanted word), rank (1 + better candidates), hit1, hit10, hit20.

    add: angle to x + (a - b). mul: product of cosine distances to b and x over
    that to a, as the measure is defined here. Candidates exclude a, b and x.
    A block of queries is one matrix product with each tile of the rows.
    """
    ship(v.sparkSession)
    sent = query_blocks(analogy_queries(v) if queries is None else queries)

    def score(a: np.ndarray, b: np.ndarray, x: np.ndarray, m: np.ndarray) -> np.ndarray:
        if kind == "add":
            return _angles(x + (a - b), m)
        return (1 - _cosines(b, m)) * (1 - _cosines(x, m)) / (1 - _cosines(a, m) + 1e-10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                ids, m = part.column(0).to_numpy(), _matrix(part.column(1))
                for s in sent:
                    own = np.array([q[0] for q in s.value])
                    a, b, x, y = (np.stack([q[k] for q in s.value]) for k in range(1, 5))
                    mine = np.round(np.array([score(a[i : i + 1], b[i : i + 1], x[i : i + 1], y[i : i + 1])[0, 0] for i in range(len(own))]), digits)
                    better = np.round(score(a, b, x, m), digits) > mine[:, None]
                    for k in range(3):
                        better &= ids[None, :] != own[:, None] + k
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(mine), pa.array(better.sum(1))], names=["a", "sim", "better"])

    r = v.select("vec_id", "v").mapInArrow(run, "a long, sim double, better long").groupBy("a", "sim").agg((F.sum("better") + 1).alias("rank"))
    return r.select("a", "sim", "rank", *((F.col("rank") <= k).cast("long").alias(f"hit{k}") for k in (1, 10, 20)))


def _analogy_sql(score: str, more: str = "", v: str = "q") -> str:
    return f"""with {_V}, q as (select a.vec_id as a, a.v as va, b.v as vb, x.v as vx, y.vec_id as y, a.label from v a join v b on b.vec_id = a.vec_id + 1 join v x on x.vec_id = a.vec_id + 2 join v y on y.vec_id = a.vec_id + 3 where a.vec_id % 20 = 0){more},
s as (select a, y, c.vec_id, round({score}, 6) as s from {v} q, v c where c.vec_id not in (a, a + 1, a + 2)), r as (select s.a, w.s as sim, count(*) filter (s.s > w.s) + 1 as rank from s join (select a, s from s where vec_id = y) w using (a) group by s.a, w.s)
select a, sim, rank, (rank <= 1)::bigint as hit1, (rank <= 10)::bigint as hit10, (rank <= 20)::bigint as hit20 from r"""


_ADD = "1 - acos(greatest(-1.0, least(1.0, list_cosine_similarity([z[3] + z[1] - z[2] for z in list_zip(va, vb, vx)], c.v)))) / pi()"
_MUL = "(1 - list_cosine_similarity(vb, c.v)) * (1 - list_cosine_similarity(vx, c.v)) / (1 - list_cosine_similarity(va, c.v) + 1e-10)"
_OFFSET = ", o as (select label, i, avg(va[i] - vb[i]) as o from (select *, unnest(range(1, len(va) + 1)) as i from q) group by all), qo as (select a, list(o order by i) as va, list(0.0 order by i) as vb, any_value(vx) as vx, any_value(y) as y from q join o using (label) group by a)"


@query("analogy_avg_ranks", _analogy_sql(_ADD, _OFFSET, "qo"))
def analogy_avg_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of y beside x plus the mean of a - b over the label's analogies."""
    v = vectors(spark, sf_dir)
    q = analogy_queries(v).join(v.select(F.col("vec_id").alias("a"), "label"), "a")
    o = q.select("label", F.posexplode(F.zip_with("va", "vb", lambda x, y: x - y)).alias("i", "d")).groupBy("label", "i").agg(F.avg("d").alias("d"))
    o = o.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda s: s["d"]).alias("o"))
    return analogies(v, "add", queries=q.join(o, "label").select("a", F.col("o").alias("va"), F.transform("o", lambda x: F.lit(0.0)).alias("vb"), "vx", "vy"))


@query("analogy_blocks", f"select label, kind, k, count(*) as n, round(avg(hit), 6) as score from (select label, kind, unnest([1, 10, 20]) as k, unnest([hit1, hit10, hit20]) as hit from (select 'add' as kind, * from ({_analogy_sql(_ADD)}) union all select 'mul', * from ({_analogy_sql(_MUL)})) join embeddings on vec_id = a) group by label, kind, k")
def analogy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of analogies (the label of a): mean hit by measure at 1, 10 and 20."""
    v = vectors(spark, sf_dir)
    each = [analogies(v, kind).withColumn("kind", F.lit(kind)) for kind in ("add", "mul")]
    hits = each[0].union(each[1]).join(v.select(F.col("vec_id").alias("a"), "label"), "a")
    rows = hits.select("label", "kind", F.inline(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"hit{k}").alias("hit")) for k in (1, 10, 20)))))
    return rows.groupBy("label", "kind", "k").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("score"))


@query("relation_diffs", f"with {_V}, q as (select a.vec_id as a, [z[1] - z[2] for z in list_zip(b.v, a.v)] as d1, [z[1] - z[2] for z in list_zip(y.v, x.v)] as d2 from v a join v b on b.vec_id = a.vec_id + 1 join v x on x.vec_id = a.vec_id + 2 join v y on y.vec_id = a.vec_id + 3 where a.vec_id % 20 = 0) select a, round(sqrt(list_dot_product(d1, d1)), 5) as n1, round(sqrt(list_dot_product(d2, d2)), 5) as n2, round(list_distance(d1, d2), 5) as apart, round(list_cosine_similarity(d1, d2), 6) as cos from q")
def relation_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of the vectors of two pairs of words: their lengths, their distance and their cosine."""
    minus = lambda x, y: F.zip_with(x, y, lambda a, b: a - b)
    q = analogy_queries(vectors(spark, sf_dir)).select("a", minus("vb", "va").alias("d1"), minus("vy", "vx").alias("d2"))
    return q.select("a", F.round(norm(F.col("d1")), 5).alias("n1"), F.round(norm(F.col("d2")), 5).alias("n2"), F.round(norm(minus("d1", "d2")), 5).alias("apart"), F.round(cosine(F.col("d1"), F.col("d2")), 6).alias("cos"))


@query("analogy_add", _analogy_sql(_ADD))
def analogy_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analogies(vectors(spark, sf_dir), "add")


@query("analogy_mul", _analogy_sql(_MUL))
def analogy_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analogies(vectors(spark, sf_dir), "mul")


@query("analogy_avg", f"""with {_V}, q as (select a.label, a.v as va, b.v as vb, x.vec_id, x.v as vx, y.v as vy from v a join v b on b.vec_id = a.vec_id + 1 join v x on x.vec_id = a.vec_id + 2 join v y on y.vec_id = a.vec_id + 3 where a.vec_id % 20 = 0),
o as (select label, i, avg(va[i] - vb[i]) as o from (select *, unnest(range(1, len(va) + 1)) as i from q) group by all), m as (select label, list(o order by i) as o from o group by label)
select vec_id - 2 as a, round(list_cosine_similarity([z[1] + z[2] for z in list_zip(vx, o)], vy), 6) as sim from q join m using (label)""")
def analogy_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """y beside x plus the mean of a - b over the label's analogies."""
    v = vectors(spark, sf_dir)
    q = analogy_queries(v).join(v.select(F.col("vec_id").alias("a"), "label"), "a")
    o = q.select("label", F.posexplode(F.zip_with("va", "vb", lambda x, y: x - y)).alias("i", "d")).groupBy("label", "i").agg(F.avg("d").alias("d"))
    o = o.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "d"))), lambda s: s["d"]).alias("o"))
    return q.join(o, "label").select("a", F.round(cosine(F.zip_with("vx", "o", lambda x, y: x + y), F.col("vy")), 6).alias("sim"))


@query("similarity_order", f"with {_V}, t as (select q.vec_id as query, c.vec_id - q.vec_id as place, round(list_cosine_similarity(q.v, c.v), 6) as s from v q join v c on c.vec_id between q.vec_id + 1 and q.vec_id + 5 where q.vec_id % 20 = 0), r as (select *, row_number() over (partition by query order by s desc, place) as k from t) select query, count(*) as n, round(avg(abs(place - k)), 6) as displacement, round(avg(1 - acos(greatest(-1.0, least(1.0, s))) / pi()), 5) as sim from r group by query")
def similarity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets in their given order beside their order by similarity."""
    v = vectors(spark, sf_dir).withColumn("place", F.col("vec_id") % 20).filter("place <= 5").withColumn("query", F.col("vec_id") - F.col("place"))
    first = v.filter("place = 0").select("query", F.col("v").alias("q"))
    t = v.filter("place > 0").join(first, "query").select("query", "place", F.round(cosine(F.col("q"), F.col("v")), 6).alias("s"))
    r = t.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "place")))
    return r.groupBy("query").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("place") - F.col("k"))), 6).alias("displacement"), F.round(F.avg(angular(F.col("s"))), 5).alias("sim"))
