"""Exact top-k inner products by the threshold algorithm (operator 5).

Vectors are dealt by hash to chunks of about `VALUES` components, queries to groups of as many; each chunk meets each
group of queries once. A chunk keeps a list of its rows for every dimension, sorted by value. The algorithm goes down
all lists from both ends, a block of entries at a time: rows met for the first time are scored in full, and the values
at the frontier bound the score of any row not met. A query stops when that bound is below its k-th score (at an equal
bound a row with a smaller id could still enter). The first chunk gives every query a k-th score to begin with in all
others, so that a chunk whose best possible score is below it is left without scoring a row. Each chunk's k best go
into one ranking for each query.

Defined cases: vectors that are null or hold a null or non-finite component take no part; vectors of different lengths
never meet; repeated rows are candidates one by one, but of rows that repeat a query's id the smallest vector asks; a
query is no candidate of its own, nor is any row with its id; ties go to the smaller id; an empty table gives an empty
result; further columns are ignored. Components whose floor doesn't fit 62 bits, and vectors whose scores may not fit
63, are refused with an error."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

K = 20
#: Components of a chunk of rows and of a group of queries, about.
VALUES = 1 << 19
#: Queries that are scored at once, and the first depth; it doubles from step to step.
TOGETHER = 256
DEPTH = 16


def threshold_top(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of each query's k best rows among vectors (integers, rows in any order). least: a score
    for each query below which nothing is wanted."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    n, d = vectors.shape
    top = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    largest = top(vectors) * top(queries) * max(d, 1)
    if largest >= 1 << 63:
        raise ValueError("scores may not fit 63 bits")
    exact = np.float64 if largest < 1 << 52 else np.int64  # doubles hold whole numbers so far
    single = largest * (n + 1) < 1 << 52  # a score and a row fit one number
    v = vectors.astype(exact)
    lists = np.argsort(vectors, axis=0, kind="stable")
    wanted = np.full(len(queries), -(1 << 63), np.int64) if least is None else least
    out: list[tuple] = []
    for at in range(0, len(queries), TOGETHER):
        q, qid, floor = queries[at : at + TOGETHER].astype(exact), query_ids[at : at + TOGETHER], wanted[at : at + TOGETHER]
        best = np.empty((len(q), 0), np.int64)  # rows, best first
        score = np.empty((len(q), 0), exact)
        active, met, depth = np.flatnonzero(np.maximum(q * v[lists[0], np.arange(d)], q * v[lists[-1], np.arange(d)]).sum(axis=1) >= floor), np.zeros(n, bool), min(DEPTH, n)
        best, score = best[active], score[active]
        last = [np.empty(0, np.int64)] * len(q), [np.empty(0, exact)] * len(q)
        while len(active):
            ends = np.unique(np.concatenate([lists[:depth].ravel(), lists[n - depth :].ravel()]))
            new = ends[~met[ends]]
            met[new] = True
            s = q[active] @ v[new].T
            rows = np.concatenate([best, np.broadcast_to(new, (len(active), len(new)))], axis=1)
            s = np.concatenate([score, s], axis=1)
            own = ids[rows] == qid[active][:, None]
            best, score = _first(rows, s, own, k, single)
            low, high = v[lists[depth - 1], np.arange(d)], v[lists[n - depth], np.arange(d)]
            bound = np.maximum(q[active] * low, q[active] * high).sum(axis=1)
            stop = (bound < floor[active]) | (depth >= n)
            if best.shape[1] == k:
                stop |= (best[:, -1] >= 0) & (bound < score[:, -1])
            for i in np.flatnonzero(stop):
                last[0][active[i]], last[1][active[i]] = best[i], score[i]
            active, best, score = active[~stop], best[~stop], score[~stop]
            depth = min(depth * 2, n)
        for i in range(len(q)):
            real = (last[0][i] >= 0) & (last[1][i] >= floor[i])
            out.append((np.full(real.sum(), qid[i]), ids[last[0][i][real]], last[1][i][real].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _first(rows: np.ndarray, s: np.ndarray, own: np.ndarray, k: int, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each line by score, then row; those of its own and missing ones (-1) come last, as -1."""
    bad = own | (rows < 0)
    if single:
        key = np.where(bad, -np.inf, s * float(int(rows.max(initial=0)) + 1) - rows)
        k = min(k, key.shape[1])
        some = np.argpartition(-key, k - 1, axis=1)[:, :k] if k < key.shape[1] else np.broadcast_to(np.arange(k), key.shape)
        some = np.take_along_axis(some, np.argsort(-np.take_along_axis(key, some, 1), axis=1), 1)
    else:
        some = np.stack([np.lexsort((r, -x, b))[:k] for r, x, b in zip(rows, s, bad, strict=True)])
    got = np.take_along_axis(rows, some, 1)
    return np.where(np.take_along_axis(bad, some, 1), -1, got), np.take_along_axis(s, some, 1)


def quantised(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, dim, v): components as floor(scale * x), of the vectors that take part."""
    e = F.transform(F.col(embedding), lambda x: x.cast("double"))
    t = table.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("e")).where("vec_id is not null and e is not null and size(e) > 0")
    t = t.where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is too large for whole scores")).cast("long"))
    return t.select("vec_id", F.size("e").alias("dim"), F.transform("e", whole).alias("v"))


def top_k(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score). vectors: (vec_id, dim, v), read twice; is_query: a condition on vec_id."""
    q = vectors.where(is_query).groupBy("dim", "vec_id").agg(F.min("v").alias("v"))
    number = lambda n: F.greatest(F.ceil(n * F.col("dim") / VALUES), F.lit(1)).cast("int")
    sizes = vectors.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("m")).select("dim", number(F.col("n")).alias("chunks"), number(F.col("m")).alias("groups"))
    sizes = F.broadcast(sizes)  # one row for each length of vector
    chunk = F.pmod(F.xxhash64("vec_id", "v"), F.col("chunks")).cast("int")
    c = vectors.join(sizes, "dim").select("dim", chunk.alias("chunk"), "groups", "vec_id", "v")
    q = q.join(sizes, "dim").select(F.col("dim").alias("q_dim"), "chunks", F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int").alias("q_grp"), F.col("vec_id").alias("q_id"), F.col("v").alias("q"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        least = right.column("least").fill_null(-(1 << 63)).to_numpy()
        found = threshold_top(matrix(left, "v"), left.column("vec_id").to_numpy(), matrix(right, "q"), right.column("q_id").to_numpy(), k, least)
        return pa.table([pa.array(x, pa.int64()) for x in found], names)

    def meetings(rows: DataFrame, queries: DataFrame, first: int, last) -> DataFrame:
        """Of the queries, one chunk after the other from first to last."""
        rows = rows.select("dim", "chunk", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("grp"), "vec_id", "v")
        queries = queries.select("q_dim", F.explode(F.sequence(F.lit(first), last)).alias("q_chunk"), "q_grp", "q_id", "q", "least")
        return rows.groupBy("dim", "chunk", "grp").cogroup(queries.groupBy("q_dim", "q_chunk", "q_grp")).applyInArrow(meet, "query_id long, vec_id long, score long")

    scratch = Scratch(vectors.sparkSession)
    met = scratch.table(meetings(c.where("chunk = 0"), q.withColumn("least", F.lit(None).cast("long")), 0, F.lit(0)), "first_chunk")
    kth = met.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("q_id"), "least")
    more = q.where("chunks > 1").join(kth, "q_id", "left")
    met = met.unionByName(meetings(c.where("chunk > 0"), more, 1, F.col("chunks") - 1))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = Scratch(spark).table(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return top_k(v, F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
