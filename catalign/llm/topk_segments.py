"""Exact top-k search with multi-resolution segment statistics.

A vector is cut into m segments; each is summarised by its mean and standard
deviation.  Over a segment of length L the squared distance of two vectors is
at least L * ((mean difference)^2 + (deviation difference)^2), and the sum
over segments is a lower bound that tightens as m doubles.  With |q| and |c|
known, a lower bound of the distance is an upper bound of the inner product,
so candidates are dismissed coarse to fine and only survivors are scored.

What a bound has to beat is a query's floor: its k-th best score over a
bounded sample of all candidates, found first and the same in every cell, or
that over the cell's most promising candidates where it is higher."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

K = 5
#: Segments by level; levels of more than half the components are left out.
LEVELS = (4, 8, 16, 32)
#: Candidates (those of the smallest hashes) whose scores give the floors.
SAMPLE_ROWS = 2048
#: Share of a cell's pairs up to which pairs are handled one by one.
_FEW = 0.1
SCALE = 256
#: Rows of a block of queries or candidates; a cell compares one of each.
BLOCK_ROWS = 1024
#: Whole numbers below this are exact in float64.
_EXACT = 1 << 53
_AT_ONCE = 100_000


def quantised(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) per component, x as double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def usable(vec: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return vec.isNotNull() & F.forall(vec, finite)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return (np.concatenate(flat) if flat else np.zeros(0, np.int64)).reshape(-1, dim)


def segment_stats(x: np.ndarray, m: int) -> np.ndarray:
    """Means and deviations of ``m`` segments, each scaled by the root of its
    length, so that a bound is one product of two rows."""
    edge = np.linspace(0, x.shape[1], m + 1).astype(int)[:-1]
    size = np.diff(np.append(edge, x.shape[1]))
    mean = np.add.reduceat(x, edge, axis=1) / size
    var = np.add.reduceat(x * x, edge, axis=1) / size - mean * mean
    return np.concatenate([mean, np.sqrt(np.maximum(var, 0))], axis=1) * np.sqrt(np.concatenate([size, size]))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int64 rows, exact; an error where one does not fit a long."""
    if _fits(a, b):
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return _long(a.astype(object) @ b.T.astype(object))


def _pair_scores(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """``_scores`` of single pairs."""
    fits = _fits(a, b)
    out = np.empty(len(rows), np.int64)
    for at in range(0, len(rows), _AT_ONCE):
        part = slice(at, at + _AT_ONCE)
        x, y = a[rows[part]], b[cols[part]]
        out[part] = (x * y).sum(axis=1) if fits else _long((x.astype(object) * y.astype(object)).sum(axis=1))
    return out


def _fits(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether every partial sum of a product of rows is below 2^53."""
    most = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return most(a) * most(b) * a.shape[1] < _EXACT


def _long(x: np.ndarray) -> np.ndarray:
    if x.size and not -(1 << 63) <= x.min() <= x.max() < 1 << 63:
        raise OverflowError("a score does not fit a 64-bit number")
    return x.astype(np.int64)


def surviving(q: np.ndarray, c: np.ndarray, other: np.ndarray, k: int, floor: np.ndarray | None = None) -> np.ndarray:
    """Pairs of ``other`` that no bound dismisses.  ``floor``: what a score of
    each query has to reach at least (-inf: nothing).  A level looks only at
    what the one before left, pair by pair once that is little."""
    alive, dim = other.copy(), q.shape[1]
    fq, fc = q.astype(float), c.astype(float)
    nq, nc = (fq * fq).sum(axis=1), (fc * fc).sum(axis=1)
    slack = lambda rows, cols: 1e-9 * (nq[rows] + nc[cols]) + 1e-6
    floor = np.full(len(q), -np.inf) if floor is None else floor
    for level, m in enumerate(m for m in LEVELS if 2 * m <= dim):
        sq, sc = segment_stats(fq, m), segment_stats(fc, m)
        if alive.mean() > _FEW:
            most = sq @ sc.T
            if level == 0:  # the k candidates of the best coarse bound
                seed = np.argpartition(-np.where(other, most, -np.inf), k, axis=1)[:, :k]
                exact = _pair_scores(q, c, np.repeat(np.arange(len(q)), k), seed.ravel()).reshape(seed.shape)
                best = np.where(np.take_along_axis(other, seed, axis=1), exact.astype(float), -np.inf).min(axis=1)
                floor = np.maximum(floor, best)
            alive &= most + slack(np.arange(len(q))[:, None], np.arange(len(c))[None, :]) >= floor[:, None]
        else:
            rows, cols = np.nonzero(alive)
            for at in range(0, len(rows), _AT_ONCE):
                r, x = rows[at:at + _AT_ONCE], cols[at:at + _AT_ONCE]
                alive[r, x] = (sq[r] * sc[x]).sum(axis=1) + slack(r, x) >= floor[r]
    return alive


def best_of_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int = K, floor: np.ndarray | None = None) -> tuple:
    """(query id, candidate id, score) of each query's best ``k`` in a block
    among the scores that reach its floor; ties go to the smaller id, an id's
    repeated rows count once."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    other = qid[:, None] != cid[None, :]
    bounded = len(cid) > 4 * k and len(np.unique(cid)) == len(cid)
    alive = surviving(q, c, other, k, floor) if bounded else other
    qi, cj = np.nonzero(alive)
    if len(qi) > _FEW * alive.size:
        rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        sc = _scores(q[rows], c[cols])[np.searchsorted(rows, qi), np.searchsorted(cols, cj)]
    else:
        sc = _pair_scores(q, c, qi, cj)
    q_of, c_of = qid[qi], cid[cj]
    by = np.lexsort((c_of, -sc, q_of))
    q_of, c_of, sc = q_of[by], c_of[by], sc[by]
    if len(np.unique(cid)) < len(cid) or len(np.unique(qid)) < len(qid):
        _, first = np.unique(np.stack([q_of, c_of]), axis=1, return_index=True)
        first.sort()
        q_of, c_of, sc = q_of[first], c_of[first], sc[first]
    starts = np.flatnonzero(np.r_[True, q_of[1:] != q_of[:-1]])
    rank = np.arange(len(q_of)) - np.repeat(starts, np.diff(np.r_[starts, len(q_of)]))
    keep = rank < k
    return q_of[keep], c_of[keep], sc[keep]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: int = SCALE, block_rows: int = BLOCK_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``vectors`` that
    ``is_query`` holds for (a condition on the column ``vec_id``), the ``k``
    highest inner products of quantised vectors over all rows of another id.

    The floors come first, from ``sample_rows`` candidates.  Then queries and
    candidates are dealt to blocks by a hash; each pair of blocks is one
    bounded cell, and the cells' best are merged.  Rows with a null id and
    unusable vectors take no part; only vectors of one length are compared;
    rows that repeat an id count once, by their best score; a score that does
    not fit a long is an error; an empty table gives an empty one."""
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vec_col), scale).alias("v"))
    rows = rows.distinct().withColumn("dim", F.size("v")).withColumn("h", F.xxhash64("vec_id", "v"))
    n, nq = (int(x or 0) for x in rows.agg(F.count("*"), F.sum(is_query.cast("int"))).first())
    queries = rows.where(is_query).withColumn("floor", F.lit(None).cast("long"))
    sample = rows.orderBy("h", "vec_id").limit(sample_rows)
    floors = _search(queries, sample, nq, min(n, sample_rows), k, block_rows).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    floors = Scratch(vectors.sparkSession, "topk").put(floors, "floors")
    # a query id on rows of several vectors has one floor: no score below it is among its best k
    return _search(queries.drop("floor").join(floors, "vec_id", "left"), rows, nq, n, k, block_rows)


def _search(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int, k: int, block_rows: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``queries`` (vec_id, v, dim, h,
    floor) against ``candidates`` (vec_id, v, dim, h), cell by cell."""
    q_blocks, c_blocks = max(1, -(-n_queries // block_rows)), max(1, -(-n_candidates // block_rows))
    blocks = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = queries.withColumn("qb", F.pmod("h", F.lit(q_blocks)).cast("int")).withColumn("cb", blocks(c_blocks))
    candidates = candidates.withColumn("cb", F.pmod("h", F.lit(c_blocks)).cast("int")).withColumn("qb", blocks(q_blocks))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        got = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            ids = lambda t: t.column("vec_id").to_numpy()
            floor = left.column("floor").cast(pa.float64()).to_numpy(zero_copy_only=False)
            got = best_of_block(ids(left), _matrix(left.column("v"), dim), ids(right), _matrix(right.column("v"), dim), k, np.where(np.isnan(floor), -np.inf, floor))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (pa.array(x, pa.int64()) for x in got))))

    cell = ["dim", "qb", "cb"]
    # new names for the columns that both sides have from one table
    left = queries.select(*[F.col(c).alias(c) for c in (*cell, "vec_id", "v", "floor")])
    best = left.groupBy(*cell).cogroup(candidates.select(*cell, "vec_id", "v").groupBy(*cell)).applyInArrow(run, "query_id long, vec_id long, score long")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
