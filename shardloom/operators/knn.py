"""Exact nearest neighbours by blocks.

Queries and references are dealt to large blocks by the hash of their ids; every pair of blocks is one task, which walks
through both in small matrix products, keeps a running top-k per query, and gives only that. The best of all blocks follow
by a window. Top-k decomposes, so the result is exact; ties go to the lower id. A vector is shipped once per block of the
other side: with 64 dimensions a hundred million vectors make some 760 blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import doubles

#: Bytes of a block's vectors as doubles, whatever their length.
BLOCK_BYTES = 64 << 20
STEP_QUERIES, STEP_REFS = 512, 2048


def _dense(best: np.ndarray, who: np.ndarray, s: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` of those so far and a tile's scores, each row by a partition of all its scores."""
    s = np.where(np.isnan(s), -np.inf, s)
    m = min(k, s.shape[1])
    if m < s.shape[1]:
        at = np.argpartition(-s, m - 1, axis=1)[:, :m]
        least = np.take_along_axis(s, at, 1).min(axis=1)
        for i in np.flatnonzero((s >= least[:, None]).sum(axis=1) > m):  # ties across the cut
            at[i] = np.argsort(-s[i], kind="stable")[:m]
        at.sort(axis=1)
        s, near = np.take_along_axis(s, at, 1), r[at]
    else:
        near = np.broadcast_to(r, s.shape)
    best, who = np.concatenate([best, s], axis=1), np.concatenate([who, near], axis=1)
    top = np.argsort(-best, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(best, top, 1), np.take_along_axis(who, top, 1)


def top_k(x: np.ndarray, y: np.ndarray, qi: np.ndarray, ri: np.ndarray, k: int, metric: str, skip_self: bool) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the best ``k`` references (ids ``ri`` ascending) of each query, ties to the lower id.

    Once a query has ``k``, only scores above its last one are looked at: a later id does not displace an equal score."""
    scores, ids = [], []
    tile, above = np.empty(STEP_QUERIES * STEP_REFS), np.empty(STEP_QUERIES * STEP_REFS, dtype=bool)  # written again and again
    for a in range(0, len(x), STEP_QUERIES):
        xs, q = x[a : a + STEP_QUERIES], qi[a : a + STEP_QUERIES]
        best, who = np.empty((len(xs), 0)), np.empty((len(xs), 0), dtype=np.int64)
        for b in range(0, len(y), STEP_REFS):
            ys, r = y[b : b + STEP_REFS], ri[b : b + STEP_REFS]
            s = np.matmul(xs, ys.T, out=tile[: len(xs) * len(ys)].reshape(len(xs), len(ys)))
            if metric == "l2":
                s = 2 * s - (xs**2).sum(1)[:, None] - (ys**2).sum(1)[None, :]
            if skip_self:
                at = np.minimum(np.searchsorted(r, q), len(r) - 1)
                own = np.flatnonzero(r[at] == q)
                if (r[1:] == r[:-1]).any():
                    s[q[:, None] == r[None, :]] = -np.inf
                else:
                    s[own, at[own]] = -np.inf
            if best.shape[1] < k:
                best, who = _dense(best, who, s, r, k)
                continue
            over = np.greater(s, best[:, -1:], out=above[: s.size].reshape(s.shape))
            rows = np.flatnonzero(over.any(axis=1))
            if np.count_nonzero(over[rows]) > 4 * k * len(xs):
                best, who = _dense(best, who, s, r, k)
                continue
            for i in rows.tolist():
                c = np.flatnonzero(over[i])
                v, w = np.concatenate([best[i], s[i, c]]), np.concatenate([who[i], r[c]])
                top = np.argsort(-v, kind="stable")[:k]
                best[i], who[i] = v[top], w[top]
        scores.append(best)
        ids.append(who)
    return np.concatenate(scores), np.concatenate(ids)


def grid(queries: DataFrame, refs: DataFrame, vec: str, id_col: str, task: Callable[[pa.Table, pa.Table], pa.Table], schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """``task`` on every pair of a block of queries and one of references, both (id, v, ``more``) in id order."""
    known = [d.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first() for d in (queries, refs)]
    rows = max(1, BLOCK_BYTES // (8 * max(1, *[k["d"] or 1 for k in known])))
    nr = -(-known[1]["n"] // rows) or 1
    # smaller blocks of queries than of references, and at least two tasks for each core: none is left with a long one at the end
    nq = max(-(-2 * known[0]["n"] // rows), -(-2 * queries.sparkSession.sparkContext.defaultParallelism // nr))
    side = lambda d, n, cols: d.select(F.col(id_col).cast("long").alias("id"), doubles(vec).alias("v"), *cols, F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int").alias("own"))
    q = side(queries, nq, more).withColumnsRenamed({"own": "qb"}).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(nr - 1))))
    r = side(refs, nr, [c for c in more if c in refs.columns]).withColumnsRenamed({"own": "rb"}).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    names = [c.split()[0] for c in schema.split(",")]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, types, strict=True)})
        return task(a.sort_by("id"), b.sort_by("id")).cast(pa.schema(list(zip(names, types, strict=True))))

    types = [{"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in schema.split(",")]
    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(run, schema)


def vectors(block: pa.Table, metric: str = "cosine") -> np.ndarray:
    """The vectors of a block, one a row; scaled to length 1 for cosines."""
    x = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
    return x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n) if metric == "cosine" else x


def knn(queries: DataFrame, refs: DataFrame, vec: str, k: int, id_col: str = "vec_id", metric: str = "cosine", skip_self: bool = True) -> DataFrame:
    """(query_id, ref_id, score, rank): largest cosine or dot product, or least squared distance (as its negative)."""

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        qi = a.column("id").to_numpy()
        score, near = top_k(vectors(a, metric), vectors(b, metric), qi, b.column("id").to_numpy(), k, metric, skip_self)
        out = pa.table({"query_id": np.repeat(qi, near.shape[1]), "ref_id": near.ravel(), "score": score.ravel()})
        return out.filter(pa.array(np.isfinite(score.ravel())))

    near = grid(queries, refs, vec, id_col, best, "query_id long, ref_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ref_id")
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def majority_vote(near: DataFrame, labels: DataFrame, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """(query_id, pred_label, votes, confidence): most frequent neighbour label, ties to the least; the confidence is the
    share of votes, or the score itself for a single neighbour."""
    named = near.join(labels.select(F.col(id_col).alias("ref_id"), F.col(label).alias("pred_label")), "ref_id")
    counts = named.groupBy("query_id", "pred_label").agg(F.count(F.lit(1)).alias("votes"), F.max("score").alias("_s"))
    w = Window.partitionBy("query_id")
    best = counts.withColumns({"_n": F.row_number().over(w.orderBy(F.desc("votes"), "pred_label")), "_k": F.sum("votes").over(w)}).where("_n = 1")
    return best.select("query_id", "pred_label", "votes", F.round(F.when(F.col("_k") == 1, F.col("_s")).otherwise(F.col("votes") / F.col("_k")), 6).alias("confidence"))
