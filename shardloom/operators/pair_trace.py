"""Which pairs make up a pairwise entropy objective: statistics of pairs of blocks that sum to the loss.

Rows are dealt to blocks of consecutive ids; every pair of runs of ``SUPER`` ids is one task, which walks through its
distances by matrix products and gives sums of each pair of blocks only, so a row is shipped once a run of the other side,
however narrow blocks are. Single pairs are given for chosen pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles
from .graph import _cut
from .knn import vectors

STEP, TILE = 1024, 256
#: Ids of a run of blocks, which is shipped as a whole.
SUPER = 16384
_SUMS = ["candidates", "selected", "entropy", "confident"]


def _blocks(rows: DataFrame, vec: str, id_col: str, label: str, width: int) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("id"), doubles(vec).alias("v"), F.col(label).cast("long").alias("label"), F.floor(F.col(id_col) / width).cast("long").alias("block"))


def _pairs(rows: DataFrame, task: Callable[[pa.Table, pa.Table, bool], dict], schema: str, only: DataFrame | None = None) -> DataFrame:
    """``task`` on every pair of blocks (left <= right); ``only`` (left_block, right_block) restricts them."""
    if only is None:
        blocks = rows.select("block").distinct()  # a row per block
        a, b = (blocks.withColumnRenamed("block", n) for n in ("left_block", "right_block"))
        only = a.join(b, F.col("left_block") <= F.col("right_block"))
    left = rows.join(only.withColumnRenamed("left_block", "block"), "block").withColumnRenamed("block", "left_block")
    right = rows.join(only.withColumnRenamed("right_block", "block"), "block").withColumnRenamed("block", "right_block")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, as both sides come from one table
    names = [c.split()[0] for c in schema.split(",")]
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[c.split()[1]] for c in schema.split(",")]

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        made = task(a.sort_by("id"), b.sort_by("id"), key[0] == key[1])
        size = len(next(iter(made.values())))
        made = {"left_block": [key[0].as_py()] * size, "right_block": [key[1].as_py()] * size} | made  # a task may name blocks of its own
        return pa.table({n: pa.array(made[n], t) for n, t in zip(names, types, strict=True)})

    keys = ["left_block", "right_block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def _distances(a: pa.Table, b: pa.Table, same: bool) -> Iterator[tuple]:
    """(left rows, right rows, distances, left labels, right labels) of all pairs i < j, in runs; a missing label is NaN."""
    x, y = vectors(a), vectors(b)
    la, lb = (t.column("label").to_numpy(zero_copy_only=False).astype(np.float64) for t in (a, b))
    for i in range(0, len(x), STEP):
        for j in range(i if same else 0, len(y), STEP):
            d = 2 - 2 * (x[i : i + STEP] @ y[j : j + STEP].T)
            p, q = np.nonzero(np.ones(d.shape, dtype=bool) if not same else np.arange(i, i + len(d))[:, None] < np.arange(j, j + d.shape[1])[None, :])
            yield i + p, j + q, d[p, q], la[i + p], lb[j + q]


def _inside(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("block").alias("left_block"), F.col("block").alias("right_block")).distinct()


def midpoint(rows: DataFrame, vec: str, fallback: float, id_col: str = "vec_id", label: str = "label", width: int = 4096, within: bool = False) -> float:
    """Between the mean distances of labelled pairs of one class and of two; the fallback where either has no pair."""

    def task(a: pa.Table, b: pa.Table, same: bool) -> dict:
        out = np.zeros(4)
        for *_, d, p, q in _distances(a, b, same):
            out += [(p == q).sum(), d[p == q].sum(), (p != q).sum(), d[p != q].sum()]
        return dict(zip(("n1", "d1", "n2", "d2"), ([v] for v in out), strict=True))

    labelled = _blocks(rows.where(F.col(label).isNotNull()), vec, id_col, label, width if within else max(width, SUPER))  # only totals are asked for
    sums = _pairs(labelled, task, "n1 double,d1 double,n2 double,d2 double,left_block long,right_block long", _inside(labelled) if within else None)
    n1, d1, n2, d2 = sums.agg(*[F.sum(c) for c in ("n1", "d1", "n2", "d2")]).first()
    return (d1 / n1 + d2 / n2) / 2 if n1 and n2 else float(fallback)


def _terms(d: np.ndarray, eta: float, temperature: float, band: float | None) -> tuple[np.ndarray, ...]:
    logit = (eta - d) / temperature
    p = 1 / (1 + np.exp(-logit))
    entropy = np.maximum(logit, 0) + np.log1p(np.exp(-np.abs(logit))) - p * logit
    return logit, p, entropy, np.ones(len(d), dtype=bool) if band is None else np.abs(d - eta) <= band


def _entropy(reach: float) -> Callable[[np.ndarray], np.ndarray]:
    """The entropy of ``sigmoid(z)`` for ``|z| <= reach``. It is an even function without singularities nearer than ``pi i``, so
    for a small reach a short polynomial in z^2 has it to double precision; else by its definition."""
    exact = lambda z: np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z))) - z / (1 + np.exp(-z))
    if not 0 < reach <= 1.5:
        return exact
    near = 1 + 2 * np.pi**2 / reach**2  # the nearest singularity, where the interval is [-1, 1]
    degree = int(np.ceil(37 / np.log(near + np.sqrt(near**2 - 1))))
    fit = np.polynomial.Chebyshev.interpolate(lambda u: exact(np.sqrt(np.maximum(u, 0))), degree, [0, reach**2]).convert(kind=np.polynomial.Polynomial, domain=[0, reach**2])
    low, scale = fit.mapparms()

    def polynomial(z: np.ndarray) -> np.ndarray:
        u = z * z
        u *= scale
        u += low
        out = np.full_like(u, fit.coef[-1])
        for c in fit.coef[-2::-1]:
            out *= u
            out += c
        return out

    return polynomial


def _block_sums(a: pa.Table, b: pa.Table, same: bool, eta: float, temperature: float, band: float | None) -> dict:
    """Sums of all pairs of blocks (column ``own``) of two runs, by kind. Rows of a block are sorted by whether they have a
    label, so that both kinds are sums over rectangles. ``same``: both are one run; each pair of its rows counts once."""

    def segments(t: pa.Table) -> tuple[np.ndarray, ...]:
        block, free = t.column("own").to_numpy(), t.column("label").is_null().to_numpy()
        order = np.lexsort((free, block))
        block, free = block[order], free[order]
        starts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (free[1:] != free[:-1])])
        cuts, ends = [0], np.r_[np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
        for e, after in zip(ends.tolist(), [*ends[1:].tolist(), None], strict=True):  # of whole blocks, some TILE rows each, which stay in the cache
            if after is None or after - cuts[-1] > TILE:
                cuts.append(e)
        return vectors(t)[order], starts, block[starts], free[starts], np.array(cuts)

    x, xs, xb, xf, xc = segments(a)
    y, ys, yb, yf, yc = segments(b)
    count = lambda starts, n: np.diff(np.r_[starts, n])
    entropy_of = _entropy(np.inf if band is None else band / temperature)
    sums = np.zeros((3, len(xs), len(ys)))
    for i, k in zip(xc[:-1], xc[1:], strict=True):
        for j, m in zip(yc[:-1], yc[1:], strict=True):
            if same and j < i:
                continue
            d = x[i:k] @ y[j:m].T
            d *= -2
            d += 2
            if same and i == j:
                np.fill_diagonal(d, np.nan)  # no pair of a row with itself
            d -= eta
            p, q = (slice(np.searchsorted(s, u), np.searchsorted(s, v)) for s, u, v in ((xs, i, k), (ys, j, m)))
            add = lambda v: np.add.reduceat(np.add.reduceat(v, ys[q] - j, axis=1), xs[p] - i, axis=0)  # noqa: B023, E731
            size = np.abs(d)
            chosen = size <= (np.inf if band is None else band)
            d /= -temperature
            h = entropy_of(d)
            h[~chosen] = 0
            sums[0, p, q], sums[1, p, q] = add(chosen.astype(np.float64)), add(h)
            sure = size > temperature * np.log(9)
            if sure.any():
                sums[2, p, q] = add(sure.astype(np.float64))
    pairs = np.outer(count(xs, len(x)), count(ys, len(y))).astype(np.float64)
    if same:
        np.fill_diagonal(pairs, pairs.diagonal() - count(xs, len(x)))
    parts = np.concatenate([pairs[None], sums])
    left, lk = np.unique(xb, return_inverse=True)
    right, rk = np.unique(yb, return_inverse=True)
    names, out = ("kind", "left_block", "right_block", *_SUMS), []
    for kind in ("uu", "lu"):
        own = np.where((xf[:, None] & yf if kind == "uu" else xf[:, None] ^ yf), parts, 0)
        total = np.zeros((4, len(left), len(right)))
        np.add.at(total, (slice(None), lk[:, None], rk[None, :]), own)
        if same:  # a block with itself has each pair twice
            total[:, np.arange(len(left)), np.arange(len(left))] /= 2
        i, j = np.nonzero((total[0] > 0) & ((left[:, None] <= right) if same else True))
        out.append((np.full(len(i), kind), left[i], right[j], *total[:, i, j]))
    return {n: np.concatenate(v) for n, v in zip(names, zip(*out, strict=True), strict=True)}


def block_trace(rows: DataFrame, vec: str, eta: float, temperature: float, band: float | None = None, id_col: str = "vec_id", label: str = "label", width: int = 4096, within: bool = False) -> DataFrame:
    """(kind, left_block, right_block, candidates, selected, mean_entropy, weight, contribution) of pairs of two unlabelled
    rows (``uu``) and of a labelled with an unlabelled one (``lu``).

    Pairs within ``band`` of ``eta`` are selected (all without a band); ``weight`` is a block pair's share of them, and its
    contribution, weight times mean entropy, is its part of the loss: contributions sum to the mean entropy of all selected
    pairs. Without a selected pair all weights are zero. ``within`` takes pairs of one block only: blocks are batches then.
    """

    def task(a: pa.Table, b: pa.Table, same: bool) -> dict:
        sums = {k: np.zeros(4) for k in ("uu", "lu")}
        for *_, d, p, q in _distances(a, b, same):
            free = np.isnan(p).astype(int) + np.isnan(q)
            for kind, n in (("uu", 2), ("lu", 1)):
                own = d[free == n]
                _, prob, entropy, chosen = _terms(own, eta, temperature, band)
                sums[kind] += [len(own), chosen.sum(), entropy[chosen].sum(), ((prob > 0.9) | (prob < 0.1)).sum()]
        kept = {k: v for k, v in sums.items() if v[0]}
        return {"kind": list(kept), **{n: [v[i] for v in kept.values()] for i, n in enumerate(_SUMS)}}

    schema = "kind string," + ",".join(f"{c} double" for c in _SUMS) + ",left_block long,right_block long"
    dealt = _blocks(rows, vec, id_col, label, width)
    if within:
        found = _pairs(dealt, task, schema, _inside(dealt))
    else:
        runs = dealt.withColumnRenamed("block", "own").withColumn("block", F.floor(F.col("own") / max(1, SUPER // width)).cast("long"))
        found = _pairs(runs, lambda a, b, same: _block_sums(a, b, same, eta, temperature, band), schema)
    found = _cut(found)
    found = found.crossJoin(F.broadcast(found.agg(F.sum("selected").alias("_all"))))  # one row
    share = F.when(F.col("_all") > 0, F.col("selected") / F.col("_all")).otherwise(0.0)
    return found.select(
        "kind", "left_block", "right_block", F.col("candidates").cast("long").alias("candidates"), F.col("selected").cast("long").alias("selected"), F.col("confident").cast("long").alias("confident"),
        F.when(F.col("selected") > 0, F.col("entropy") / F.col("selected")).alias("mean_entropy"), share.alias("weight"), F.when(F.col("_all") > 0, F.col("entropy") / F.col("_all")).otherwise(0.0).alias("contribution"),
    )


def batch_entropy(rows: DataFrame, vec: str, temperature: float, fallback: float = 1.0, band: float | None = None, id_col: str = "vec_id", label: str = "label", width: int = 256) -> DataFrame:
    """(pairs, eta, entropy, confident) over all pairs of batches of ``width`` consecutive ids: the midpoint of the labels'
    pairs and the mean entropy around it, a matrix product a batch and pass."""
    eta = midpoint(rows, vec, fallback, id_col, label, width, within=True)

    def task(a: pa.Table, b: pa.Table, same: bool) -> dict:
        out = np.zeros(3)
        for *_, d, _, _ in _distances(a, b, same):
            _, p, entropy, chosen = _terms(d, eta, temperature, band)
            out += [chosen.sum(), entropy[chosen].sum(), ((p[chosen] > 0.9) | (p[chosen] < 0.1)).sum()]
        return dict(zip(("n", "h", "c"), ([v] for v in out), strict=True))

    dealt = _blocks(rows, vec, id_col, label, width)
    sums = _pairs(dealt, task, "n double,h double,c double,left_block long,right_block long", _inside(dealt)).agg(*[F.sum(c).alias(c) for c in ("n", "h", "c")])
    return sums.select(F.col("n").cast("long").alias("pairs"), F.round(F.lit(eta), 6).alias("eta"), F.round(F.col("h") / F.col("n"), 6).alias("entropy"), F.round(F.col("c") / F.col("n"), 6).alias("confident"))


def traced_pairs(rows: DataFrame, trace: DataFrame, vec: str, eta: float, temperature: float, band: float | None = None, id_col: str = "vec_id", label: str = "label", width: int = 4096) -> DataFrame:
    """The single pairs of the pairs of blocks in ``trace`` (rows of :func:`block_trace`, made with the same settings):
    (kind, i, j, d, logit, probability, entropy, selected, contribution); the labelled row of a ``lu`` pair is i."""

    def task(a: pa.Table, b: pa.Table, same: bool) -> dict:
        ia, ib = a.column("id").to_numpy(), b.column("id").to_numpy()
        parts = []
        for p, q, d, la, lb in _distances(a, b, same):
            free = np.isnan(la).astype(int) + np.isnan(lb)
            at = np.flatnonzero(free)
            swap = np.isnan(la[at]) & ~np.isnan(lb[at])
            left, right = ia[p[at]], ib[q[at]]
            logit, prob, entropy, chosen = _terms(d[at], eta, temperature, band)
            parts.append((np.where(free[at] == 2, "uu", "lu"), np.where(swap, right, left), np.where(swap, left, right), d[at], logit, prob, entropy, chosen))
        return dict(zip(("kind", "i", "j", "d", "logit", "probability", "entropy", "selected"), map(np.concatenate, zip(*parts, strict=True)), strict=True))

    schema = "kind string,i long,j long,d double,logit double,probability double,entropy double,selected boolean,left_block long,right_block long"
    pairs = _pairs(_blocks(rows, vec, id_col, label, width), task, schema, trace.select("left_block", "right_block").distinct())
    keys = ["kind", "left_block", "right_block"]
    scale = trace.where("selected > 0").select(*keys, (F.col("weight") / F.col("selected")).alias("_w"))
    part = F.when(F.col("selected"), F.col("entropy") * F.col("_w")).otherwise(0.0)
    return pairs.join(scale, keys, "left").select("kind", "i", "j", "d", "logit", "probability", "entropy", "selected", part.alias("contribution"))
