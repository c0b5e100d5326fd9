"""Symmetric positive definite systems over graphs, one right side per class, solved for all classes at once.

Matrices are long (src, dst, a), unknowns long (node, class, value) with zeros left out. Inside, a row has a node's values
of up to ``WIDE`` classes, so an entry of the matrix is joined once for all of them. A round of conjugate gradients is one
join of the matrix with the residuals, one partially aggregated sum by node and one aggregate over nodes, which has both dot
products of the round (the recurrences below need them of the residual only) and comes to the driver, two numbers per class;
no task holds a graph or a class. Each round is written, so a lost executor costs one round at most, and the one before goes.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import forget
from .graph import _cut

#: Classes of a row.
WIDE = 16


def matrix(edges: DataFrame, nodes: DataFrame, off_diagonal: float = 1.0) -> DataFrame:
    """``diag(diagonal) + off_diagonal * W`` from edges (src, dst, w) and nodes (node, diagonal)."""
    diagonal = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.col("diagonal").cast("double").alias("a"))
    return edges.select("src", "dst", (off_diagonal * F.col("w")).alias("a")).unionByName(diagonal).groupBy("src", "dst").agg(F.sum("a").alias("a"))


def _wide(rows: DataFrame, places: DataFrame, column: str, width: int, name: str) -> DataFrame:
    """(node, _chunk, name0, name1, ...) of (node, class, column), summed; classes without a place are left out."""
    value = lambda k: F.sum(F.when(F.col("_slot") == k, F.col(column)).otherwise(0.0)).alias(f"{name}{k}")
    return rows.join(places, "class").groupBy("node", "_chunk").agg(*[value(k) for k in range(width)])


def _times(a: DataFrame, x: DataFrame, name: str, width: int) -> DataFrame:
    """``a x``: (node, _chunk, w0, w1, ...)."""
    some = reduce(or_, [F.col(f"{name}{k}") != 0 for k in range(width)])
    x = x.where(some).select(F.col("node").alias("dst"), "_chunk", *[f"{name}{k}" for k in range(width)])
    return a.join(x, "dst").groupBy(F.col("src").alias("node"), "_chunk").agg(*[F.sum(F.col("a") * F.col(f"{name}{k}")).alias(f"w{k}") for k in range(width)])


def conjugate_gradients(a: DataFrame, right: DataFrame, rounds: int = 1000, tolerance: float = 1e-8, strict: bool = True, start: DataFrame | None = None) -> DataFrame:
    """(node, class, score) with ``a score = y`` for each class of ``right`` (node, class, y).

    A class rests once its residual is at most ``tolerance`` times its right side; others go on, up to ``rounds``. With
    ``strict`` a class that has not come so far by then is an error, else its last iterate is given. ``start`` (node,
    class, score) warms up. A right side of zeros has the solution zero, whatever the start.

    With residual r, w = A r, g = r.r and h = r.w: b = g / g', s = g / (h - b g / s'), p = r + b p, q = w + b q, x += s p,
    r -= s q. These are the iterates of the usual form, with a single reduction a round.
    """
    if rounds < 1 or not 0 < tolerance < float("inf"):
        raise ValueError("rounds and tolerance must be positive")
    a = _cut(a)
    spark = a.sparkSession
    y = _cut(right.groupBy("node", "class").agg(F.sum("y").alias("y")).where("y <> 0"))
    size = {r["class"]: r["n"] for r in y.groupBy("class").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("n")).collect()}
    if not size:
        return y.select("node", "class", F.col("y").cast("double").alias("score"))
    classes, width = list(size), min(WIDE, len(size))
    place = {c: divmod(i, width) for i, c in enumerate(classes)}
    kind = T.StructType([T.StructField("class", right.schema["class"].dataType), T.StructField("_chunk", T.IntegerType()), T.StructField("_slot", T.IntegerType())])
    places = F.broadcast(spark.createDataFrame([(c, *at) for c, at in place.items()], kind))  # a row per class
    every = lambda f: [f(k) for k in range(width)]
    zeros = lambda names: every(lambda k: [F.lit(0.0).alias(f"{n}{k}") for n in names])
    flat = lambda lists: [c for cs in lists for c in cs]
    keys = ["node", "_chunk"]
    state = _wide(y, places, "y", width, "r")
    if start is None:
        state = state.select(*keys, *every(lambda k: f"r{k}"), *flat(zeros("xpq")))
    else:
        x = _cut(_wide(start, places, "score", width, "x"))
        less = _times(a, x, "x", width).select(*keys, *every(lambda k: (-F.col(f"w{k}")).alias(f"r{k}")), *flat(zeros("x")))
        both = state.select(*keys, *every(lambda k: f"r{k}"), *flat(zeros("x"))).unionByName(x.select("*", *flat(zeros("r")))).unionByName(less)
        sums = both.groupBy(*keys).agg(*flat(every(lambda k: [F.sum(f"{n}{k}").alias(f"{n}{k}") for n in "xr"])))
        state = _cut(sums.select("*", *flat(zeros("pq"))))
    last: dict = {}  # class -> g and step of the round before; a row per class, as all that comes to the driver
    rows = None
    for i in range(rounds + 1):
        product = _times(a, state, "r", width)
        filled = flat(every(lambda k: [F.coalesce(f"{n}{k}", F.lit(0.0)).alias(f"{n}{k}") for n in "xrpqw"]))
        before, rows = rows, _cut(state.join(product, keys, "full").select(*keys, *filled))
        if before is not None:
            forget(before)
        found = rows.groupBy("_chunk").agg(*flat(every(lambda k: [F.sum(F.col(f"r{k}") * F.col(f"r{k}")), F.sum(F.col(f"r{k}") * F.col(f"w{k}"))]))).collect()
        dots = {d[0]: d[1:] for d in found}
        moves, worst = {}, 0.0
        for c, (chunk, slot) in place.items():
            g, h = dots[chunk][2 * slot : 2 * slot + 2]
            worst = max(worst, math.sqrt(g) / size[c])
            if math.sqrt(g) > tolerance * size[c]:
                was = last.get(c)
                b = g / was[0] if was else 0.0
                moves[c] = (b, g / (h - (b * g / was[1] if was else 0.0)), g)
        if not moves or i == rounds:
            break
        last = {c: (g, s) for c, (_, s, g) in moves.items()}
        steps = [(int(chunk), *[float(moves[c][j]) if c in moves else None for j in (0, 1) for c in _row(classes, chunk, width)]) for chunk in range(-(-len(classes) // width))]
        f = spark.createDataFrame(steps, T.StructType([T.StructField("_chunk", T.IntegerType()), *[T.StructField(f"{n}{k}", T.DoubleType()) for n in "bs" for k in range(width)]]))

        def moved(k: int) -> list[Column]:
            """Without a step a class rests: r, p and q become zero, so it takes no further part."""
            x, r, p, q, w, b, s = (F.col(f"{n}{k}") for n in "xrpqwbs")
            p, q, rest = r + b * p, w + b * q, s.isNull()
            new = {"x": F.when(rest, x).otherwise(x + s * p), "r": F.when(rest, 0.0).otherwise(r - s * q), "p": F.when(rest, 0.0).otherwise(p), "q": F.when(rest, 0.0).otherwise(q)}
            return [v.alias(f"{n}{k}") for n, v in new.items()]

        state = rows.join(F.broadcast(f), "_chunk").select(*keys, *flat(every(moved)))
    if strict and moves:
        raise ValueError(f"no convergence in {rounds} rounds: {len(moves)} classes left, residual {worst:.3g}")
    out = rows.select(*keys, F.posexplode(F.array(*every(lambda k: f"x{k}"))).alias("_slot", "score")).where("score <> 0")
    return out.join(places, ["_chunk", "_slot"]).select("node", "class", "score")


def _row(classes: list, chunk: int, width: int) -> list:
    """A chunk's classes; the last one may have fewer, and then has places of no class."""
    row = classes[chunk * width : (chunk + 1) * width]
    return row + [_NONE] * (width - len(row))


_NONE = object()
