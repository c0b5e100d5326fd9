"""Sparse factorisations of symmetric positive definite systems, a connected component at a time.

The symbolic part (elimination order and the factor's pattern) depends on where entries are only; it is made once a
component and stored, and every system of that pattern factors by it. A numeric factor serves all classes' right sides at
once. Components are spread over tasks; one must fit a task, and larger ones are for conjugate gradients (:mod:`.solves`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut

#: Nodes of the largest component that is factored.
MOST_NODES = 20_000
#: Columns are eliminated one by one until the rest has no more columns than this, or is this dense.
DENSE_COLUMNS, DENSE_SHARE = 64, 0.4


def elimination(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of elimination by least degree, and for each eliminated node the nodes of its column then; what is left at
    the end of the order is dense enough to be factored as a whole."""
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        if a != b:
            near[a].add(b)
            near[b].add(a)
    by_degree: dict[int, set[int]] = {}
    for v in range(n):
        by_degree.setdefault(len(near[v]), set()).add(v)
    order, columns, left, entries = [], [], n, sum(map(len, near))
    least = 0
    while left > DENSE_COLUMNS and entries < DENSE_SHARE * left * left:
        while not by_degree.get(least):
            least += 1
        v = min(by_degree[least])
        by_degree[least].discard(v)
        column = sorted(near[v])
        order.append(v)
        columns.append(np.array(column, dtype=np.int64))
        entries -= 2 * len(column)
        for u in column:
            by_degree[len(near[u])].discard(u)
            before = len(near[u])
            near[u].discard(v)
            near[u].update(column)
            near[u].discard(u)
            entries += len(near[u]) - before + 1
            by_degree.setdefault(len(near[u]), set()).add(u)
            least = min(least, len(near[u]))
        near[v] = set()
        left -= 1
    done = set(order)
    return np.array(order + [v for v in range(n) if v not in done], dtype=np.int64), columns


class Factor:
    """The numeric factor of a matrix by a known elimination, in positions of its order: sparse columns, then a dense
    block of what is left."""

    def __init__(self, order: np.ndarray, columns: list[np.ndarray], i: np.ndarray, j: np.ndarray, a: np.ndarray):
        n, m = len(order), len(columns)
        at = np.empty(n, dtype=np.int64)
        at[order] = np.arange(n)
        self.order, self.m = order, m
        self.columns = [np.sort(at[c]) for c in columns]
        self.values = [np.zeros(len(c)) for c in columns]
        self.pivots = np.zeros(m)
        block = np.zeros((n - m, n - m))
        p, q = at[i], at[j]
        inner = (p >= m) & (q >= m)
        np.add.at(block, (p[inner] - m, q[inner] - m), a[inner])
        on = (p == q) & ~inner
        np.add.at(self.pivots, p[on], a[on])
        for c, r, v in zip(*(x[(p < q) & ~inner].tolist() for x in (p, q, a)), strict=True):
            self.values[c][np.searchsorted(self.columns[c], r)] += v
        for c in range(m):
            if self.pivots[c] <= 0:
                raise ValueError("the matrix is not positive definite")
            below, x = self.columns[c], self.values[c]
            scaled = x / self.pivots[c]
            s = int(np.searchsorted(below, m))
            self.pivots[below[:s]] -= (x * scaled)[:s]
            for k in range(s):
                u = below[k]
                self.values[u][np.searchsorted(self.columns[u], below[k + 1 :])] -= x[k] * scaled[k + 1 :]
            rest = below[s:] - m
            block[np.ix_(rest, rest)] -= np.outer(x[s:], scaled[s:])
            self.values[c] = scaled
        try:
            np.linalg.cholesky(block)
        except np.linalg.LinAlgError as e:
            raise ValueError("the matrix is not positive definite") from e
        self.block = block

    def solve(self, right: np.ndarray) -> np.ndarray:
        """``x`` for each column of ``right``."""
        x = right[self.order].astype(np.float64)
        for c in range(self.m):
            x[self.columns[c]] -= self.values[c][:, None] * x[c]
        x[self.m :] = np.linalg.solve(self.block, x[self.m :])
        for c in range(self.m - 1, -1, -1):
            x[c] = x[c] / self.pivots[c] - self.values[c] @ x[self.columns[c]]
        out = np.empty_like(x)
        out[self.order] = x
        return out


def _by_component(a: DataFrame, component: DataFrame) -> DataFrame:
    """(component, nodes, src, dst, a): the sorted nodes and the entries of each component, one row each, in node order."""
    sizes = component.groupBy("component").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > MOST_NODES).first()
    if large is not None:
        raise ValueError(f"component {large['component']} has {large['_n']} nodes, more than a task factors ({MOST_NODES})")
    entries = a.join(component.withColumnRenamed("node", "src"), "src").groupBy("component").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "a"))).alias("e"))
    nodes = component.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    return nodes.join(entries, "component").select("component", "nodes", F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), F.col("e.a").alias("a"))


def patterns(a: DataFrame, component: DataFrame, made: Accumulator | None = None) -> DataFrame:
    """(component, order, ends, columns): the stored symbolic factor of each component; positions in sorted nodes.
    ``made`` counts how many were computed."""

    def run(batches):
        for batch in batches:
            out = []
            for nodes, src, dst in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                ids = np.array(nodes)
                order, columns = elimination(len(ids), np.searchsorted(ids, src), np.searchsorted(ids, dst))
                out.append((order, np.cumsum([len(c) for c in columns]), np.concatenate([np.empty(0, dtype=np.int64), *columns])))
                if made is not None:
                    made.add(1)
            cols = [pa.array([o[k] for o in out], pa.list_(pa.int64())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["component", "order", "ends", "columns"])

    kind = dict(component.dtypes)["component"]
    return _cut(_by_component(a, component).mapInArrow(run, f"component {kind}, order array<long>, ends array<long>, columns array<long>"))


def factored(a: DataFrame, component: DataFrame, right: DataFrame, known: DataFrame) -> DataFrame:
    """(node, class, score) with ``a score = y`` for all classes of ``right`` (node, class, y), by the patterns of ``known``
    (of a matrix with entries in the same places). Classes without a right side in a component have no scores there."""
    sides = right.join(component, "node").groupBy("component").agg(F.array_sort(F.collect_list(F.struct("class", "node", F.col("y").cast("double").alias("y")))).alias("r"))
    rows = _by_component(a, component).join(known, "component").join(sides, "component")
    node, kind = (dict(right.dtypes)[c] for c in ("node", "class"))

    def run(batches):
        for batch in batches:
            for nodes, src, dst, values, order, ends, columns, sides in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                ids = np.array(nodes)
                i, j = np.searchsorted(ids, src), np.searchsorted(ids, dst)
                starts = [0, *ends]
                columns = np.array(columns, dtype=np.int64)
                factor = Factor(np.array(order), [columns[p:q] for p, q in zip(starts[:-1], starts[1:], strict=True)], i, j, np.array(values))
                classes = sorted({s["class"] for s in sides})
                y = np.zeros((len(ids), len(classes)))
                for s in sides:
                    y[np.searchsorted(ids, s["node"]), classes.index(s["class"])] += s["y"]
                x = factor.solve(y)
                p, q = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(ids[p].tolist(), types[0]), pa.array([classes[k] for k in q.tolist()], types[1]), pa.array(x[p, q])], names=["node", "class", "score"])

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = arrow[node], arrow[kind]
    return rows.select("nodes", "src", "dst", "a", "order", "ends", "columns", "r").mapInArrow(run, f"node {node}, class {kind}, score double")
