"""Sparse factorisations against dense solves; patterns are made once."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.operators import factorisation as X
from shardloom.operators import graph, propagation, solves


def spd(n, seed, density=0.15):
    rng = np.random.default_rng(seed)
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < density), 1)
    w = w + w.T
    return np.diag(w.sum(axis=1) + 0.2 + rng.random(n)) - w


@given(st.integers(1, 60), st.integers(0, 10**6), st.sampled_from([0.03, 0.15, 0.7]), st.sampled_from([0, 5, 64]))
@settings(max_examples=50, deadline=None)
def test_factor_equals_the_dense_solve(n, seed, density, least):
    was, X.DENSE_COLUMNS = X.DENSE_COLUMNS, least
    try:
        a = spd(n, seed, density)
        i, j = np.nonzero(a)
        order, columns = X.elimination(n, i, j)
        assert sorted(order.tolist()) == list(range(n)) and all(v not in c for v, c in zip(order.tolist(), columns, strict=False))
        y = np.random.default_rng(seed + 1).random((n, 3))
        assert np.allclose(X.Factor(order, columns, i, j, a[i, j]).solve(y), np.linalg.solve(a, y))
    finally:
        X.DENSE_COLUMNS = was


def test_little_fill_on_a_path():
    n = 500
    i = np.arange(n - 1)
    order, columns = X.elimination(n, np.concatenate([i, i + 1]), np.concatenate([i + 1, i]))
    assert max(map(len, columns)) <= 2 and len(columns) >= n - X.DENSE_COLUMNS


def test_indefinite_matrices_raise():
    i = np.array([0, 1, 0, 1])
    j = np.array([0, 1, 1, 0])
    with pytest.raises(ValueError, match="positive definite"):
        X.Factor(*X.elimination(2, i, j), i, j, np.array([1.0, 1.0, 2.0, 2.0]))


def test_components_share_patterns_among_systems(spark):
    a = np.zeros((30, 30))
    a[:17, :17], a[17:29, 17:29], a[29, 29] = spd(17, 1), spd(12, 2), 2.0
    ids = np.random.default_rng(3).permutation(1000)[:30]
    i, j = np.nonzero(a)
    frame = lambda m: spark.createDataFrame([(int(ids[p]), int(ids[q]), float(m[p, q])) for p, q in zip(i, j, strict=True)], "src long, dst long, a double").repartition(3)
    edges = frame(a).where("src <> dst").withColumnRenamed("a", "w")
    nodes = spark.createDataFrame([(int(v),) for v in ids], "node long")
    component = graph.components(edges, nodes, "node")
    y = np.zeros((30, 3))
    y[0, 0], y[20, 1], y[3, 1], y[29, 2] = 1, 2, 3, 4
    right = spark.createDataFrame([(int(ids[p]), f"c{q}", float(y[p, q])) for p, q in zip(*np.nonzero(y), strict=True)], "node long, class string, y double")
    made = spark.sparkContext.accumulator(0)
    known = X.patterns(frame(a), component, made)
    place = {int(v): k for k, v in enumerate(ids)}
    for m in (a, a + np.diag(np.arange(1.0, 31))):  # two systems of one pattern
        got = np.zeros((30, 3))
        for r in X.factored(frame(m), component, right, known).collect():
            got[place[r["node"]], int(r["class"][1:])] = r["score"]
        assert np.allclose(got, np.linalg.solve(m, y))
    assert made.value == known.count() == component.select("component").distinct().count() >= 3


def test_too_large_components_raise(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST_NODES", 3)
    component = spark.createDataFrame([(i, 0) for i in range(4)], "node long, component long")
    with pytest.raises(ValueError, match="4 nodes"):
        X.patterns(spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, a double"), component)


def test_mixed_propagation_by_factors(spark):
    rng = np.random.default_rng(7)
    w = np.triu(rng.random((20, 20)) * (rng.random((20, 20)) < 0.3), 1)
    w = w + w.T
    edges = spark.createDataFrame([(int(p), int(q), float(w[p, q])) for p, q in zip(*np.nonzero(w), strict=True)], "src long, dst long, w double")
    nodes = spark.createDataFrame([(i,) for i in range(20)], "node long")
    seeds = spark.createDataFrame([(0, 0), (5, 1), (9, 2)], "node long, class int")
    one, two = ({(r["node"], r["class"]): r["score"] for r in propagation.mixed_propagation(edges, nodes, seeds, solver=s).collect()} for s in ("cg", "factor"))
    assert set(one) == set(two) and all(abs(one[k] - two[k]) < 1e-8 for k in one)
    with pytest.raises(ValueError, match="solver"):
        propagation.mixed_propagation(edges, nodes, seeds, solver="lu")
    assert solves.matrix(edges, nodes.selectExpr("node", "1.0D as diagonal")).count() == edges.count() + 20


def test_components_too_large_for_a_factor_are_solved_too(spark, monkeypatch):
    """One component of 20 nodes and one of 3, where a task factors 8 at most."""
    monkeypatch.setattr(propagation, "FACTOR_NODES", 8, raising=False)
    monkeypatch.setattr(X, "MOST_NODES", 8)
    w = np.zeros((23, 23))
    rng = np.random.default_rng(7)
    w[:20, :20] = np.triu(rng.random((20, 20)) * (rng.random((20, 20)) < 0.4), 1)
    w[20, 21], w[21, 22] = 0.5, 0.25
    w = w + w.T
    edges = spark.createDataFrame([(int(p), int(q), float(w[p, q])) for p, q in zip(*np.nonzero(w), strict=True)], "src long, dst long, w double")
    nodes = spark.createDataFrame([(i,) for i in range(23)], "node long")
    seeds = spark.createDataFrame([(0, 0), (5, 1), (9, 2), (20, 1)], "node long, class int")
    one, two = ({(r["node"], r["class"]): r["score"] for r in propagation.mixed_propagation(edges, nodes, seeds, solver=s).collect()} for s in ("cg", "factor"))
    assert {n for n, _ in two} == set(range(23))
    assert set(one) == set(two) and all(abs(one[k] - two[k]) < 1e-8 for k in one)
