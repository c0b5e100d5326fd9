"""Distributed solves and two-pass retrieval against dense numpy."""

import numpy as np
import pytest

from shardloom.operators import propagation, retrieval, solves


def long(spark, m, names):
    i, j = np.nonzero(m)
    return spark.createDataFrame([(int(a), int(b), float(m[a, b])) for a, b in zip(i, j, strict=True)], names)


def random_graph(n, seed, density=0.2):
    rng = np.random.default_rng(seed)
    w = np.triu(rng.random((n, n)) * (rng.random((n, n)) < density), 1)
    return w + w.T


def dense(rows, shape):
    out = np.zeros(shape)
    for r in rows:
        out[r["node"], r["class"]] = r["score"]
    return out


def plain_cg(a, b, rounds):
    x, r = np.zeros(len(b)), b.copy()
    p = r.copy()
    for _ in range(rounds):
        ap = a @ p
        step = (r @ r) / (p @ ap)
        x, new = x + step * p, r - step * ap
        p, r = new + (new @ new) / (r @ r) * p, new
    return x


@pytest.fixture(scope="module")
def problem(spark):
    w = random_graph(24, 5)
    w[20:] = w[:, 20:] = 0
    w[20, 21] = w[21, 20] = 0.5  # a component of its own; nodes 22 and 23 are alone
    d = w.sum(axis=1) + 0.3
    y = np.zeros((24, 4))
    y[0, 0], y[1, 1], y[2, 1], y[20, 2] = 1.0, -2.0, 0.5, 3.0  # class 3 has no right side
    edges = long(spark, w, "src long, dst long, w double")
    nodes = spark.createDataFrame([(i, float(v)) for i, v in enumerate(d)], "node long, diagonal double")
    right = long(spark, y, "node long, class int, y double")
    return np.diag(d) - w, y, solves.matrix(edges, nodes, -1.0), right


def test_solves_all_classes(spark, problem):
    a, y, m, right = problem
    got = solves.conjugate_gradients(m, right, 200, 1e-11)
    assert np.allclose(dense(got.collect(), y.shape), np.linalg.solve(a, y), atol=1e-9)


def test_truncated_iterates_are_the_usual_ones(spark, problem):
    a, y, m, right = problem
    got = dense(solves.conjugate_gradients(m, right, 3, 1e-12, strict=False).collect(), y.shape)
    for c in range(2):
        assert np.allclose(got[:, c], plain_cg(a, y[:, c], 3), atol=1e-10)


def test_warm_start_needs_no_round_and_unfinished_classes_raise(spark, problem):
    a, y, m, right = problem
    x = np.linalg.solve(a, y)
    x[:, 3] = 7  # a zero right side has the solution zero, whatever the start
    start = long(spark, x, "node long, class int, score double")
    got = solves.conjugate_gradients(m, right, 1, 1e-9, start=start)
    assert np.allclose(dense(got.collect(), y.shape), np.linalg.solve(a, y), atol=1e-8)
    with pytest.raises(ValueError, match="no convergence in 2 rounds: [23] classes"):
        solves.conjugate_gradients(m, right, 2, 1e-12)
    with pytest.raises(ValueError, match="positive"):
        solves.conjugate_gradients(m, right, 0)


def test_no_right_sides(spark, problem):
    *_, m, right = problem
    assert not solves.conjugate_gradients(m, right.where("y > 99"), 5).collect()


def test_mixed_propagation_is_the_dense_one(spark):
    w = random_graph(14, 2, 0.5)
    n, mu, temperature, k = 14, 1 / 99, 4.0, 3
    seeds = {0: 0, 3: 1, 5: 2, 7: 1}
    edges = long(spark, w, "src long, dst long, w double")
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node long")
    s = spark.createDataFrame(list(seeds.items()), "node long, class int")
    got = dense(propagation.mixed_propagation(edges, nodes, s).collect(), (n, k))
    d, y = w.sum(axis=1), np.zeros((n, k))
    lap = np.diag(d) - w
    for i, c in seeds.items():
        y[i, c], lap[i, i] = mu, lap[i, i] + mu
    f = np.linalg.solve(lap, y)
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    sure = lambda p: 1 + (p * np.log(p)).sum() / np.log(k)
    g = np.zeros((n, n))
    for i, j in zip(*np.nonzero(w), strict=True):
        p, q = soft(temperature * (d[i] * f[i] - w[i, j] * f[j])), soft(temperature * (d[j] * f[j] - w[i, j] * f[i]))
        g[i, j] = sure(p) * sure(q) * (1 - p @ q)
    assert np.allclose(got, np.linalg.solve(lap + 2 * (np.diag(g.sum(axis=1)) + g), y), atol=1e-8)


def test_confident_needs_mass(spark):
    nodes = spark.createDataFrame([(0,), (1,)], "node long")
    seeds = spark.createDataFrame([(0, 4), (5, 2)], "node long, class int")
    scores = spark.createDataFrame([(0, 4, 2.0)], "node long, class int, score double")
    row = propagation.confident(scores, nodes.where("node = 0"), seeds).first()
    assert (row["pred_label"], row["confidence"]) == (4, 1.0)
    with pytest.raises(Exception, match="without mass"):
        propagation.confident(scores, nodes, seeds).collect()


def brute_metrics(ids, x, labels, ks, queries=None, refs=None):
    u = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    same = refs is None
    queries, refs = (range(len(x)),) * 2 if same else (queries, refs)
    out = {}
    for q in queries:
        order = sorted((r for r in refs if not same or r != q), key=lambda r: (-(u[q] @ u[r]), ids[r]))
        rel = [labels[r] is not None and labels[r] == labels[q] for r in order]
        size = sum(rel)
        if size:
            top = rel[:size]
            out[ids[q]] = (float(rel[0]), sum(v * sum(top[: i + 1]) / (i + 1) for i, v in enumerate(top)) / size, sum(top) / size, *[float(any(rel[:k])) for k in ks])
    return out


@pytest.mark.parametrize("blocks", [64 << 20, 2000])
def test_retrieval_of_uneven_classes(spark, monkeypatch, blocks):
    from shardloom.operators import knn

    monkeypatch.setattr(knn, "BLOCK_BYTES", blocks)
    rng = np.random.default_rng(4)
    labels = [0] * 60 + [1] * 20 + [2] * 5 + [3] + [None] * 4
    x = np.round(rng.normal(size=(90, 5)) + np.array([(c or 0) for c in labels])[:, None], 1)
    x[10] = x[11] = x[60]  # ties
    x[5] = 0
    ids = rng.permutation(1000)[:90].tolist()
    df = spark.createDataFrame([(i, v.tolist(), c) for i, v, c in zip(ids, x, labels, strict=True)], "vec_id long, embedding array<double>, label int")
    rows = retrieval.query_metrics(df, df, "embedding", "label", ks=(1, 3)).collect()
    want = brute_metrics(ids, x, labels, (3,))
    assert {r["query_id"] for r in rows} == set(want)
    for r in rows:
        assert np.allclose((r["precision_at_1"], r["map_at_r"], r["r_precision"], r["hit_at_3"]), want[r["query_id"]])
    deepest = retrieval.ranked_hits(df, df, "embedding", "label", 3).groupBy("label").agg({"rank": "max", "r": "max"}).collect()
    assert {r["label"]: r["max(rank)"] for r in deepest} == {0: 59, 1: 19, 2: 4}


def test_retrieval_state_does_not_grow_with_references(monkeypatch):
    """A query keeps what it needs and a fixed room; packed runs, blocks and cuts at ties do not change its ranks."""
    monkeypatch.setattr(retrieval, "STEP", 8)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(300, 3)), 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100:200] = x[50]  # many equal scores
    labels, ids = rng.integers(0, 5, 300), np.arange(300)
    need = np.full(20, 30)
    state = retrieval.Ranking(x[40:60], ids[40:60], labels[40:60], need, True)
    assert len(state.scores) == (retrieval._room(need)).sum() < 20 * 300
    for j in range(0, 300, 50):
        state.add(x[j : j + 50], ids[j : j + 50], labels[j : j + 50])
    for k, (n, ranks) in zip(range(40, 60), state.partners(), strict=True):
        s = x[[k]] @ x.T
        order = [r for r in np.argsort(-np.round(s[0], 12), kind="stable") if r != k][:30]
        assert n == 30 and ranks.tolist() == [i + 1 for i, r in enumerate(order) if labels[r] == labels[k]]


@pytest.mark.parametrize("room", [160 << 20, 20_000])
def test_metrics_leave_tasks_as_a_row_a_query(spark, monkeypatch, room):
    """Of blocks of any size comes one row a query, not one a ranked reference."""
    monkeypatch.setattr(retrieval, "STATE_BYTES", room)
    monkeypatch.setattr(retrieval, "PACK_BYTES", 400)
    rng = np.random.default_rng(8)
    x, labels = rng.normal(size=(80, 5)), rng.integers(0, 3, 80).tolist()
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    stored, cut = [], retrieval._cut
    monkeypatch.setattr(retrieval, "_cut", lambda d: stored.append(cut(d)) or stored[-1])
    got = {r["query_id"]: r for r in retrieval.query_metrics(df.where("vec_id % 4 = 0"), df.where("vec_id % 4 <> 0"), "embedding", "label", ks=(1, 5), same_source=False).collect()}
    want = brute_metrics(list(range(80)), x, labels, (5,), [i for i in range(80) if i % 4 == 0], [i for i in range(80) if i % 4])
    assert stored[-1].count() == len(want) == len(got)
    assert all(np.allclose([got[k][c] for c in ("precision_at_1", "map_at_r", "r_precision", "hit_at_5")], want[k]) for k in want)


def test_more_classes_than_a_row_has(spark, problem, monkeypatch):
    a, y, m, right = problem
    monkeypatch.setattr(solves, "WIDE", 2)  # three classes with right sides: two rows a node
    x = np.linalg.solve(a, y)
    for start in (None, long(spark, x + 0.1, "node long, class int, score double")):
        got = solves.conjugate_gradients(m, right, 200, 1e-11, start=start)
        assert np.allclose(dense(got.collect(), y.shape), x, atol=1e-9)
