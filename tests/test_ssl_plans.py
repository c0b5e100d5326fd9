"""Protocols, pair traces and regularisers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.operators import pair_trace, protocols
from shardloom.plans import regularisers

CLASSES = [(c, c // 4) for c in range(12)]


@pytest.mark.parametrize(("name", "dev", "test"), [("unseen_classes", 7, 5), ("unseen_classes_interleaved", 8, 4), ("unseen_classes_within_superclass", 6, 6), ("unseen_superclasses", 4, 8)])
def test_class_disjoint_plans(name, dev, test):
    plan = protocols.resolve(name, CLASSES)
    assert (len(plan.development), len(plan.held_out)) == (dev, test) and not set(plan.development) & set(plan.held_out)
    assert plan.class_disjoint and set(plan.development) | set(plan.held_out) == set(range(12))
    if plan.superclass_disjoint:
        assert not {c // 4 for c in plan.development} & {c // 4 for c in plan.held_out}


def test_bad_plans_raise():
    for call in (
        lambda: protocols.resolve("none", CLASSES),
        lambda: protocols.resolve("balanced_fraction", CLASSES, train=0.9, test=0.2),
        lambda: protocols.resolve("balanced_fraction", CLASSES, train=0.0, test=0.2),
        lambda: protocols.resolve("unseen_classes", CLASSES, share=1.0),
        lambda: protocols.resolve("unseen_superclasses", [(1, 1), (2, 1)]),
        lambda: protocols.resolve("unseen_superclasses", [(1, None), (2, 1)]),
        lambda: protocols.resolve("official", [(1, 1), (1, 2)]),
        lambda: protocols.Plan("p", "b", (1, 2), (2, 3)).check(CLASSES),
        lambda: protocols.Plan("p", "b", (1, 2), (99,)).check(CLASSES),
        lambda: protocols.Plan("p", "b", (0,), (1,), superclass_disjoint=True).check(CLASSES),
        lambda: protocols.protocol("official")(lambda classes: None),
    ):
        with pytest.raises(ValueError):
            call()


def sources(spark):
    rows = spark.createDataFrame([(i, i % 12) for i in range(240)], "s long, l long")
    return rows.where("s < 200"), rows.where("s >= 200")


def test_loading_joins_sources_and_pushes_classes(spark, tmp_path):
    train, test = sources(spark)
    plan = protocols.resolve("unseen_superclasses", CLASSES)
    dev, held = protocols.load(plan, train, test, "s", "l")
    assert dev.count() == 80 and held.count() == 160 and not dev.join(held, "l").count()
    train.write.parquet(str(tmp_path / "a"))
    read = spark.read.parquet(str(tmp_path / "a"))
    text = protocols.load(plan, read, read, "s", "l")[0]._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [In(l" in text
    official = protocols.load(protocols.resolve("official", CLASSES), train, test, "s", "l")
    assert [d.count() for d in official] == [200, 40]


def test_loading_long_class_lists_tails_and_fractions(spark, monkeypatch):
    train, test = sources(spark)
    plan = protocols.resolve("unseen_classes", CLASSES)
    short = [d.count() for d in protocols.load(plan, train, test, "s", "l")]
    monkeypatch.setattr(protocols, "MOST_LISTED", 2)
    assert [d.count() for d in protocols.load(plan, train, test, "s", "l")] == short == [140, 100]
    tail = protocols.load(plan, train, test, "s", "l", long_tail=0.1)[0].groupBy("l").count().orderBy("l").collect()
    assert tail[0]["count"] == 20 and tail[-1]["count"] == 2
    half = protocols.resolve("balanced_fraction", CLASSES, train=0.5, test=0.25)
    a, b = protocols.load(half, train, test, "s", "l")
    assert (a.count(), b.count(), a.join(b, "s").count()) == (120, 60, 0)
    for bad in (lambda: protocols.load(half, train, test, "s", "l", long_tail=0.5), lambda: protocols.load(plan, train, test, "s", "l", long_tail=0.0), lambda: protocols.load(protocols.resolve("balanced_fraction", CLASSES, train=0.5, test=0.01), train, test, "s", "l")):
        with pytest.raises(ValueError):
            bad()


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(70, 4))
    label = [i % 3 if i % 4 == 0 else None for i in range(70)]
    return x, label, spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label long")


@pytest.mark.parametrize("band", [None, 0.3, 0.0])
def test_traces_sum_to_the_loss(points, band):
    x, label, df = points
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 2 - 2 * u @ u.T
    i, j = np.triu_indices(70, 1)
    both = np.array([label[a] is not None and label[b] is not None for a, b in zip(i, j, strict=True)])
    equal = np.array([label[a] == label[b] for a, b in zip(i, j, strict=True)])
    want_eta = (d[i, j][both & equal].mean() + d[i, j][both & ~equal].mean()) / 2
    eta = pair_trace.midpoint(df, "embedding", 1.0, width=16)
    assert abs(eta - want_eta) < 1e-12
    own = d[i, j][~both]
    z = (eta - own) / 0.5
    h = np.logaddexp(0, z) - z / (1 + np.exp(-z))
    chosen = np.ones(len(own), bool) if band is None else np.abs(own - eta) <= band
    trace = pair_trace.block_trace(df, "embedding", eta, 0.5, band, width=16)
    rows = trace.collect()
    loss = h[chosen].mean() if chosen.any() else 0.0
    assert abs(sum(r["contribution"] for r in rows) - loss) < 1e-6
    assert sum(r["candidates"] for r in rows) == len(own) and sum(r["selected"] for r in rows) == chosen.sum()
    assert abs(sum(r["weight"] for r in rows) - bool(chosen.any())) < 1e-9
    one = trace.where("left_block = 0 and right_block = 2")
    pairs = pair_trace.traced_pairs(df, one, "embedding", eta, 0.5, band, width=16).collect()
    assert abs(sum(r["contribution"] for r in pairs) - sum(r["contribution"] for r in one.collect())) < 1e-9
    assert len(pairs) == sum(r["candidates"] for r in one.collect())
    assert all((label[r["i"]] is not None) == (r["kind"] == "lu") and label[r["j"]] is None and abs(r["d"] - d[r["i"], r["j"]]) < 1e-9 for r in pairs)


def test_midpoint_falls_back(points):
    df = points[2]
    assert pair_trace.midpoint(df.where("label is null"), "embedding", 0.7) == 0.7
    assert pair_trace.midpoint(df.where("label = 0"), "embedding", 0.7) == 0.7


def test_plug_ins_from_outside(spark, points):
    df = points[2]
    supervised = spark.createDataFrame([(2.0,)], "loss double")

    @regularisers.regulariser("norms")
    class Norms(regularisers.Regulariser):
        def batches(self, rows):
            return rows.withColumn("batch", F.col("vec_id") % 3)

        def objective(self, batches):
            return batches.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("embedding").cast("double")).alias("loss"))

    @regularisers.regulariser("counts")
    class Counts(regularisers.Regulariser):
        def dataset(self, labelled, unlabelled):
            return labelled.unionByName(unlabelled)

        def objective(self, batches):
            return batches.groupBy("batch").agg(F.lit(1).alias("n"), F.count(F.lit(1)).cast("double").alias("loss"))

    try:
        labelled, free = df.where("label is not null"), df.where("label is null")
        row = regularisers.total(regularisers.get("norms", weight=0.5), labelled, free, supervised).first()
        assert (row["name"], row["supervised"], row["regularisation"], row["total"]) == ("norms", 2.0, 4.0, 4.0)
        row = regularisers.total(regularisers.get("counts", weight=1.0, supervised_weight=0.0), labelled, free, supervised).first()
        assert (row["supervised"], row["regularisation"], row["total"]) == (None, 70.0, 70.0)
        broken = df.withColumn("embedding", F.raise_error(F.lit("must not be read")).cast("array<double>"))
        row = regularisers.total(regularisers.get("norms", weight=0.0, supervised_weight=3.0), broken, broken, supervised).first()
        assert (row["regularisation"], row["total"]) == (None, 6.0)
        with pytest.raises(ValueError, match="exists"):
            regularisers.regulariser("norms")(Counts)
    finally:
        regularisers.REGISTRY.pop("norms")
        regularisers.REGISTRY.pop("counts")


def test_registry_refuses(points):
    with pytest.raises(ValueError, match="unknown regulariser 'x'; known: laplacian, pair_entropy"):
        regularisers.get("x")
    for options in ({"weight": -1.0}, {"weight": float("nan")}, {"weight": 0.0, "supervised_weight": 0.0}):
        with pytest.raises(ValueError):
            regularisers.get("laplacian", **options)
    with pytest.raises(TypeError, match="objective"):
        regularisers.regulariser("empty")(type("Empty", (regularisers.Regulariser,), {}))


def test_simmatch_total_by_numpy(spark):
    from shardloom.operators import simmatch

    rng = np.random.default_rng(9)
    n, m, q, c, d, t, a = 12, 9, 7, 3, 4, 0.2, 0.3
    lab, zx = rng.integers(0, c, m), rng.normal(size=(m, c))
    zs, zt, s, v = rng.normal(size=(n, c)), 2 * rng.normal(size=(n, c)), rng.normal(size=(n, d)), rng.normal(size=(n, d))
    anchors, bank, probs = rng.normal(size=(m, d)), rng.normal(size=(q, d)), rng.dirichlet(np.ones(c), q)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    soft = lambda x: np.exp(x - x.max(axis=-1, keepdims=True)) / np.exp(x - x.max(axis=-1, keepdims=True)).sum(axis=-1, keepdims=True)
    mean, p = np.full(c, 1 / c), np.empty((n, c))
    for b in range(3):
        raw = soft(zt[b * 4 : b * 4 + 4])
        r = raw / np.maximum(mean, 1e-7)
        p[b * 4 : b * 4 + 4] = r / r.sum(axis=1, keepdims=True)
        mean = 0.6 * mean + 0.4 * raw.mean(axis=0)
    prop = np.empty((n, c))
    for i in range(n):
        near = np.argsort(-(unit(anchors) @ unit(v[i])), kind="stable")[:3]
        x = np.vstack([unit(v[i]), unit(anchors[near])])
        logits = x @ x.T / t
        np.fill_diagonal(logits, -np.inf)
        f = 0.7 * np.linalg.solve(np.eye(4) - a * soft(logits), np.vstack([p[i], np.eye(c)[lab[near]]]))[0]
        prop[i] = f / f.sum()
    ts, ss = soft(unit(v) @ unit(bank).T / t), soft(unit(s) @ unit(bank).T / t)
    sure = p.max(axis=1) >= 0.5
    want = [-np.log(soft(zx))[np.arange(m), lab].mean(), (-(prop * np.log(soft(zs))).sum(axis=1) * sure).mean(), -(ts * np.log(np.maximum(ss, 1e-7))).sum(axis=1).mean(), -(p * np.log(np.maximum(ss @ probs, 1e-7))).sum(axis=1).mean()]
    lists = lambda *columns: [tuple(x.tolist() if isinstance(x, np.ndarray) else int(x) for x in r) for r in zip(*columns, strict=True)]
    frames = (
        spark.createDataFrame(lists(range(m), lab, zx), "id long, label int, logits array<double>"),
        spark.createDataFrame(lists(range(n), [i // 4 for i in range(n)], zs, s, zt, v), "id long, batch long, student_logits array<double>, student array<double>, teacher_logits array<double>, teacher array<double>"),
        spark.createDataFrame(lists(range(m), anchors, lab), "id long, v array<double>, label int"),
        spark.createDataFrame(lists(range(q), bank, probs), "slot long, v array<double>, p array<double>"),
    )
    got = simmatch.total_loss(*frames, c, top_n=3, temperature=t, alpha=a, threshold=0.5, weights=(1, 2, 3, 4), momentum=0.6).first()
    assert np.allclose([got[k] for k in ("classification", "node_node", "edge_edge", "node_edge")], want)
    assert np.isclose(got["total"], np.dot(want, [1, 2, 3, 4])) and np.isclose(got["confident"], sure.mean())
    with pytest.raises(ValueError, match="queue"):
        simmatch.relations(frames[1], frames[3].where("slot < 0"), ["teacher", "student"], t)


def test_dotted_paths():
    from shardloom.plans import config

    base = {"a": {"b": 1}, "c": 2}
    assert config.with_value(base, "a.b", 3) == {"a": {"b": 3}, "c": 2} and base == {"a": {"b": 1}, "c": 2}
    assert config.with_value(base, "a.x.y", 4) == {"a": {"b": 1, "x": {"y": 4}}, "c": 2}
    assert config.overridden(base, "label", {"label.a.b": 9, "label.k": 1, "rate": 0.1, "labels.z": 3}) == {"a": {"b": 9}, "c": 2, "k": 1}
    for path in ("", "c.d", "a.", ".a"):
        with pytest.raises(ValueError):
            config.with_value(base, path, 0)
    with pytest.raises(ValueError, match="no key"):
        config.overridden(base, "label", {"label": 1})


def test_split_lists_and_their_files(spark, tmp_path):
    from shardloom.sources import sinks

    rows = [(10 * i, ("labeled", "unlabeled", "valid")[i % 3]) for i in range(12)]
    lists = sinks.split_lists(spark.createDataFrame(rows, "s long, part string"), "part", "s")
    sinks.write_split_lists(lists, str(tmp_path / "split"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "split")).orderBy("list", "place").collect():
        got.setdefault(r["list"], []).append(r["value"])
        assert r["place"] == len(got[r["list"]]) - 1
    assert got["train_indices"] == [0, 10, 30, 40, 60, 70, 90, 100] and got["valid_indices"] == [20, 50, 80, 110]
    assert got["labeled_positions"] == [0, 2, 4, 6] and got["unlabeled_indices"] == [10, 40, 70, 100]
    assert [got["train_indices"][p] for p in got["unlabeled_positions"]] == got["unlabeled_indices"]


def test_grid_rows_with_and_without_studies(spark):
    from shardloom.operators import trials

    scenarios = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "s string")
    studies = spark.createDataFrame([("a", 4, 0.9, 0.5), ("b", 7, 0.8, 0.6)], "s string, best_trial_number long, best_hpo_value double, m double")
    runs = spark.createDataFrame([("b", 9, 0.7, 1.0), ("c", -1, 0.1, None)], "s string, last_epoch long, m double, t double")
    got = {r["s"]: tuple(r)[1:] for r in trials.grid_rows(scenarios, studies, runs, ["s"], ["m", "t"]).collect()}
    assert got == {"a": (4, 0.9, 0.5, None, None), "b": (7, 0.8, 0.7, 1.0, 10), "c": (None, None, 0.1, None, 0), "d": (None, None, None, None, None)}
    with pytest.raises(Exception, match="several runs"):
        trials.grid_rows(scenarios, studies, runs.unionByName(runs), ["s"], ["m"]).collect()


def test_relations_to_a_queue_of_several_blocks(spark, monkeypatch):
    """A queue of many blocks gives what one block does."""
    from shardloom.operators import simmatch

    rng = np.random.default_rng(5)
    t, s, bank, probs = (rng.normal(size=(k, 3)) for k in (11, 11, 40, 40))
    probs = np.abs(probs) / np.abs(probs).sum(axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(t, s, strict=True))], "id long, t array<double>, s array<double>")
    queue = spark.createDataFrame([(i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(bank, probs, strict=True))], "slot long, v array<double>, p array<double>")
    soft = lambda x: np.exp(x - x.max(axis=1, keepdims=True)) / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
    p, q = soft(t @ bank.T / 0.05), soft(s @ bank.T / 0.05)
    monkeypatch.setattr(simmatch, "BLOCK_BYTES", 6 * 6 * 8)
    got = {r["id"]: r for r in simmatch.relations(rows, queue, ["t", "s"], 0.05).collect()}
    assert len(got) == 11
    for i in range(11):
        assert np.isclose(got[i]["edge"], -(p[i] * np.log(np.maximum(q[i], 1e-7))).sum()) and np.allclose(got[i]["expected"], q[i] @ probs)


def test_traces_of_narrow_blocks_ship_rows_once_a_run(spark, monkeypatch):
    """Blocks of two ids: a row goes to as many tasks as there are runs of 16 ids, and the sums are those of its blocks."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    label = [i % 3 if i % 4 == 0 else None for i in range(60)]
    df = spark.createDataFrame([(i, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label long")
    monkeypatch.setattr(pair_trace, "SUPER", 16)
    tasks, pairs = [], pair_trace._pairs
    monkeypatch.setattr(pair_trace, "_pairs", lambda rows, *a: tasks.append(rows.select("block").distinct().count()) or pairs(rows, *a))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for band in (0.4, None):
        got = {(r["kind"], r["left_block"], r["right_block"]): (r["candidates"], r["selected"], r["confident"], r["contribution"]) for r in pair_trace.block_trace(df, "embedding", 1.9, 0.5, band, width=2).collect()}
        want = {}
        for i in range(60):
            for j in range(i + 1, 60):
                if label[i] is None or label[j] is None:
                    d = 2 - 2 * u[i] @ u[j]
                    z = (1.9 - d) / 0.5
                    w = want.setdefault(("uu" if label[i] is None and label[j] is None else "lu", i // 2, j // 2), np.zeros(4))
                    chosen = band is None or abs(d - 1.9) <= band
                    w += [1, chosen, abs(z) > np.log(9), (np.logaddexp(0, z) - z / (1 + np.exp(-z))) * chosen]
        n = sum(w[1] for w in want.values())
        assert set(got) == set(want)
        assert all(np.allclose(got[k], (*w[:3], w[3] / n), atol=1e-12) for k, w in want.items())
    assert tasks == [4, 4]
