"""Hand-computed cases and invariants."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from shardloom.functions import text, vectors
from shardloom.operators import batches, distribution, graph, propagation, pseudo, sampling, splits, trials, views
from shardloom.operators.knn import knn, majority_vote
from shardloom.sources import parsers, sinks
from shardloom.streaming import metrics


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_budget_rounding(spark):
    df = frame(spark, [(i, 0) for i in range(5)] + [(10 + i, 1) for i in range(3)], "s long, l long")
    n = {r["l"]: r["n"] for r in sampling.per_class_min(df, "s", "l", 1, fraction=0.5).where("pool = 'labeled'").groupBy("l").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 2, 1: 2}  # 2.5 and 1.5, half to even
    n = sampling.per_class_min(df, "s", "l", 1, k=4).where("pool = 'labeled' and l = 1").count()
    assert n == 3
    assert sampling.global_budget(df, "s", "l", 1, 0.1).where("pool = 'labeled'").count() == 1


def test_imbalanced_bounds(spark):
    df = frame(spark, [(i, i % 4) for i in range(200)], "s long, l long")
    n = [r["n"] for r in sampling.per_class_imbalanced(df, "s", "l", 3, 0.2).where("pool = 'labeled'").groupBy("l").agg(F.count("*").alias("n")).collect()]
    assert sum(n) == 40 and all(5 <= x <= 20 for x in n)
    sizes = {0: 3, 1: 40, 2: 200, 3: 11, 4: 90, 5: 1}
    df = frame(spark, [(l * 1000 + i, l) for l, k in sizes.items() for i in range(k)], "s long, l long")
    for seed in range(4):
        takes = {r["l"]: r["take"] for r in sampling.imbalanced_counts(df, "l", seed, 0.2).collect()}
        even = {l: max(1, round(k * 0.2)) for l, k in sizes.items()}
        assert sum(takes.values()) == sum(even.values()) and len(set(takes.values())) > 2
        assert all(max(1, b // 2) <= takes[l] <= min(sizes[l], 2 * b) for l, b in even.items()), takes


def test_full_rounds(spark):
    sizes = [1, 4, 4, 9, 300]
    df = frame(spark, [(k, n) for k, n in enumerate(sizes)], "l long, n long")
    for budget in (0, 1, 4, 5, 6, 17, 18, 200, 318, 400):
        whole, taken = sampling.full_rounds(df, "n", budget)
        want = max(r for r in range(301) if sum(min(n, r) for n in sizes) <= budget)
        assert (whole, taken) == (want, sum(min(n, want) for n in sizes))


def test_smaller_counts(spark):
    from shardloom.functions.ordering import smaller_counts

    rng = np.random.default_rng(0)
    values = np.unique(np.concatenate([rng.normal(size=300) ** 5, [0.0, 1.0]])).tolist()
    df = frame(spark, [(v, k % 4 + 1) for k, v in enumerate(values)] + [(None, 2), (float("nan"), 3)], "v double, n long")
    got = {r["v"]: r["below"] for r in smaller_counts(df, "v", "n", "below").collect() if r["v"] == r["v"]}
    assert [got[v] for v in values] == [2 + sum(j % 4 + 1 for j in range(k)) for k in range(len(values))] and got[None] == 0
    assert smaller_counts(df.where("false"), "v", "n", "below").count() == 0


def test_top_k_with_ties():
    from shardloom.operators import knn as m

    rng = np.random.default_rng(1)
    y = rng.integers(-2, 3, (500, 3)).astype(float)
    ids = np.arange(500) * 3
    was, m.STEP_REFS, m.STEP_QUERIES = (m.STEP_REFS, m.STEP_QUERIES), 64, 50
    try:
        score, near = m.top_k(y, y, ids, ids, 7, "dot", True)
    finally:
        m.STEP_REFS, m.STEP_QUERIES = was
    s = y @ y.T
    np.fill_diagonal(s, -np.inf)
    assert (near == ids[np.argsort(-s, axis=1, kind="stable")[:, :7]]).all() and (score == -np.sort(-s, axis=1)[:, :7]).all()


def test_long_tail(spark):
    df = frame(spark, [(i, i % 3) for i in range(300)], "s long, l long")
    assert [r["target"] for r in sampling.long_tail_counts(df, "l", 0.01).orderBy("l").collect()] == [100, 10, 1]


def test_gini_and_entropy(spark):
    df = frame(spark, [("a", i) for i in range(4)] + [("b", 0)] + [("b", 1)] * 3 + [("c", 5)] * 2, "split string, label long")
    got = {r["split"]: r for r in distribution.split_summary(df, "split", "label").collect()}
    assert got["a"]["gini"] == 0 and got["a"]["entropy_bits"] == 2 and got["a"]["normalized_entropy"] == 1
    assert got["b"]["gini"] == 0.25 and got["c"]["normalized_entropy"] == 1.0 and got["c"]["num_singleton_classes"] == 0


def test_group_folds():
    plan = splits.group_folds([(1, 5), (2, 5), (3, 4), (4, 3), (5, 3)], 2)
    assert set(plan) == {1, 2, 3, 4, 5} and set(plan.values()) == {0, 1}
    assert plan[1] == 0 and plan[2] == 1 and plan[3] == 0


def test_superclass_folds(spark):
    df = frame(spark, [(c * 10 + i, c, c // 3) for c in range(9) for i in range(4)], "s long, l long, g long")
    from shardloom.operators import folds

    got = folds.superclass_group_folds(df, "s", "l", "g", 1, 3).toPandas()
    assert (got.groupby("l").fold.nunique() == 1).all() and (got.groupby("fold").l.nunique() == 3).all()
    assert (got.groupby(["fold", "g"]).l.nunique() <= 2).all()


def test_average_rank_and_auc(spark):
    df = frame(spark, [(0.9, True), (0.5, True), (0.5, False)], "c double, ok boolean")
    assert pseudo.auc(df, "c", "ok").first()["auc"] == 0.75
    assert pseudo.auc(df.where("ok"), "c", "ok").first()["auc"] is None


def test_vote_tie(spark):
    near = frame(spark, [(0, i, 0.5, i) for i in (1, 2, 3, 4)], "query_id long, ref_id long, score double, rank long")
    labels = frame(spark, [(1, 3), (2, 1), (3, 3), (4, 1)], "vec_id long, label long")
    r = majority_vote(near, labels).first()
    assert (r["pred_label"], r["votes"], r["confidence"]) == (1, 2, 0.5)


def test_knn_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    import shardloom.operators.knn as m

    was, m.BLOCK_BYTES = m.BLOCK_BYTES, 16 * 8 * 5
    try:
        got = knn(df, df, "embedding", 3).toPandas()
    finally:
        m.BLOCK_BYTES = was
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for q, part in got.groupby("query_id"):
        assert part.sort_values("rank").ref_id.tolist() == np.argsort(-s[q], kind="stable")[:3].tolist()


def test_affinity_and_components(spark):
    near = frame(spark, [(0, 1, 0.5, 1), (1, 0, 0.5, 1), (2, 3, -0.2, 1), (3, 2, -0.2, 1)], "query_id long, ref_id long, score double, rank long")
    assert sorted((r["src"], r["dst"], r["w"]) for r in graph.mixed_affinity(near).collect()) == [(0, 1, 1.0), (1, 0, 1.0)]
    nodes = frame(spark, [(i,) for i in range(4)], "n long")
    got = {r["node"]: r["component"] for r in graph.components(graph.mixed_affinity(near), nodes, "n").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_vector_functions(spark):
    df = frame(spark, [([0.5, 0.5],), ([1.0, 0.0],)], "p array<double>")
    assert [round(r[0], 9) for r in df.select(vectors.entropy_confidence(F.col("p"))).collect()] == [0.0, 1.0]
    assert [r[0] for r in df.select(vectors.argmax(F.col("p"))).collect()] == [0, 0]
    assert df.select(vectors.unit(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]


def test_spreading_matches_dense(spark):
    rng = np.random.default_rng(1)
    w = np.triu(rng.random((8, 8)) * (rng.random((8, 8)) < 0.6), 1)
    w = w + w.T + np.diag(np.zeros(8))
    edges = frame(spark, [(int(i), int(j), float(w[i, j])) for i in range(8) for j in range(8) if w[i, j] > 0], "src long, dst long, w double")
    seeds = frame(spark, [(0, 0, 1.0), (1, 1, 1.0)], "node long, class long, y double")
    d = w.sum(1)
    s = w / np.sqrt(np.where(d == 0, 1, np.outer(d, d)))
    y = np.zeros((8, 2))
    y[0, 0] = y[1, 1] = 1
    want = np.linalg.solve(np.eye(8) - 0.2 * s, 0.8 * y)
    for r in propagation.spread(edges, seeds, 0.2, 20).collect():
        assert abs(want[r["node"], r["class"]] - r["score"]) < 1e-9


def test_early_stopping(spark):
    log = frame(spark, [("r", e, v) for e, v in enumerate([0.5, 0.6, 0.6, 0.6, 0.6], -1)], "run string, epoch long, v double")
    r = trials.early_stopping(log, "run", "epoch", "v", 3).first()
    assert (r["selected_epoch"], r["stop_epoch"]) == (0, 3)


def test_grid_and_epoch_plan(spark):
    one = frame(spark, [("a", 1, 0.5)], "k string, seed long, m double")
    assert trials.grid_aggregate(one, ["k"], "seed", ["m"]).first()["m_std"] == 0.0
    plan = trials.epoch_plan(frame(spark, [(1, 1, 9), (1, 2, 9)], "t long, s long, l long"), "t", "s", "l").first()
    assert (plan["mean_epochs"], plan["final_epochs"]) == (2.5, 3)


def test_epoch_length():
    assert views.epoch_length(None, 78, 16) == 80 and views.epoch_length(100, 0, 16) == 96


def test_sources_and_sinks(spark, tmp_path):
    lines = frame(spark, [("1 a b",), ("",), ("2 c",), ("2 d",)], "value string")
    got = sorted((r["id"], r["rest"], r["copies"]) for r in parsers.indexed_text(lines).collect())
    assert got == [(1, "a b", 1), (2, "c", 2), (2, "d", 2)]
    with pytest.raises(Exception, match="unknown status"):
        parsers.partition_list(frame(spark, [("a b nowhere",)], "value string")).collect()
    path = tmp_path / "t.jsonl"
    path.write_text("".join(json.dumps(x) + "\n" for x in [{"number": 1, "state": "COMPLETE", "value": 0.5, "params": {"a": "1"}}, {"number": 2, "state": "FAIL"}]))
    assert [r["number"] for r in parsers.trials_jsonl(spark, str(path)).collect()] == [1]
    df = frame(spark, [(1, "a|b", 0.5), (2, None, None)], "i long, s string, f double")
    assert sorted(r[0] for r in sinks.markdown_rows(df).collect()) == ["| 1 | a\\|b | 0.5000 |", "| 2 |  |  |"]
    sinks.csv(df, str(tmp_path / "c"), ["i"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.manifest(df, str(tmp_path / "m"), "i")
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_feature_cache(spark, tmp_path):
    df = frame(spark, [(1, "a"), (2, "b"), (3, "a")], "i long, t string")
    calls = []

    def compute(d):
        calls.append(d.count())
        return d.select("key", F.length("t").alias("feature"))

    assert sinks.cached_features(df, "t", str(tmp_path / "cache"), compute).count() == 3
    assert sinks.cached_features(df, "t", str(tmp_path / "cache"), compute).count() == 3
    assert calls == [2, 0]


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.JPG").write_bytes(b"1")
    (tmp_path / "d" / "y.txt").write_bytes(b"1")
    assert parsers.files(spark, str(tmp_path), [".jpg"]).count() == 1


def test_text(spark):
    df = frame(spark, [("CompCars/image/78/1/2014/a.jpg",)], "p string")
    assert df.select(text.group_key(F.col("p"), ["compcars", "image"])).first()[0] == "78/1"
    assert df.select(text.first_token(F.lit("12 b/x.JPG c.png"), [".jpg", ".png"])).first()[0] == "b/x.JPG"
    assert df.select(text.slug(F.lit(" A--b C! "))).first()[0] == "a_b_c"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    frame(spark, [("r", 0, 0.5), ("r", 1, 0.4), ("r", 2, 0.3), ("s", 0, 0.1)], "run string, epoch long, v double").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("run string, epoch long, v double").parquet(str(src))
    q = metrics.early_stopping(stream, "run", "epoch", "v", 2).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["run"], r["epoch"], r["best"], r["stopped"]) for r in spark.table("stops").collect())
    assert got == [("r", 0, 0.5, False), ("r", 1, 0.5, False), ("r", 2, 0.5, True), ("s", 0, 0.1, False)]


def test_config(tmp_path):
    from shardloom.plans import config

    made, extra = config.load(config.LabelConfig, {"mode": "class_subset_k_shot", "k": 3})
    assert made.k == 3 and not extra
    with pytest.raises(ValueError, match="unknown keys: nope"):
        config.load(config.LabelConfig, {"nope": 1})
    assert config.load(config.LabelConfig, {"nope": 1}, lenient=True)[1] == ["nope"]
    for bad in ({"mode": "x"}, {"fraction": 0}, {"mode": "class_subset_k_shot"}, {"threshold": 2}, {"validation_mode": "x"}, {"k": 0}):
        with pytest.raises(ValueError):
            config.load(config.LabelConfig, bad)
    assert config.canonical_name("cars 196", {"Cars-196": "Cars196"}) == "Cars196"
    with pytest.raises(ValueError):
        config.canonical_name("x", {"a": "A"})
    config.fraction_protocol(0.5, 0.5)
    with pytest.raises(ValueError):
        config.fraction_protocol(0.6, 0.5)
    assert config.space({"type": "int", "low": 1, "high": 3})
    for bad in ({"type": "categorical"}, {"type": "float", "low": 2, "high": 1}, {"type": "float", "low": 0, "high": 1, "log": True}, {"type": "x"}):
        with pytest.raises(ValueError):
            config.space(bad)


def test_ready(spark, sf_dir):
    from shardloom.plans import config

    assert config.ready(spark, sf_dir, ["nation", "nowhere"]) == ["nowhere"]


def test_two_stream(spark):
    from shardloom.operators import batches

    df = frame(spark, [(i, i % 6) for i in range(90)], "s long, l long")
    got = batches.two_stream(df.where("s < 60"), df.where("s >= 60"), "s", "l", 1, 3, 8, 4, 4).toPandas()
    assert len(got) == 36 and (got.groupby("batch").slot.nunique() == 12).all()
    assert (got[got.stream == "pseudo"].slot < 8).all() and (got[got.stream == "true"].slot >= 8).all()
    assert (got[got.stream == "pseudo"].groupby(["batch", "l"]).size() == 4).all()


def test_positions(spark):
    from shardloom.functions import ordering

    rows = [(i * 7 % 500, i % 3 if i % 11 else None) for i in range(500)]
    df = frame(spark, rows, "s long, l long").repartition(4)
    got = ordering.id_positioned(df, "s", "p").toPandas()
    assert (got.sort_values("s").p.to_numpy() == np.arange(500)).all()
    key = ordering.order_key(5, "s")
    got = ordering.hash_positioned(df, key, ["s"], "p").toPandas()
    import hashlib

    want = sorted(range(500), key=lambda s: (hashlib.md5(f"5:{s}".encode()).hexdigest(), s))
    assert got.sort_values("p").s.tolist() == want
    got = ordering.group_positioned(df, "l", key, ["s"], "r", "n").toPandas()
    assert len(got) == 500
    for label in (0, 1, 2, None):
        part = got[got.l.isna()] if label is None else got[got.l == label]
        assert sorted(part.r) == list(range(1, len(part) + 1)) and (part.n == len(part)).all()
        assert part.sort_values("r").s.tolist() == [s for s in want if s in set(part.s)]
    assert ordering.id_positioned(df.limit(0), "s", "p").count() == 0


def test_relaxed_contrastive_by_batches(spark, sf_dir):
    from shardloom.plans import catalogue

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n, d = len(x), 2 - 2 * x @ x.T
    batch = np.array([r["vec_id"] // 256 for r in rows])
    s = x @ x.T
    np.fill_diagonal(s, 9)
    near = np.argsort(-s, axis=1, kind="stable")[:, :6]
    lists = np.zeros((n, n))
    np.put_along_axis(lists, near, 1, axis=1)
    v = lists * lists.T
    c = v * (v @ v.T) / v.sum(axis=1, keepdims=True)
    ctx = c[near[:, :3]].sum(axis=1) / 3
    ctx = (ctx + ctx.T) / 2
    off = (batch[:, None] == batch[None, :]) & ~np.eye(n, dtype=bool)
    root = np.sqrt(np.maximum(d, 0))
    r = root / (root.sum(axis=1, where=off) / off.sum(axis=1))[:, None]
    w = (np.exp(-d) + ctx) / 2
    want = (w * r**2 + (1 - w) * np.maximum(1 - r, 0) ** 2)[off].mean()
    assert abs(catalogue.queries()["relaxed_contrastive"](spark, sf_dir).first()["loss"] - want) < 2e-6


def test_validation_modes(spark):
    from shardloom.plans import config

    rng = np.random.default_rng(2)
    rows = [(i, i % 5, (np.eye(8)[i % 5] + rng.normal(scale=0.05, size=8)).tolist()) for i in range(100)]
    df = frame(spark, rows, "vec_id long, label long, embedding array<double>")
    more = frame(spark, [(1000 + i, i % 10) for i in range(200)], "vec_id long, label long")
    build = lambda mode, valid: config.build_sets(df, config.LabelConfig(k=4, seed=7, validation_mode=mode), valid=valid)
    plain, given = (x.toPandas() for x in build("all", more))
    assert len(plain) == 100 and len(given) == 200
    train, valid = (x.toPandas() for x in build("match_train", more))
    assert len(train) == 100 and len(valid) == 20 and (valid.groupby("label").size() == 4).all() and valid.label.nunique() == 5
    train, valid = (x.toPandas() for x in build("split_after_apportion", None))
    assert len(valid) == 4 and valid.label.nunique() == 1  # the labelled rows of one class of five
    held = valid.label.iloc[0]
    assert (train.provenance == "true").sum() == 16 and held not in set(train.label)
    assert set(train.sample_id) == {i for i in range(100) if i % 5 != held}
    small = config.build_training_set(df, config.LabelConfig(k=4, seed=7, validation_mode="split_after_apportion"))
    assert small.count() == 80
    for mode, rows in (("match_train", None), ("split_after_apportion", more)):
        with pytest.raises(ValueError, match="validation rows"):
            build(mode, rows)


def test_running_fold_mean_skips_missing_values(spark):
    df = frame(spark, [("a", 0, None), ("a", 1, 2.0), ("a", 2, None), ("a", 3, 4.0), ("b", 0, None)], "run string, fold long, m double")
    got = {(r["run"], r["fold"]): r["running_mean"] for r in trials.running_fold_mean(df, ["run"], "fold", "m").collect()}
    assert got == {("a", 1): 2.0, ("a", 2): 2.0, ("a", 3): 3.0}


def test_times_of_open_trials_are_null(spark):
    df = spark.sql("select 1 as n, timestamp_ntz'2024-01-01 00:00:00.25' as a, timestamp_ntz'2024-01-01 00:01:00.5' as b union all select 2, timestamp_ntz'2024-01-01 00:00:00', null")
    got = {r["n"]: r for r in trials.trial_times(df, "a", "b").collect()}
    assert got[1]["datetime_start"] == "2024-01-01T00:00:00.250000" and got[1]["duration_seconds"] == 60.25 and got[1]["stamp"] == "20240101-000000"
    assert got[2]["datetime_complete"] is None and got[2]["duration_seconds"] is None


def test_fold_and_superclass_checks_raise(spark):
    df = frame(spark, [(0, 1, 7), (1, 1, 7), (2, 2, 8), (3, None, None)], "s long, l long, p long")
    assert {(r["l"], r["n"]) for r in splits.small_classes(df, "l", 2).collect()} == {(2, 1), (None, 1)}
    splits.validate_stratified(df.where("l = 1"), "l", 2)
    splits.validate_stratified(df.limit(0), "l", 2)
    for bad, k in ((df, 2), (df.where("l = 1"), 1)):
        with pytest.raises(ValueError):
            splits.validate_stratified(bad, "l", k)
    assert [tuple(r) for r in splits.classes_by_superclass(df.where("l = 1"), "l", "p").collect()] == [(1, 7, 2)]
    for rows in ([(1, 7), (1, 8)], [(1, 7), (1, None)], [(None, None)]):
        with pytest.raises(Exception, match="not one superclass"):
            splits.classes_by_superclass(frame(spark, rows, "l long, p long"), "l", "p").collect()


def test_inverse_map_knows_every_prediction(spark):
    mapper = frame(spark, [(10, 0), (None, 1)], "label long, mapped long")
    preds = frame(spark, [(1, 0), (2, 1)], "s long, pred long")
    assert {(r["s"], r["label"]) for r in splits.inverse_mapped(preds, mapper, "pred", "label").collect()} == {(1, 10), (2, None)}
    for unknown in (2, None):
        with pytest.raises(Exception, match="unknown class"):
            splits.inverse_mapped(frame(spark, [(1, unknown)], "s long, pred long"), mapper, "pred", "label").collect()


def test_shares_need_mass(spark):
    schema = "node long, class long, score double"
    got = {(r["node"], r["class"]): r["share"] for r in propagation.class_shares(frame(spark, [(1, 0, 3.0), (1, 1, 1.0), (1, 2, -1e-13)], schema)).collect()}
    assert got == {(1, 0): 0.75, (1, 1): 0.25, (1, 2): 0.0}
    for rows in ([(1, 0, 0.0)], [(1, 0, -1.0)], [(1, 0, None)], [(1, 0, float("nan"))], [(1, 0, float("inf"))]):
        with pytest.raises(Exception, match="node 1"):
            propagation.class_shares(frame(spark, rows, schema)).collect()
    v = frame(spark, [([3.0, -1.0],)], "v array<double>")
    assert v.select(vectors.l1_unit(F.col("v"))).first()[0] == [0.75, -0.25]
    with pytest.raises(Exception, match="without mass"):
        frame(spark, [([0.0],)], "v array<double>").select(vectors.l1_unit(F.col("v"))).collect()


def test_k_shot_choices_must_leave_one(spark):
    df = frame(spark, [("8:2", 8, 2), ("8:4", 8, 4)], "choice string, batch long, m long")
    assert [r["choice"] for r in batches.k_shot_choices(df, 3).collect()] == ["8:2"]
    with pytest.raises(ValueError):
        batches.k_shot_choices(df, 1)


def test_json_keys_are_sorted_at_every_depth(spark, tmp_path):
    df = spark.sql("select 1 as z, named_struct('d', 1, 'c', array(named_struct('y', 2, 'x', 3))) as a, map('q', 1, 'b', 2) as m, cast(null as struct<b: int, a: int>) as n")
    sinks.jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":{"c":[{"x":3,"y":2}],"d":1},"m":{"b":2,"q":1},"z":1}'


def test_manifest_summary_counts_labels(spark):
    df = frame(spark, [("a", 1, 0), ("a", 2, 0), ("a", 3, None), ("b", 4, 1)], "split string, s long, l long")
    got = {r["split"]: tuple(r)[1:] for r in sinks.manifest_summary(df, "split", "s", "l").collect()}
    assert got == {"a": (3, 1, 3, '{"0":2,"null":1}'), "b": (1, 4, 4, '{"1":1}')}


def test_class_pairs_by_parts(spark, monkeypatch):
    """Parts of a class give every ordered pair once, spread over tasks; a pair that neighbours share has both weights."""
    from shardloom.operators import graph

    monkeypatch.setattr(graph, "PART", 4)
    rows = [(i, None if i % 11 == 0 else 0 if i < 40 else i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, c int")
    want = {(i, j) for i, a in rows for j, b in rows if i != j and a is not None and a == b}
    made = graph.supervised_graph(df, "id", "c")
    got = made.collect()
    assert len(got) == len(want) and {(r["src"], r["dst"]) for r in got} == want and all(abs(r["w"] * len(want) - 1) < 1e-12 for r in got)
    largest = made.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < len(want) / 4  # one class has most of the pairs
    near = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.5), (1, 3, 0.4), (50, 11, 0.3), (4, 41, 0.1)], "query_id long, ref_id long, score double")
    both = {(r["src"], r["dst"]): r["w"] for r in graph.supervised_knn_graph(near, 2, df, "id", "c").collect()}
    plain = {(r["src"], r["dst"]): r["w"] for r in graph.weighted_knn_graph(near, 2, made).collect()}
    assert set(both) == set(plain) and all(abs(both[k] - plain[k]) < 1e-12 for k in both)
    assert graph.supervised_knn_graph(near, 2, df, "id", "c").count() == len(plain)
    assert not graph.supervised_graph(df.where("id < 1"), "id", "c").count()


def test_components_make_their_edges_once(spark):
    """A path takes several rounds; the edge table is computed in the first only."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    path = frame(spark, [(i, i + 1) for i in range(12)] + [(i + 1, i) for i in range(12)], "src long, dst long").mapInArrow(count, "src long, dst long")
    got = graph.components(path, frame(spark, [(i,) for i in range(13)], "n long"), "n")
    assert {r["component"] for r in got.collect()} == {0} and made.value == 24
