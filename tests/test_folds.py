"""Folds of groups: deviation bound, quotas and limits, dead ends."""

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
from shardloom.operators import folds, propagation, splits
from shardloom.plans import catalogue
from twins import connect, differences


def table(spark, rng, n_groups, n_classes):
    rows = []
    for g in range(n_groups):
        for c in rng.choice(n_classes, rng.integers(1, 4)):
            rows += [(g, int(c))] * int(rng.integers(1, 30) ** (2 if g == 0 else 1))
    return spark.createDataFrame([(i, g, c) for i, (g, c) in enumerate(rows)], "s long, g long, c long")


def deviations(got: pd.DataFrame, k: int) -> tuple[float, float]:
    """Squared deviation of folds' class shares from 1/k, and the bound of the greedy rule."""
    share = got.groupby(["g", "c"]).size().unstack(fill_value=0)
    share = share / share.sum()
    by_fold = share.groupby(got.drop_duplicates("g").set_index("g").fold.reindex(share.index)).sum().reindex(range(k), fill_value=0)
    return float(((by_fold - 1 / k) ** 2).to_numpy().sum()), float((1 - 1 / k) * (share**2).to_numpy().sum())


@pytest.mark.parametrize("seed", [1, 2])
def test_stratified_groups_keep_the_bound(spark, seed):
    df = table(spark, np.random.default_rng(seed), 80, 7)
    got = folds.stratified_group_folds(df, "s", "g", "c", 3, 4).toPandas()
    assert len(got) == df.count() and (got.groupby("g").fold.nunique() == 1).all() and set(got.fold) == {0, 1, 2, 3}
    off, bound = deviations(got, 4)
    assert off <= bound + 1e-9
    again = folds.stratified_group_folds(df.repartition(5), "s", "g", "c", 3, 4).toPandas()
    assert got.sort_values("s").fold.tolist() == again.sort_values("s").fold.tolist()


def test_runs_of_groups_and_nulls(spark):
    df = table(spark, np.random.default_rng(3), 300, 3)
    got = folds.stratified_group_folds(df, "s", "g", "c", 3, 3, run=50).toPandas()
    assert len(got) == df.count() and (got.groupby("g").fold.nunique() == 1).all()
    shares = got.groupby("c").fold.value_counts(normalize=True)
    assert (shares - 1 / 3).abs().max() < 0.15  # one group holds a fifth of a class
    odd = spark.createDataFrame([(1, None, 1), (2, None, None), (3, 5, None), (4, 6, 1)], "s long, g long, c long")
    got = folds.stratified_group_folds(odd, "s", "g", "c", 3, 2).toPandas()
    assert len(got) == 4 and got[got.g.isna()].fold.nunique() == 1
    for k in (1, 4):
        with pytest.raises(ValueError):
            folds.stratified_group_folds(odd, "s", "g", "c", 3, k)


def test_superclass_folds_keep_quotas_and_limits(spark):
    rng = np.random.default_rng(5)
    rows = [(c * 1000 + i, c, c % 5) for c in range(23) for i in range(int(rng.integers(5, 60)))]
    df = spark.createDataFrame(rows, "s long, l long, g long")
    got = folds.superclass_group_folds(df, "s", "l", "g", 9, 4).toPandas()
    classes = got.drop_duplicates("l")
    assert len(got) == len(rows) and (got.groupby("l").fold.nunique() == 1).all()
    assert sorted(classes.groupby("fold").size()) == [5, 6, 6, 6]
    per = classes.groupby(["fold", "g"]).size()
    limit = classes.groupby("g").size() - 1
    assert all(n <= limit[g] for (_, g), n in per.items())
    held = got.groupby("fold").size()
    assert held.max() - held.min() <= got.groupby("l").size().max()


def test_superclass_folds_start_anew_at_dead_ends(spark):
    # largest first, the last class of superclass 1 finds room in one fold alone, which has its other class already
    classes = [("a", 0, 9), ("b", 0, 8), ("c", 1, 2), ("d", 1, 1)]
    assert folds._place_classes([("c", 1, 1), ("a", 0, 9), ("b", 0, 9), ("d", 1, 1)], 2) is not None
    dead = [("a", 0, 5), ("b", 0, 4), ("x", 2, 3), ("c", 1, 2), ("y", 2, 2), ("d", 1, 1)]
    orders = [folds._place_classes([dead[i] for i in o], 2) for o in ((0, 1, 2, 3, 4, 5), (0, 3, 1, 5, 2, 4))]
    assert any(p is not None for p in orders)
    rows = [(i * 10 + j, c, g) for i, (c, g, n) in enumerate(classes) for j in range(n)]
    got = folds.superclass_group_folds(spark.createDataFrame(rows, "s long, l string, g long"), "s", "l", "g", 1, 2).toPandas()
    assert (got.drop_duplicates("l").groupby(["fold", "g"]).size() == 1).all()
    with pytest.raises(ValueError, match="one class"):
        folds.superclass_group_folds(spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 2)], "s long, l long, g long"), "s", "l", "g", 1, 2)


def test_preconditions_in_the_paths_users_take(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "s long, l long")
    with pytest.raises(ValueError, match="class 2 has 1 rows"):
        splits.stratified_kfold(df, "s", "l", 1, 2)
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0), (3, 2, 1.0)], "src long, dst long, w double")
    seeds = spark.createDataFrame([(0, 0, 1.0)], "node long, class long, y double")
    scores = propagation.spread(edges, seeds)
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    assert propagation.decided(scores, nodes.where("node < 2")).count() == 2
    with pytest.raises(Exception, match="no mass"):
        propagation.decided(scores, nodes).collect()


def test_label_sets_are_of_all_classes(spark, tmp_path):
    """Nations of 1 to 9 customers, a null one too: what folds train on, counted by hand."""
    rows = [(100 * n + i, None if n == 8 else n, "ONE SEGMENT") for n in range(9) for i in range(n + 1)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey int, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = catalogue.queries()["fold_label_sets"](spark, str(tmp_path)).toPandas()
    fold = [(n, i % 5) for n in range(9) for i in range(n + 1)]
    want = {(k, len({n for n, f in fold if f != k and n < 8}), sum(f != k for _, f in fold)) for k in range(5)}
    assert set(got[["fold", "classes", "rows"]].itertuples(index=False, name=None)) == want
    assert not differences(got, connect(str(tmp_path)).sql(catalogue.oracles()["fold_label_sets"]).df())
