"""Folds of whole groups that also balance classes, and folds of whole classes under superclass limits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import order_key
from .graph import _cut
from .splits import classes_by_superclass

#: Groups that one task places in order.
RUN = 65_536


def stratified_group_folds(df: DataFrame, sample: str, group: str, label: str, seed: int, k: int, run: int = RUN) -> DataFrame:
    """(sample, group, label, fold): a group's rows share a fold, and every class is spread over the folds.

    A group is its vector of class shares (its rows of a class over all rows of the class). Largest groups first, ties in
    seeded order, each goes to the fold whose summed vector has the least dot product with its own; ties go to the fold
    with fewer rows, then the lower one. That adds at most ``|g|^2`` to ``sum |S_f|^2 - |S|^2 / k``, so the squared
    deviation of all folds' shares from ``1 / k`` stays below ``(1 - 1/k) sum |g|^2``.

    Up to ``run`` groups are placed by one task; more are cut into runs of that order, each with folds of its own that
    start empty. The bound then holds for each run. Null groups and null labels count as values.
    """
    if k < 2:
        raise ValueError(f"{k} folds")
    counts = _cut(df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n")))
    totals = counts.groupBy(F.col(label).alias("_l")).agg(F.sum("_n").alias("_all"))
    shares = counts.join(totals, F.col(label).eqNullSafe(F.col("_l")))
    key = F.coalesce(F.col(label).cast("string"), F.lit("null"))
    vectors = _cut(shares.groupBy(group).agg(F.sum("_n").alias("_rows"), F.array_sort(F.collect_list(F.struct(key.alias("c"), (F.col("_n") / F.col("_all")).alias("s")))).alias("_v")))
    groups = vectors.count()
    if groups < k:
        raise ValueError(f"{groups} groups for {k} folds")
    order = [F.desc("_rows"), order_key(seed, F.coalesce(F.col(group).cast("string"), F.lit("null"))), F.col(group)]
    ordered = vectors.repartitionByRange(-(-groups // run), *order).sortWithinPartitions(*order)
    schema = T.StructType([df.schema[group], T.StructField("fold", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, int] = {}
        sums, rows = np.zeros((k, 64)), np.zeros(k, dtype=np.int64)
        for batch in batches:
            folds = []
            for size, vector in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at = [index.setdefault(x["c"], len(index)) for x in vector]
                while len(index) > sums.shape[1]:
                    sums = np.concatenate([sums, np.zeros_like(sums)], axis=1)
                share = np.array([x["s"] for x in vector])
                cost = np.round(sums[:, at] @ share, 12)
                fold = int(np.lexsort((rows, cost))[0])
                sums[fold, at] += share
                rows[fold] += size
                folds.append(fold)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(folds, pa.int64())], names=schema.names)

    plan = _cut(ordered.select(group, "_rows", "_v").mapInArrow(place, schema)).withColumnRenamed(group, "_g")
    return df.join(plan, F.col(group).eqNullSafe(F.col("_g"))).select(sample, group, label, "fold")


def _place_classes(classes: list[tuple], k: int) -> dict | None:
    """Folds of (class, superclass, rows) in the given order, or None at a dead end."""
    quota = [len(classes) // k + (f < len(classes) % k) for f in range(k)]
    size: dict = {}
    for _, s, _ in classes:
        size[s] = size.get(s, 0) + 1
    rows, count, own, out = [0] * k, [0] * k, {}, {}
    for c, s, n in classes:
        free = [f for f in range(k) if count[f] < quota[f] and own.get((f, s), 0) < size[s] - 1]
        if not free:
            return None
        f = min(free, key=lambda f: (rows[f], count[f], f))
        out[c], rows[f], count[f], own[f, s] = f, rows[f] + n, count[f] + 1, own.get((f, s), 0) + 1
    return out


def superclass_group_folds(df: DataFrame, sample: str, label: str, superclass: str, seed: int, k: int, attempts: int = 1000) -> DataFrame:
    """(sample, label, superclass, fold): whole classes to validation folds, so that every fold's training part keeps a
    class of every superclass.

    Folds have quotas of classes that differ by one at most; of a superclass with n classes a fold takes n - 1 at most;
    among the folds that may take a class, the one with the fewest rows gets it, then the one with the fewest classes.
    Classes go largest first, ties in seeded order; where that ends with a class that no fold may take, all are placed
    anew in other seeded orders, up to ``attempts`` times. The class table (a row a class) is placed on the driver.
    """
    if k < 2:
        raise ValueError(f"{k} folds")
    table = [(r[label], r[superclass], r["n"]) for r in classes_by_superclass(df, label, superclass).collect()]
    if k > len(table):
        raise ValueError(f"{len(table)} classes for {k} folds")
    per = [s for _, s, _ in table]
    if lone := sorted({s for s in per if per.count(s) < 2}):
        raise ValueError(f"superclasses of one class: {lone[:10]}")
    shuffled = lambda c, t: hashlib.md5(f"{seed}:{f'{t}:' if t else ''}{c}".encode()).hexdigest()
    plan = _place_classes(sorted(table, key=lambda r: (-r[2], shuffled(r[0], 0), r[0])), k)
    for t in range(1, attempts):
        if plan is not None:
            break
        plan = _place_classes(sorted(table, key=lambda r: (shuffled(r[0], t), r[0])), k)
    if plan is None:
        raise ValueError(f"no folds in {attempts} attempts")
    folds = df.sparkSession.createDataFrame(sorted(plan.items()), T.StructType([df.schema[label], T.StructField("fold", T.LongType())]))
    return df.join(folds, label).select(sample, label, superclass, "fold")
