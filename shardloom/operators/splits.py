"""Holdouts, folds and what goes with them; class tables are small, row tables are only joined to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import hash_positioned, id_positioned, order_key
from .sampling import class_order, ranked


def _with_parts(df: DataFrame, label: str, parts: DataFrame) -> DataFrame:
    return df.join(parts, label)


def holdout_by_class(df: DataFrame, sample: str, label: str, seed: int, ratio: float = 0.8) -> DataFrame:
    """The first ``int(C * ratio)`` classes in shuffled order train, the others validate."""
    order = class_order(df, label, seed)
    part = F.when(F.col("class_no") <= F.floor(F.col("classes") * F.lit(ratio)), "train").otherwise("valid")
    return _with_parts(df, label, order.select(label, part.alias("part"))).select(sample, label, "part")


def holdout_superclass_balanced(df: DataFrame, sample: str, label: str, superclass: str, seed: int, ratio: float = 0.8) -> DataFrame:
    """``C - int(C ratio)`` validation classes in shuffled order, of which every superclass keeps one class at least."""
    order = class_order(df, label, seed).join(df.select(label, superclass).distinct(), label)
    w = Window.partitionBy(superclass)
    inner = order.withColumns({"_r": F.row_number().over(w.orderBy("class_no")), "_s": F.count(F.lit(1)).over(w)})
    free = inner.where("_r <= _s - 1").withColumn("_k", F.row_number().over(Window.orderBy("class_no")))
    valid = free.where(F.col("_k") <= F.col("classes") - F.floor(F.col("classes") * F.lit(ratio))).select(label, F.lit("valid").alias("part"))
    return df.join(valid, label, "left").select(sample, label, superclass, F.coalesce("part", F.lit("train")).alias("part"))


def post_apportion(tagged: DataFrame, sample: str, label: str, seed: int, ratio: float = 0.2) -> DataFrame:
    """Among the labeled rows' classes, ``clamp(int(C (1 - ratio)), 1, C - 1)`` train; labeled rows of the others
    validate and their unlabeled rows are excluded."""
    order = class_order(tagged.where("pool = 'labeled'"), label, seed)
    n = F.least(F.greatest(F.floor(F.col("classes") * F.lit(1 - ratio)), F.lit(1)), F.col("classes") - 1)
    held = order.where(F.col("class_no") > n).select(label, F.lit(True).alias("_held"))
    part = F.when(F.col("_held").isNull(), F.col("pool")).when(F.col("pool") == "labeled", "valid").otherwise("excluded")
    return tagged.join(held, label, "left").select(sample, label, part.alias("part"))


def kfold(df: DataFrame, sample: str, seed: int, k: int) -> DataFrame:
    """Contiguous blocks of the shuffled rows; the first ``rows mod k`` folds have one more."""
    n = df.count()
    base, more = divmod(n, k)
    i = F.col("_i")
    head = more * (base + 1)
    fold = F.when(i < head, F.floor(i / (base + 1))).otherwise(more + F.floor((i - head) / max(1, base)))
    return hash_positioned(df, order_key(seed, sample), [sample], "_i").select(sample, fold.cast("long").alias("fold"))


def stratified_kfold(df: DataFrame, sample: str, label: str, seed: int, k: int) -> DataFrame:
    """Each class is dealt over the folds by its shuffled rank, without any global order. A class with fewer rows than
    folds is an error."""
    validate_stratified(df, label, k)
    return class_dealt(df, sample, label, seed, k)


def class_dealt(df: DataFrame, sample: str, label: str, seed: int, k: int) -> DataFrame:
    """The folds of ``stratified_kfold`` for classes of any size: one of n rows is in the first n folds alone."""
    return ranked(df, sample, label, seed).select(sample, label, F.pmod(F.col("class_rank") - 1, F.lit(k)).cast("long").alias("fold"))


def group_folds(sizes: list[tuple], k: int) -> dict:
    """Largest group to the lightest fold; ties by group, then by fold."""
    load, out = [0] * k, {}
    for group, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        f = min(range(k), key=lambda i: (load[i], i))
        out[group], load[f] = f, load[f] + n
    return out


def group_kfold(df: DataFrame, sample: str, label: str, k: int) -> DataFrame:
    """Whole classes to folds; the greedy pass runs over the class table on the driver."""
    sizes = [(r[label], r["n"]) for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()]
    if len(sizes) < k:
        raise ValueError("more folds than classes")
    plan = df.sparkSession.createDataFrame(sorted(group_folds(sizes, k).items()), f"{label} {dict(df.dtypes)[label]}, fold long")
    return df.join(plan, label).select(sample, label, "fold")


def leakage_excluded(tagged: DataFrame, folds: DataFrame, sample: str, label: str, grouped: bool) -> DataFrame:
    """Train rows of each fold: labeled rows of other folds and unlabeled rows; grouped folds also lose the unlabeled
    rows of validation classes."""
    every = folds.select("fold").distinct()
    valid = folds.select("fold", F.col(sample).alias("_s"), F.col(label).alias("_l"))
    rows = tagged.crossJoin(F.broadcast(every))  # a row per fold
    out = rows.join(valid, (rows["fold"] == valid["fold"]) & (rows[sample] == valid["_s"]), "left_anti")
    if grouped:
        classes = valid.select("fold", "_l").distinct()
        out = out.join(classes, (out["fold"] == classes["fold"]) & (out[label] == classes["_l"]), "left_anti")
    return out.select("fold", sample, label, "pool")


def dense_relabel(df: DataFrame, sample: str, label: str) -> DataFrame:
    """Classes numbered from 0 by label, through the class table."""
    classes = df.select(label).distinct().withColumn("mapped", (F.row_number().over(Window.orderBy(label)) - 1).cast("long"))
    return df.join(classes, label).select(sample, label, "mapped")


def mapped_or(df: DataFrame, mapper: DataFrame, label: str, absent: int = -1) -> DataFrame:
    """Labels through a mapper (label, mapped); absent ones get ``absent``."""
    return df.join(F.broadcast(mapper), label, "left").withColumn("mapped", F.coalesce("mapped", F.lit(absent)).cast("long"))


def inverse_mapped(preds: DataFrame, mapper: DataFrame, pred: str, label: str) -> DataFrame:
    """Predicted dense classes back to labels by a mapper (label, mapped); a class it does not have is an error."""
    unknown = F.raise_error(F.concat(F.lit("unknown class "), F.coalesce(F.col(pred).cast("string"), F.lit("null"))))
    back = mapper.select(F.col("mapped").alias("_mapped"), F.col(label).alias("_label"), F.lit(True).alias("_known"))
    out = preds.drop(label) if label != pred else preds
    return out.join(back, F.col(pred) == F.col("_mapped"), "left").withColumn(label, F.when(F.col("_known"), F.col("_label")).otherwise(unknown)).drop("_mapped", "_label", "_known")


def remapped(df: DataFrame, kept: DataFrame, sample: str) -> DataFrame:
    """New positions (from 0) of the surviving rows among ``kept``."""
    new = id_positioned(kept.select(sample), sample, "position")
    return df.select(sample).join(new, sample)


def disjoint_violations(df: DataFrame, part: str, label: str) -> DataFrame:
    """Classes that more than one part has; must be empty."""
    return df.groupBy(label).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def small_classes(df: DataFrame, label: str, k: int) -> DataFrame:
    """Classes with fewer rows than folds; must be empty for stratified folds."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < k)


def validate_stratified(df: DataFrame, label: str, k: int) -> None:
    """Raises unless k is at least 2 and every class has a row for each fold."""
    if k < 2:
        raise ValueError(f"{k} folds")
    worst = small_classes(df, label, k).orderBy("n", label).first()
    if worst is not None:
        raise ValueError(f"class {worst[label]} has {worst['n']} rows for {k} folds")


def classes_by_superclass(df: DataFrame, label: str, superclass: str) -> DataFrame:
    """(label, superclass, n) per class; a class of two superclasses, or of none, is an error."""
    low, high = F.min(superclass), F.max(superclass)
    sure = F.when((F.col("_low") == F.col("_high")) & (F.col("_set") == F.col("n")), F.col("_low"))
    bad = F.raise_error(F.concat(F.lit("not one superclass: class "), F.coalesce(F.col(label).cast("string"), F.lit("null"))))
    table = df.groupBy(label).agg(low.alias("_low"), high.alias("_high"), F.count(superclass).alias("_set"), F.count(F.lit(1)).alias("n"))
    return table.select(label, F.coalesce(sure, bad).alias(superclass), "n")
