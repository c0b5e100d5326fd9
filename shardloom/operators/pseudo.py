"""Pseudo-labels: filtering, rescue, audit, calibration, differences of generations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import smaller_counts


def _keeps(known: Column, threshold: float) -> Column:
    return known & (F.col("confidence").isNull() | (F.col("confidence") >= threshold))


def filter_labels(
    preds: DataFrame, known: DataFrame, threshold: float, required: int | None = None, top_k: int = 1, floor: float = 0.0
) -> DataFrame:
    """(query_id, pred_label, confidence, reason): rows of known classes at the threshold; if fewer than ``required``
    classes are left, the best rows of missing classes above ``floor``, classes by their best confidence."""
    marked = preds.join(known.select(F.col("label").alias("pred_label"), F.lit(True).alias("_known")), "pred_label", "left")
    keep = _keeps(F.col("_known").isNotNull(), threshold)
    cols = ["query_id", "pred_label", "confidence"]
    kept = marked.where(keep).select(*cols, F.lit("threshold").alias("reason"))
    if required is None:
        return kept
    have = kept.select("pred_label").distinct()
    rest = marked.where(F.col("_known").isNotNull() & ~keep & (F.col("confidence") >= floor)).join(have, "pred_label", "left_anti")
    w = Window.partitionBy("pred_label").orderBy(F.desc("confidence"), "query_id")
    best = rest.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top_k)
    classes = rest.groupBy("pred_label").agg(F.max("confidence").alias("_best"))
    order = classes.withColumn("_c", F.row_number().over(Window.orderBy(F.desc("_best"), "pred_label")))
    n = have.agg(F.count(F.lit(1)).alias("_have"))
    admitted = order.crossJoin(F.broadcast(n)).where(F.col("_c") <= F.lit(required) - F.col("_have")).select("pred_label")  # n: one row
    return kept.unionByName(best.join(admitted, "pred_label").select(*cols, F.lit("rescue").alias("reason")))


def audit(preds: DataFrame, truth: DataFrame, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """Predicted, true and correct counts with accuracy, over all (class null) and per true class, in one pass."""
    joined = preds.join(truth.select(F.col(id_col).alias("query_id"), F.col(label).alias("true_label")), "query_id")
    ok = (F.col("pred_label") == F.col("true_label")).cast("int")
    return joined.groupingSets([["true_label"], []], "true_label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ok).cast("long").alias("correct"), F.round(F.avg(ok), 6).alias("accuracy")
    )


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Adds the average rank of ties, through counts per value, summed in ranges of values."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    ranks = smaller_counts(counts, value, "_c", "_below").select(value, (F.col("_below") + (F.col("_c") + 1) / 2).alias("avg_rank"))
    return df.join(ranks, value)


def auc(df: DataFrame, value: str, correct: str) -> DataFrame:
    """Tie-aware area under the curve; null if all or none are correct."""
    r = average_ranks(df, value)
    c = F.col(correct).cast("int")
    s = r.agg(F.sum(F.when(F.col(correct), F.col("avg_rank")).otherwise(0.0)).alias("ranks"), F.sum(c).cast("double").alias("a"), F.sum(1 - c).cast("double").alias("b"))
    value_ = F.when((F.col("a") > 0) & (F.col("b") > 0), (F.col("ranks") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b")))
    return s.select(F.col("a").cast("long").alias("n_correct"), F.col("b").cast("long").alias("n_wrong"), F.round(value_, 6).alias("auc"))


def calibration(df: DataFrame, value: str, correct: str, sample: str, buckets: int = 10) -> DataFrame:
    """Equal-count buckets ``[floor(b n / B), floor((b + 1) n / B))`` of the sorted rows."""
    ids = df.agg(F.min(sample).alias("a"), F.max(sample).alias("b"), F.count(F.lit(1)).alias("n")).first()
    width = max(1, -(-((ids["b"] or 0) - (ids["a"] or 0) + 1) // 256))
    marked = df.select(value, correct, sample, F.floor((F.col(sample) - (ids["a"] or 0)) / width).alias("_part"))
    # offsets of values, and of ranges of ids within a value: a value that a third of the rows have is ranked in parts
    sizes = marked.groupBy(F.col(value).alias("_v"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    earlier = Window.partitionBy("_v").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    values = smaller_counts(sizes.groupBy("_v").agg(F.sum("_c").alias("_t")), "_v", "_t", "_below").select(F.col("_v").alias("_w"), "_below")
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).join(values, F.col("_v") == F.col("_w")).select("_v", "_p", (F.col("_o") + F.col("_below")).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy(value, "_part").orderBy(sample)) - 1
    joined = marked.join(offsets, (F.col(value) == F.col("_v")) & (F.col("_part") == F.col("_p"))).withColumn("_i", rank + F.col("_offset"))
    ranked = joined.select(value, correct, "_i", F.lit(ids["n"]).alias("_n")).withColumn("_b", F.least(F.lit(buckets), F.col("_n")))
    bucket = F.floor(((F.col("_i") + 1) * F.col("_b") - 1) / F.col("_n")).cast("long")
    return ranked.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min(value), 6).alias("min_conf"), F.round(F.max(value), 6).alias("max_conf"),
        F.round(F.avg(value), 6).alias("mean_conf"), F.round(F.avg(F.col(correct).cast("int")), 6).alias("accuracy"),
    )


def generation_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """overlap, changed, changed_fraction, added, removed of two generations (query_id, pred_label)."""
    a, b = old.select("query_id", F.col("pred_label").alias("x")), new.select("query_id", F.col("pred_label").alias("y"))
    j = a.join(b, "query_id", "full_outer")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    s = j.agg(F.count_if(both).alias("overlap"), F.count_if(both & (F.col("x") != F.col("y"))).alias("changed"), F.count_if(F.col("x").isNull()).alias("added"), F.count_if(F.col("y").isNull()).alias("removed"))
    return s.withColumn("changed_fraction", F.round(F.when(F.col("overlap") > 0, F.col("changed") / F.col("overlap")), 6))


def relabeled(labeled: DataFrame, preds: DataFrame, sample: str = "vec_id", label: str = "label") -> DataFrame:
    """True labels with confidence 1 and pseudo-labels with theirs, which must lie in [0, 1]."""
    checked = F.when((F.col("confidence") >= 0) & (F.col("confidence") <= 1), F.col("confidence")).otherwise(F.raise_error(F.lit("confidence outside [0, 1]")).cast("double"))
    true = labeled.select(F.col(sample).alias("sample_id"), F.col(label).cast("long").alias("label"), F.lit(1.0).alias("confidence"), F.lit("true").alias("provenance"))
    made = preds.select(F.col("query_id").alias("sample_id"), F.col("pred_label").cast("long").alias("label"), F.coalesce(checked, F.lit(1.0)).alias("confidence"), F.lit("pseudo").alias("provenance"))
    return true.unionByName(made)
