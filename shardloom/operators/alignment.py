"""Distribution alignment against a running mean of class probabilities over ordered batches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import id_positioned
from ..functions.vectors import doubles, let, total
from .graph import _cut

EPS = 1e-7


def aligned(p: Column, mean: Column, eps: float = EPS) -> Column:
    """``p`` over the running mean, scaled to sum 1; neither divisor is taken below ``eps``."""
    ratio = F.zip_with(p, mean, lambda x, m: x / F.greatest(m, F.lit(eps)))
    return let(ratio, lambda r: let(F.greatest(total(r), F.lit(eps)), lambda s: F.transform(r, lambda x: x / s)))


def running_means(rows: DataFrame, batch: str, p: str, momentum: float) -> DataFrame:
    """(batch, mean): what each batch is divided by, the running mean before it.

    It starts uniform and becomes ``m * mean + (1 - m) * batch mean`` after each batch, in batch order. The fold is cut into
    stretches so long that ``m`` to their length is below 1e-9: within one, sums of ``mean / m^i`` are running sums of
    positive terms, and what three stretches back and earlier left is beyond a double's last digit. So no task sees more
    than a stretch of one class.
    """
    if not 0 <= momentum < 1:
        raise ValueError("momentum must be at least 0 and below 1")
    n = F.count(F.lit(1))
    exploded = rows.select(F.col(batch).alias("batch"), F.size(p).alias("classes"), F.posexplode(doubles(p)).alias("class", "x"))
    means = exploded.groupBy("batch", "class").agg((F.sum("x") / n).alias("x"), F.max("classes").alias("classes"))
    order = id_positioned(rows.select(F.col(batch).alias("batch")).distinct(), "batch", "at")
    means = _cut(means.join(order, "batch"))
    first = 1.0 / F.col("classes")
    if momentum == 0:
        last = Window.partitionBy("class").orderBy("at")
        folded = means.select("batch", "class", F.coalesce(F.lag("x").over(last), first).alias("mean"))
    else:
        length = max(1, math.ceil(math.log(1e-9) / math.log(momentum)))
        m = F.lit(momentum)
        means = means.withColumns({"stretch": F.floor(F.col("at") / length), "i": F.col("at") % length})
        inside = Window.partitionBy("class", "stretch").orderBy("i")
        grown = F.sum((1 - momentum) * F.col("x") * F.pow(m, -F.col("i"))).over(inside) * F.pow(m, F.col("i"))
        local = _cut(means.withColumns({"after": grown, "ends": F.col("i") == length - 1}))
        before = Window.partitionBy("class").orderBy("stretch")
        # a stretch that isn't the last one ends at its last place
        ends = local.where("ends").select("class", (F.col("stretch") + 1).alias("stretch"), "after")
        back = {f"e{k}": F.coalesce(F.lag("after", k).over(before), F.lit(0.0)) for k in (1, 2)}
        carried = ends.withColumns(back).select("class", "stretch", (F.col("after") + F.pow(m, F.lit(length)) * F.col("e1") + F.pow(m, F.lit(2 * length)) * F.col("e2")).alias("carry"))
        here = F.coalesce(F.lag("after").over(inside), F.lit(0.0))
        start = F.coalesce("carry", F.lit(0.0)) + F.when(F.col("stretch") < 4, F.pow(m, F.col("stretch") * length) * first).otherwise(0.0)
        folded = local.join(carried, ["class", "stretch"], "left").select("batch", "class", (here + F.pow(m, F.col("i")) * start).alias("mean"))
    return folded.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("class", "mean"))).alias("_m")).select("batch", F.col("_m.mean").alias("mean"))


def distribution_alignment(rows: DataFrame, batch: str, p: str, momentum: float, eps: float = EPS) -> DataFrame:
    """``rows`` with ``aligned``; batches go by their number, and all rows of a batch are divided by the mean before it."""
    means = running_means(rows, batch, p, momentum).withColumnRenamed("batch", "_batch")
    return rows.join(means, F.col(batch) == F.col("_batch")).withColumn("aligned", aligned(doubles(p), F.col("mean"), eps)).drop("_batch", "mean")
