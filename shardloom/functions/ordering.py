"""Seeded orders that SQL engines agree on: MD5 of seed and id, ties by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def order_key(seed: int, column: Column | str, tag: str = "") -> Column:
    """``md5('seed:tag:value')``: sorting by it is a shuffle that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:{tag}"), F.col(column).cast("string") if isinstance(column, str) else column.cast("string")))


def positioned(df: DataFrame, bucket: Column, order: list, name: str) -> DataFrame:
    """Adds the position (from 0) in a total order without sorting all rows in one task.

    ``bucket`` must not decrease along ``order`` and takes at most some thousand values: rows are ranked in their bucket,
    whose offset comes from the table of bucket sizes.
    """
    marked = df.withColumn("_bucket", bucket)
    sizes = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order)) - 1
    return marked.join(F.broadcast(offsets), "_bucket").withColumn(name, (rank + F.col("_offset")).cast("long")).drop("_bucket", "_offset")


def hash_positioned(df: DataFrame, key: Column, ties: list, name: str) -> DataFrame:
    """Position by an MD5 key, bucketed by its first three digits."""
    return positioned(df.withColumn("_key", key), F.substring("_key", 1, 3), ["_key", *ties], name).drop("_key")


def id_positioned(df: DataFrame, id_col: str, name: str) -> DataFrame:
    """Position by a whole-number id, bucketed by equal ranges of it."""
    r = df.agg(F.min(id_col).alias("a"), F.max(id_col).alias("b")).first()
    low, width = r["a"] or 0, max(1, -(-((r["b"] or 0) - (r["a"] or 0) + 1) // BUCKETS))
    return positioned(df, F.floor((F.col(id_col) - low) / width), [id_col], name)


def group_positioned(df: DataFrame, group: str, key: Column, ties: list, rank: str, size: str) -> DataFrame:
    """Adds the rank (from 1) by an MD5 key within ``group`` and the group's size.

    A group is ranked in 256 parts by the key's first two digits, with offsets from the table of part sizes, so that a
    group with a third of all rows isn't one task's sort.
    """
    marked = df.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, 2))
    sizes = marked.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_g", "_p", before.alias("_offset"), F.sum("_n").over(w).alias(size))
    joined = marked.join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    inner = F.row_number().over(Window.partitionBy(group, "_part").orderBy("_key", *ties))
    return joined.withColumn(rank, (inner + F.col("_offset")).cast("long")).drop("_key", "_part", "_g", "_p", "_offset")


def smaller_counts(counts: DataFrame, value: str, n: str, name: str) -> DataFrame:
    """Adds to a table of distinct numbers how many rows (the sum of ``n``) have a smaller one. Values are summed in at
    most ``BUCKETS`` equal ranges, whose totals alone meet in one task; NaN is the largest, null the least."""
    r = counts.where(~F.isnan(F.col(value).cast("double"))).agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b")).first()
    low, high = r["a"] or 0.0, r["b"] or 0.0
    at = F.floor((F.col(value).cast("double") - low) / (max(high - low, 1e-300) / (BUCKETS - 1)))
    bucket = F.when(F.col(value).isNull(), -1).when(F.isnan(F.col(value).cast("double")), BUCKETS).otherwise(F.least(F.greatest(at, F.lit(0)), F.lit(BUCKETS - 1))).cast("long")
    marked = counts.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy("_bucket").agg(F.sum(n).alias("_t")).select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    inner = F.coalesce(F.sum(n).over(Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = marked.join(totals, F.col("_bucket") == F.col("_b"))
    return joined.withColumn(name, (inner + F.col("_offset")).cast("long")).drop("_bucket", "_b", "_offset")
