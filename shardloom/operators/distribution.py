"""Class distributions, split summaries, overlaps and membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import class_list


def class_distribution(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per class and their percentage (of the group ``by``, or of all)."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("sample_count"))
    sums = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    joined = counts.join(sums, list(by)) if by else counts.crossJoin(F.broadcast(sums))  # one row
    return joined.select(*by, label, "sample_count", F.round(100.0 * F.col("sample_count") / F.col("_all"), 6).alias("percentage"))


def gini(counts: DataFrame, by: str, value: str) -> DataFrame:
    """Gini coefficient of ``value`` within ``by``, from ranks in one sort."""
    w = Window.partitionBy(by)
    ranked = counts.select(by, value, F.row_number().over(w.orderBy(value)).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    top = F.sum((2 * F.col("_i") - F.col("_n") - 1) * F.col(value))
    return ranked.groupBy(by).agg((top / (F.max("_n") * F.sum(value))).alias("gini"))


def split_summary(df: DataFrame, split: str, label: str) -> DataFrame:
    """A row per split over its class counts: size, spread, imbalance, rare classes, Gini, entropy, extreme classes."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
    c = F.col("n")
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    totals = counts.groupBy(split).agg(F.sum("n").alias("_all"), F.min("n").alias("_min"), F.max("n").alias("_max"))
    share = c / F.col("_all")
    out = (
        counts.join(totals, split)
        .groupBy(split)
        .agg(
            F.max("_all").alias("num_samples"), F.count(F.lit(1)).alias("num_classes"), F.min("n").alias("min_samples"), F.max("n").alias("max_samples"),
            F.round(F.avg("n"), 6).alias("avg_samples"), q.alias("_q"), F.round(F.stddev_pop("n"), 6).alias("std_samples"),
            F.count_if(c == 1).alias("num_singleton_classes"), F.count_if(c < 2).alias("num_classes_lt_2"), F.count_if(c < 4).alias("num_classes_lt_4"),
            F.sum(-share * F.log2(share)).alias("_h"),
            F.collect_list(F.when(c == F.col("_min"), F.col(label))).alias("_least"), F.collect_list(F.when(c == F.col("_max"), F.col(label))).alias("_most"),
        )
    )
    return out.join(gini(counts, split, "n"), split).select(
        split, "num_samples", "num_classes", "min_samples", "max_samples", "avg_samples",
        F.round(F.col("_q")[0], 6).alias("q25"), F.round(F.col("_q")[1], 6).alias("median"), F.round(F.col("_q")[2], 6).alias("q75"), "std_samples",
        F.round(F.col("max_samples") / F.col("min_samples"), 6).alias("imbalance_ratio"), "num_singleton_classes", "num_classes_lt_2", "num_classes_lt_4",
        F.round("gini", 6).alias("gini"), F.round("_h", 6).alias("entropy_bits"),
        F.round(F.when(F.col("num_classes") == 1, F.lit(1.0)).otherwise(F.col("_h") / F.log2(F.col("num_classes").cast("double"))), 6).alias("normalized_entropy"),
        class_list(F.col("_least")).alias("min_count_classes"), class_list(F.col("_most")).alias("max_count_classes"),
    )


def class_overlap(df: DataFrame, split: str, label: str) -> DataFrame:
    """For each pair of splits: class counts, intersection, union, Jaccard (0 if both are empty) and the common classes."""
    sets = df.select(split, label).distinct()
    sizes = sets.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    a, b = sizes.select(F.col(split).alias("split_a"), F.col("n").alias("num_classes_a")), sizes.select(F.col(split).alias("split_b"), F.col("n").alias("num_classes_b"))
    pairs = a.join(b, F.col("split_a") < F.col("split_b"))
    both = sets.select(F.col(split).alias("split_a"), label).join(sets.select(F.col(split).alias("split_b"), label), label).where("split_a < split_b")
    common = both.groupBy("split_a", "split_b").agg(F.count(F.lit(1)).alias("k"), F.array_join(F.array_sort(F.collect_list(label)).cast("array<string>"), ";").alias("names"))
    k = F.coalesce("k", F.lit(0)).cast("long")
    union = F.col("num_classes_a") + F.col("num_classes_b") - k
    return pairs.join(common, ["split_a", "split_b"], "left").select(
        "split_a", "split_b", "num_classes_a", "num_classes_b", k.alias("num_intersection"), union.alias("num_union"),
        F.round(F.when(union == 0, F.lit(0.0)).otherwise(k / union), 6).alias("jaccard"), F.coalesce("names", F.lit("")).alias("intersection_classes"),
    )


def pairwise_class_sets(sets: DataFrame, key: str, label: str) -> DataFrame:
    """Set comparison of every pair of keys: equality, inclusion, sizes, Jaccard (1 if both are empty), differences."""
    c = sets.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("s"))
    a, b = c.select(F.col(key).alias("left_key"), F.col("s").alias("x")), c.select(F.col(key).alias("right_key"), F.col("s").alias("y"))
    both, either = F.array_intersect("x", "y"), F.array_union("x", "y")
    listed = lambda s: F.array_join(F.array_sort(s).cast("array<string>"), ";")
    return a.join(b, F.col("left_key") < F.col("right_key")).select(
        "left_key", "right_key", (F.size(both) == F.size(either)).alias("same_classes"),
        (F.size(F.array_except("x", "y")) == 0).alias("left_subset"), (F.size(F.array_except("y", "x")) == 0).alias("right_subset"),
        F.size(both).cast("long").alias("num_intersection"), F.size(either).cast("long").alias("num_union"),
        F.round(F.when(F.size(either) == 0, F.lit(1.0)).otherwise(F.size(both) / F.size(either)), 6).alias("jaccard"),
        listed(F.array_except("x", "y")).alias("only_left"), listed(F.array_except("y", "x")).alias("only_right"),
    )


def class_pivot(df: DataFrame, label: str, split: str, splits: list[str]) -> DataFrame:
    """Counts by class and split in columns, 0 where there is none."""
    return df.groupBy(label).pivot(split, splits).agg(F.count(F.lit(1))).na.fill(0, splits)


def membership(df: DataFrame, split: str, sample: str, label: str) -> DataFrame:
    """Positions of samples in the whole and in their split, with dense class numbers of the split (from 0)."""
    w = Window.partitionBy(split)
    return df.select(
        sample, split, label,
        (F.row_number().over(w.orderBy(sample)) - 1).cast("long").alias("position_in_split"),
        (F.dense_rank().over(w.orderBy(label)) - 1).cast("long").alias("mapped_class_label"),
    )


def top_bottom(counts: DataFrame, label: str, value: str, n: int) -> DataFrame:
    """The ``n`` smallest and largest classes, ties by label."""
    low = counts.orderBy(value, label).limit(n).withColumn("side", F.lit("smallest"))
    high = counts.orderBy(F.desc(value), label).limit(n).withColumn("side", F.lit("largest"))
    return low.unionByName(high)


def numeric_summary(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, least, quartiles, mean, largest and population deviation of a column."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    r = lambda c: F.round(c, 6)
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("_lo"), q.alias("_q"), F.max(value).alias("_hi"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return out.select(*by, "n", r("_lo").alias("min"), r(F.col("_q")[0]).alias("p25"), r(F.col("_q")[1]).alias("median"), r(F.col("_q")[2]).alias("p75"), r("_hi").alias("max"), r("_m").alias("mean"), r("_s").alias("std"))
