"""Sinks: CSV and JSONL reports, manifests, Markdown tables, a content-keyed feature cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import id_positioned
from ..functions.text import cell


def csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).csv(path)


def _keys_sorted(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_keys_sorted(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _keys_sorted(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _keys_sorted(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    return value


def jsonl(df: DataFrame, path: str) -> None:
    """One object per line, keys in sorted order at every depth (structs, maps and arrays of them)."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    df.select(*[_keys_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]).write.mode("overwrite").json(path)


def manifest(df: DataFrame, path: str, split: str) -> None:
    """A split's rows as Parquet, a folder per split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def manifest_summary(df: DataFrame, split: str, sample: str, label: str) -> DataFrame:
    """Per split: rows, least and largest id, and a JSON object of label counts with sorted keys."""
    counts = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("_n"), F.min(sample).alias("_low"), F.max(sample).alias("_high"))
    entry = F.struct(F.coalesce(F.col(label).cast("string"), F.lit("null")).alias("key"), F.col("_n").alias("value"))
    return counts.groupBy(split).agg(
        F.sum("_n").alias("n"), F.min("_low").alias("first_id"), F.max("_high").alias("last_id"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("label_counts"),
    )


def split_lists(tagged: DataFrame, part: str, sample: str, outside: tuple[str, ...] = ("valid",)) -> DataFrame:
    """(list, place, value): what reproduces a split, a row an entry, so that lists are as long as they need be.

    Rows outside the training subset (parts ``outside``) give ``<part>_indices``, their sample ids in order. The others, in
    order of their ids, are the training subset: ``train_indices`` are its ids, ``<part>_positions`` the places in it of
    each part's rows, ``<part>_indices`` their ids. ``place`` counts a list's entries from 0.
    """
    out = F.col(part).isin(*outside)
    inside = id_positioned(tagged.where(~out).select(part, sample), sample, "position")
    whole = inside.select(F.lit("train_indices").alias("list"), F.col("position").alias("place"), F.col(sample).alias("value"))
    # a part's places follow from the positions: rows of the part before, by buckets of positions
    ranked = _placed(inside, part, "position")
    own = ranked.select(F.explode(F.array(
        F.struct(F.concat(F.col(part), F.lit("_positions")).alias("list"), "place", F.col("position").cast("long").alias("value")),
        F.struct(F.concat(F.col(part), F.lit("_indices")).alias("list"), "place", F.col(sample).cast("long").alias("value")),
    )).alias("e")).select("e.*")
    other = _placed(tagged.where(out).select(part, sample), part, sample)
    return whole.unionByName(own).unionByName(other.select(F.concat(F.col(part), F.lit("_indices")).alias("list"), "place", F.col(sample).alias("value")))


def _placed(rows: DataFrame, part: str, order: str, stretch: int = 1 << 16) -> DataFrame:
    """``rows`` with their ``place`` (from 0) within ``part`` by the whole number ``order``, ranked by stretches of it."""
    marked = rows.withColumn("_s", F.floor(F.col(order) / stretch))
    sizes = marked.groupBy(part, "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(part, "_s", (F.sum("_n").over(Window.partitionBy(part).orderBy("_s")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(part, "_s").orderBy(order)) - 1
    return marked.join(before, [part, "_s"]).withColumn("place", (inner + F.col("_before")).cast("long")).drop("_s", "_before")


def write_split_lists(lists: DataFrame, path: str) -> None:
    """A folder per list, its entries sorted by place within files of ranges of it."""
    lists.repartitionByRange("list", "place").sortWithinPartitions("list", "place").write.mode("overwrite").partitionBy("list").parquet(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """(line) for each row: cells between pipes, fractions with four decimals."""
    cells = [cell(F.col(f"`{n}`"), t) for n, t in df.dtypes]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def markdown_header(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]


def cached_features(df: DataFrame, content: str, cache_path: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, feature) for all rows: known keys from the cache, the others computed once per content and appended."""
    spark = df.sparkSession
    keyed = df.withColumn("key", F.sha2(F.col(content).cast("string"), 256))
    try:
        known = spark.read.parquet(cache_path)
        misses = keyed.join(known.select("key"), "key", "left_anti")
    except Exception as e:  # no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        misses = keyed
    compute(misses.dropDuplicates(["key"])).select("key", "feature").write.mode("append").parquet(cache_path)
    return keyed.join(spark.read.parquet(cache_path), "key")
