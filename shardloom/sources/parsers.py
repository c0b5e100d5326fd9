"""Text formats as tables, with the checks their readers make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_token


def files(spark, path: str, suffixes: list[str]) -> DataFrame:
    """Paths and sizes under a folder whose names end with a suffix (any case); contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return found.where(F.lower("path").rlike("(" + "|".join("\\." + s.lstrip(".") for s in suffixes) + ")$"))


def indexed_text(lines: DataFrame, value: str = "value") -> DataFrame:
    """``id rest`` lines as (id, rest, copies); blank lines are skipped, an id of more copies is a duplicate."""
    parts = lines.where(F.trim(value) != "").select(F.regexp_extract(F.trim(value), r"^(\d+)\s*(.*)$", 1).cast("long").alias("id"), F.regexp_extract(F.trim(value), r"^(\d+)\s*(.*)$", 2).alias("rest"))
    copies = parts.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    return parts.join(copies, "id")


def partition_list(lines: DataFrame, value: str = "value", statuses: tuple[str, ...] = ("train", "query", "gallery")) -> DataFrame:
    """``image item status`` rows, statuses checked (others raise)."""
    p = F.split(F.trim(value), r"\s+")
    ok = F.array_contains(F.array(*[F.lit(s) for s in statuses]), p[2])
    return lines.where(F.size(p) == 3).select(p[0].alias("image"), p[1].alias("item"), F.when(ok, p[2]).otherwise(F.raise_error(F.concat(F.lit("unknown status "), p[2])).cast("string")).alias("status"))


def status_ordered(records: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the wanted statuses with the status's place in that order."""
    return records.where(F.col("status").isin(wanted)).withColumn("status_order", F.array_position(F.array(*[F.lit(s) for s in wanted]), F.col("status")))


def natural_labels(items: DataFrame, item: str) -> DataFrame:
    """(item, label): the number at an item's end if those are unique, else the rank of the item."""
    from pyspark.sql import Window

    d = items.select(item).distinct().withColumn("_n", F.nullif(F.regexp_extract(item, r"(\d+)$", 1), F.lit("")).cast("long"))
    c = d.agg((F.count_distinct("_n") == F.count(F.lit(1))).alias("_u"))
    return d.crossJoin(F.broadcast(c)).select(item, F.when(F.col("_u"), F.col("_n")).otherwise(F.row_number().over(Window.orderBy(item)) - 1).cast("long").alias("label"))


def split_list(lines: DataFrame, suffixes: list[str], value: str = "value", order: str = "line_no") -> DataFrame:
    """The first token with a suffix of each line, the first line of each token only: (token, line_no)."""
    return lines.select(first_token(F.col(value), suffixes).alias("token"), order).where("token is not null").groupBy("token").agg(F.min(order).alias(order))


def trials_jsonl(spark, path: str) -> DataFrame:
    """Trials of a JSONL file with an explicit schema; only complete ones with a value."""
    schema = "number long, state string, value double, params map<string,string>, user_attrs map<string,string>, datetime_start string, datetime_complete string, duration_seconds double"
    return spark.read.schema(schema).json(path).where("state = 'COMPLETE' and value is not null")


def integrity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has: (key, missing_in); must be empty."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("missing_in", F.lit("right")).unionByName(y.join(x, key, "left_anti").withColumn("missing_in", F.lit("left")))


def resolved(df: DataFrame, name: str, listing: DataFrame, path: str, roots: list[str]) -> DataFrame:
    """Adds ``path``: the first root under which the listing has the name; null if none has."""
    tries = df.withColumn("_try", F.explode(F.sequence(F.lit(0), F.lit(len(roots) - 1)))).withColumn("_full", F.concat(F.array(*[F.lit(r) for r in roots])[F.col("_try")], F.col(name)))
    there = listing.select(F.col(path).alias("_there")).distinct()
    found = tries.join(there, F.col("_full") == F.col("_there")).groupBy(name).agg(F.min_by("_full", "_try").alias("path"))
    return df.join(found, name, "left")


def header_check(rows: DataFrame, stated: int) -> DataFrame:
    """(rows, header_ok): whether a file's stated number of rows is the one it has."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) == stated).alias("header_ok"))


def product_list(lines: DataFrame, value: str = "value") -> DataFrame:
    """``image class superclass path`` rows; the superclass is named by the path's first part without ``_final``."""
    p = F.split(F.trim(value), r"\s+")
    return lines.where(p[0].rlike("^[0-9]+$")).select(p[0].cast("long").alias("image_id"), p[1].cast("long").alias("class_id"), p[2].cast("long").alias("super_class_id"), F.regexp_replace(F.split(p[3], "/")[0], "_final$", "").alias("superclass"))
