"""Row views: concatenated sources, repeated and regrouped views, pools, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import group_positioned, id_positioned, order_key


def concatenated(parts: list[tuple[str, DataFrame]], id_col: str) -> DataFrame:
    """Sources end to end: (source, local_id, global_id), offsets by sizes in the given order."""
    out, offset = None, 0
    for name, df in parts:
        n = df.count()
        one = df.select(F.lit(name).alias("source"), F.col(id_col).cast("long").alias("local_id"))
        one = id_positioned(one, "local_id", "global_id").withColumn("global_id", F.col("global_id") + offset)
        out, offset = one if out is None else out.unionByName(one), offset + n
    return out


def with_external(split: DataFrame, external: DataFrame, mode: str) -> DataFrame:
    """The unlabeled pool (sample_id, label): the split's own rows, external ones labelled -1, or both."""
    ext = external.select("sample_id", F.lit(-1).cast("long").alias("label"), F.lit("external").alias("origin"))
    own = split.select("sample_id", F.col("label").cast("long").alias("label"), F.lit("split").alias("origin"))
    return {"split": own, "external": ext}.get(mode) if mode != "split_and_external" else own.unionByName(ext)


def hidden_views(df: DataFrame, sample: str, views: int) -> DataFrame:
    """Each row ``views`` times, its label hidden: (sample, view, view_id, label -1)."""
    return df.select(F.col(sample), F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view")).select(sample, "view", (F.col(sample) * views + F.col("view")).cast("long").alias("view_id"), F.lit(-1).cast("long").alias("label"))


def regrouped(views: DataFrame, sample: str, view: str, value: str, label: str) -> DataFrame:
    """Views of a sample as an array in view order, with the number of labels they carry (1 if they agree)."""
    return views.groupBy(sample).agg(F.transform(F.array_sort(F.collect_list(F.struct(view, value))), lambda x: x[value]).alias("views"), F.count_distinct(label).alias("labels"))


def joint_space(unlabeled: DataFrame, references: DataFrame, sample: str) -> DataFrame:
    """Unlabeled rows first, references offset by their number: (joint_id, sample, role)."""
    n = unlabeled.count()
    a, b = (id_positioned(d.select(sample), sample, "joint_id") for d in (unlabeled, references))
    return a.select("joint_id", sample, F.lit(0).cast("long").alias("role")).unionByName(b.select((F.col("joint_id") + n).alias("joint_id"), sample, F.lit(1).cast("long").alias("role")))


def ring_batches(df: DataFrame, sample: str, label: str, seed: int, batches: int, classes: int, m: int) -> DataFrame:
    """Batches of ``classes`` shuffled classes with ``m`` rows each, cycling through a class: (batch, slot, label, sample)."""
    rows = group_positioned(df.select(label, sample), label, order_key(seed, sample), [sample], "_r", "_n").withColumn("_r", F.col("_r") - 1)
    grid = df.select(label).distinct().withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    key = F.md5(F.concat(F.lit(f"{seed}:batch:"), F.col("batch").cast("string"), F.lit(":"), F.col(label).cast("string")))
    chosen = grid.withColumn("_c", F.row_number().over(Window.partitionBy("batch").orderBy(key, label)) - 1).where(F.col("_c") < classes)
    slots = chosen.withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    sizes = rows.select(label, "_n").distinct()
    need = slots.join(sizes, label).withColumn("_r", F.pmod(F.col("batch") * m + F.col("_m"), F.col("_n")))
    return need.join(rows.select(label, "_r", sample), [label, "_r"]).select(F.col("batch").cast("long"), (F.col("_c") * m + F.col("_m")).cast("long").alias("slot"), label, sample)


def paired_streams(a: DataFrame, b: DataFrame, batch: str) -> DataFrame:
    """Two batch streams side by side; the shorter one cycles."""
    n = b.select(batch).distinct().count()
    left = a.select(F.col(batch).alias("batch_a")).distinct()
    return left.select("batch_a", F.pmod("batch_a", F.lit(n)).alias("batch_b"))


def epoch_length(length: int | None, rows: int, batch: int) -> int:
    """Whole batches: an explicit length rounded down, else the rows rounded up."""
    return length // batch * batch if length is not None else -(-rows // batch) * batch
