"""Batch plans of the samplers as tables: (batch, slot, ...) by hash order, no driver loops over rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import group_positioned, hash_positioned, order_key
from .views import ring_batches


def two_stream(pseudo: DataFrame, true: DataFrame, sample: str, label: str, seed: int, batches: int, pseudo_size: int, true_size: int, m: int) -> DataFrame:
    """Pseudo-labelled rows first, then true ones, each stream ``m`` rows of ``size / m`` classes: (batch, slot, stream, ...)."""
    a = ring_batches(pseudo, sample, label, seed, batches, pseudo_size // m, m).withColumn("stream", F.lit("pseudo"))
    b = ring_batches(true, sample, label, seed + 1, batches, true_size // m, m).withColumns({"slot": F.col("slot") + pseudo_size, "stream": F.lit("true")})
    return a.unionByName(b)


def neighbour_batches(near: DataFrame, seed: int, queries: int) -> DataFrame:
    """Batches of ``queries`` shuffled query rows, each followed by its neighbours: (batch, query_id, member, place)."""
    ids = near.select("query_id").distinct()
    plan = hash_positioned(ids, order_key(seed, "query_id"), ["query_id"], "_i").select("query_id", F.floor(F.col("_i") / queries).cast("long").alias("batch"))
    own = plan.select("batch", "query_id", F.col("query_id").alias("member"), F.lit(0).cast("long").alias("place"))
    return own.unionByName(near.join(plan, "query_id").select("batch", "query_id", F.col("ref_id").alias("member"), F.col("rank").alias("place")))


def edge_batches(edges: DataFrame, seed: int, size: int) -> DataFrame:
    """Undirected edges in shuffled order, ``size`` to a batch: (batch, position, src, dst)."""
    half = edges.where("src < dst")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("src").cast("string"), F.lit("-"), F.col("dst").cast("string")))
    n = F.col("_i")
    return hash_positioned(half, key, ["src", "dst"], "_i").select(F.floor(n / size).cast("long").alias("batch"), (n % size).cast("long").alias("position"), "src", "dst")


def reference_batches(df: DataFrame, sample: str, label: str, seed: int, batches: int, draws: int) -> DataFrame:
    """Every class in every batch, ``draws`` rows each, cycling through its shuffled rows: (batch, label, draw, sample)."""
    rows = group_positioned(df.select(label, sample), label, order_key(seed, sample), [sample], "_r", "_n").withColumn("_r", F.col("_r") - 1)
    grid = rows.select(label, "_n").distinct().withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    need = grid.withColumn("_r", F.pmod(F.col("batch") * draws + F.col("draw"), F.col("_n")))
    return need.join(rows.drop("_n"), [label, "_r"]).select(F.col("batch").cast("long"), label, F.col("draw").cast("long"), sample)


def fitting_choices(folds: DataFrame, fold: str, label: str, choices: DataFrame) -> DataFrame:
    """Choices ``batch:m`` that every fold's labelled classes can fill: (choice, batch, m)."""
    classes = folds.groupBy(fold).agg(F.count_distinct(label).alias("classes")).agg(F.min("classes").alias("least"))
    parts = F.split("choice", ":")
    parsed = choices.select("choice", parts[0].cast("long").alias("batch"), parts[1].cast("long").alias("m"))
    return parsed.crossJoin(F.broadcast(classes)).where((F.col("batch") % F.col("m") == 0) & (F.col("m") * F.col("least") >= F.col("batch"))).drop("least")  # one row


def sampled_edges(edges: DataFrame, seed: int, cap: int) -> DataFrame:
    """At most ``cap`` undirected edges in hash order, for diagnostics."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("src").cast("string"), F.lit("-"), F.col("dst").cast("string")))
    return edges.where("src < dst").orderBy(key, "src", "dst").limit(cap)


def diagnostic_nodes(edges: DataFrame, nodes: DataFrame, id_col: str, seed: int, cap: int) -> DataFrame:
    """At most ``cap`` nodes for diagnostics, endpoints of edges before isolated ones: (node, endpoint)."""
    ends = edges.select(F.col("src").alias("_n")).union(edges.select("dst")).distinct().withColumn("endpoint", F.lit(True))
    all_ = nodes.select(F.col(id_col).alias("node")).join(ends, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("endpoint", F.lit(False)).alias("endpoint"))
    return all_.orderBy(F.desc("endpoint"), order_key(seed, "node"), "node").limit(cap)


def edge_report(edges: DataFrame, nodes: DataFrame, id_col: str, label: str) -> DataFrame:
    """Edges with both endpoints' label and kind (labelled or not), as the edge sink writes them."""
    n = nodes.select(F.col(id_col).alias("_n"), F.coalesce(label, F.lit(-1)).alias("_l"))
    out = edges
    for end, name in (("src", "source"), ("dst", "target")):
        side = n.select(F.col("_n").alias(end), F.col("_l").alias(f"{name}_label"))
        out = out.join(side, end).withColumn(f"{name}_kind", F.when(F.col(f"{name}_label") >= 0, "labeled").otherwise("unlabeled"))
    return out


def k_shot_choices(choices: DataFrame, k: int) -> DataFrame:
    """Choices (choice, batch, m) that repeat no row of a class with ``k`` labelled ones; none left is an error."""
    kept = choices.where(F.col("m") <= k)
    if kept.isEmpty():
        raise ValueError(f"no choice has m <= {k}")
    return kept
