"""Neighbour graphs as edge tables, their energies, components and induced parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import doubles, squared_distance
from ..sources.shared import stored


def both_ways(near: DataFrame, weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    one = near.select(F.col("query_id").alias("src"), F.col("ref_id").alias("dst"), w.alias("w"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).where("src <> dst")


def binary_graph(near: DataFrame) -> DataFrame:
    """Symmetric by OR: an edge in both directions for each pair in either's list."""
    return both_ways(near).select("src", "dst", F.lit(1.0).alias("w")).distinct()


def mixed_affinity(near: DataFrame, gamma: float = 1.0) -> DataFrame:
    """``max(cos, 0)^gamma`` of both directed lists summed; zero entries go."""
    w = F.pow(F.greatest(F.col("score"), F.lit(0.0)), F.lit(float(gamma)))
    return both_ways(near, w).groupBy("src", "dst").agg(F.sum("w").alias("w")).where("w > 0")


#: Nodes of a part of a class, whose pairs with another part are one row until they are made; pairs that are made at once.
PART, PAIRS = 1024, 1 << 18


def _class_pairs(labeled: DataFrame, sample: str, label: str, known: DataFrame | None = None) -> DataFrame:
    """(src, dst) for all ordered pairs of one class, without those of ``known`` (src, dst). Parts of a class meet as rows
    that hold their nodes' ids, which are dealt over all tasks before they become pairs: no task gets a whole class, and no
    pair is shuffled. Ids are unique."""
    rows = labeled.select(F.col(sample).alias("src"), F.col(label).alias("_l")).where("_l is not null")
    sizes = rows.groupBy("_l").agg(F.ceil(F.count(F.lit(1)) / PART).alias("_k"))
    kind = dict(rows.dtypes)["src"]
    none = F.array().cast(f"array<{kind}>")
    if known is not None:
        rows = rows.join(known.groupBy("src").agg(F.collect_list("dst").alias("_n")), "src", "left")
    rows = rows.withColumn("_n", none if known is None else F.coalesce("_n", none))
    parts = rows.join(sizes, "_l").groupBy("_l", F.pmod(F.xxhash64("src"), F.col("_k")).alias("_p"))
    parts = _cut(parts.agg(F.sort_array(F.collect_list(F.struct("src", "_n"))).alias("_r")).select("_l", F.col("_r.src").alias("_ids"), F.col("_r._n").alias("_known")))
    pairs = parts.join(parts.select("_l", F.col("_ids").alias("_others")), "_l").select("_ids", "_known", "_others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, left_out, others in zip(*(batch.column(c) for c in range(3)), strict=True):
                a, b, left_out = ids.values, others.values, left_out.values
                gone = np.flatnonzero(np.diff(left_out.offsets.to_numpy()))
                for at in range(0, len(a), PAIRS // PART):
                    i = np.arange(at, min(len(a), at + PAIRS // PART))
                    keep = np.ones((len(i), len(b)), dtype=bool)
                    for k in gone[(gone >= i[0]) & (gone <= i[-1])]:
                        keep[k - at] = ~pc.is_in(b, left_out[k].values).to_numpy(zero_copy_only=False)
                    src, dst = a.take(pa.array(np.repeat(i, len(b)))), b.take(pa.array(np.tile(np.arange(len(b)), len(i))))
                    keep = keep.ravel() & pc.not_equal(src, dst).to_numpy(zero_copy_only=False)
                    made = pa.RecordBatch.from_arrays([src, dst], names=["src", "dst"])
                    yield made if keep.all() else made.filter(pa.array(keep))

    return pairs.repartition(8 * labeled.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, f"src {kind}, dst {kind}")


def _pair_weight(labeled: DataFrame, label: str) -> float:
    """One over the ordered pairs of one class; without any there is no weight to give."""
    n = labeled.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0]
    return 1.0 / n if n else 0.0


def supervised_graph(labeled: DataFrame, sample: str, label: str) -> DataFrame:
    """All pairs of one class, each direction ``1 / (2 pairs)``. Quadratic in a class, as defined."""
    return _class_pairs(labeled, sample, label).select("src", "dst", F.lit(_pair_weight(labeled, label)).alias("w"))


def weighted_knn_graph(near: DataFrame, k: int, supervised: DataFrame | None = None) -> DataFrame:
    """Binary edges weighing ``1 / k``, plus the supervised graph's weights."""
    g = binary_graph(near).select("src", "dst", F.lit(1.0 / k).alias("w"))
    if supervised is not None:
        g = g.unionByName(supervised)
    return g.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def supervised_knn_graph(near: DataFrame, k: int, labeled: DataFrame, sample: str, label: str) -> DataFrame:
    """:func:`weighted_knn_graph` with the supervised graph of ``labeled``. Only the edges between neighbours, of which there
    are a few a node, are looked up among the pairs of one class; those pairs are not grouped again."""
    edges = _cut(binary_graph(near).select("src", "dst"))
    a, b = (labeled.select(F.col(sample).alias(n), F.col(label).alias(f"_{n}")) for n in ("src", "dst"))
    both = _cut(edges.join(a, "src").join(b, "dst").where("_src = _dst").select("src", "dst"))
    weight = _pair_weight(labeled, label)
    near_w = edges.join(both.withColumn("_b", F.lit(True)), ["src", "dst"], "left").select("src", "dst", F.when(F.col("_b"), F.lit(1.0 / k + weight)).otherwise(1.0 / k).alias("w"))
    return near_w.unionByName(_class_pairs(labeled, sample, label, both).select("src", "dst", F.lit(weight).alias("w")))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("weight"))


def energy(edges: DataFrame, nodes: DataFrame, vec: str, id_col: str = "vec_id", normalised: bool = False) -> DataFrame:
    """(edges, energy, mean): sum over undirected edges of ``w |z_i - z_j|^2``; endpoints scaled by ``1/sqrt(degree)`` if
    normalised."""
    z = nodes.select(F.col(id_col).alias("_id"), doubles(vec).alias("_v"))
    if normalised:
        d = edges.groupBy(F.col("src").alias("_n")).agg(F.sum("w").alias("_d"))
        z = z.join(d, z["_id"] == d["_n"], "left").select("_id", F.transform("_v", lambda x: x / F.sqrt(F.greatest(F.coalesce("_d", F.lit(0.0)), F.lit(1.0)))).alias("_v"))
    half = edges.where("src < dst")
    joined = half.join(z.select(F.col("_id").alias("src"), F.col("_v").alias("a")), "src").join(z.select(F.col("_id").alias("dst"), F.col("_v").alias("b")), "dst")
    e = joined.agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("w") * squared_distance(F.col("a"), F.col("b"))).alias("_e"))
    return e.select("edges", F.round("_e", 6).alias("energy"), F.round(F.when(F.col("edges") > 0, F.col("_e") / F.col("edges")), 6).alias("mean_energy"))


def asymmetric(edges: DataFrame) -> DataFrame:
    """Undirected edges that don't occur once in either direction, loops and non-positive weights; must be empty."""
    bad = edges.where("src = dst or w <= 0").select("src", "dst")
    odd = edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count(F.lit(1)).alias("n")).where("n <> 2").select("src", "dst")
    return bad.unionByName(odd).distinct()


def induced(edges: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    n = nodes.select(F.col(id_col).alias("src"))
    return edges.join(n, "src", "left_semi").join(n.withColumnRenamed("src", "dst"), "dst", "left_semi").where("src < dst").select("src", "dst", "w")


def _cut(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: cuts a loop's lineage."""
    return stored(df, "graph")


def components(edges: DataFrame, nodes: DataFrame, id_col: str, rounds: int = 50) -> DataFrame:
    """(node, component): least id reachable. Labels spread along edges and jump to their label's label each round."""
    label = nodes.select(F.col(id_col).alias("node"), F.col(id_col).alias("component"))
    edges = _cut(edges.select("src", "dst"))  # else each round makes the graph again
    for _ in range(rounds):
        seen = edges.join(label, edges["dst"] == label["node"]).groupBy("src").agg(F.min("component").alias("_m"))
        new = label.join(seen, label["node"] == seen["src"], "left").select("node", F.least("component", "_m").alias("component"))
        jump = new.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        new = _cut(new.join(jump, new["component"] == jump["_n"]).select("node", F.least("component", "_c").alias("component")))
        moved = new.join(label.withColumnRenamed("component", "_was"), "node").where("component <> _was").isEmpty()
        label = new
        if moved:
            return label
    raise ValueError("components did not settle")


def local_index(edge_batch: DataFrame, batch: str, position: str) -> DataFrame:
    """Nodes of each edge batch in first-seen order with their local index; edges with local endpoints."""
    from pyspark.sql import Window

    ends = edge_batch.select(batch, F.posexplode(F.array("src", "dst")).alias("_s", "node"), F.col(position).alias("_p"))
    first = ends.groupBy(batch, "node").agg(F.min(F.col("_p") * 2 + F.col("_s")).alias("_f"))
    local = first.select(batch, "node", (F.row_number().over(Window.partitionBy(batch).orderBy("_f")) - 1).cast("long").alias("local"))
    a, b = local.select(batch, F.col("node").alias("src"), F.col("local").alias("local_src")), local.select(batch, F.col("node").alias("dst"), F.col("local").alias("local_dst"))
    return edge_batch.join(a, [batch, "src"]).join(b, [batch, "dst"]).select(batch, position, "src", "dst", "local_src", "local_dst")
