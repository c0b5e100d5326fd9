"""Label spreading and diffusion as joins and sums, over the solves of :mod:`.solves` where a system is to be solved.

Scores are long (node, class, score); a round is one join on nodes and one partially aggregated sum. Rounds are cut by a
written table so that plans don't grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import argmax, dot, entropy_confidence, l1_unit, softmax, total
from .factorisation import factored, patterns
from .graph import _cut, components
from .solves import conjugate_gradients, matrix

#: Nodes of the largest component that is factored: its factor is at worst a dense block of 128 MB.
FACTOR_NODES = 4096


def normalised_edges(edges: DataFrame) -> DataFrame:
    """``D^-1/2 A D^-1/2``; nodes without weight have no edges here."""
    d = edges.groupBy("src").agg(F.sum("w").alias("_d"))
    a = edges.join(d, "src").join(d.select(F.col("src").alias("dst"), F.col("_d").alias("_e")), "dst")
    return a.select("src", "dst", (F.col("w") / F.sqrt(F.col("_d") * F.col("_e"))).alias("s"))


def spread(edges: DataFrame, seeds: DataFrame, alpha: float = 0.2, rounds: int = 20, cut_every: int = 5) -> DataFrame:
    """``F <- a S F + (1 - a) Y`` from ``seeds`` (node, class, y): (node, class, score)."""
    s = _cut(normalised_edges(edges))
    y = seeds.select("node", "class", ((1 - alpha) * F.col("y")).alias("score"))
    f = y
    for i in range(rounds):
        moved = s.join(f, s["dst"] == f["node"]).select(s["src"].alias("node"), "class", (alpha * F.col("s") * F.col("score")).alias("score"))
        f = moved.unionByName(y).groupBy("node", "class").agg(F.sum("score").alias("score"))
        if (i + 1) % cut_every == 0:
            f = _cut(f)
    return f


def decided(scores: DataFrame, nodes: DataFrame) -> DataFrame:
    """Best class of each of ``nodes`` and its share of the node's mass. A node without mass (no seed reaches it, usually
    because its component has none) is an error."""
    w = scores.groupBy("node").agg(F.sum("score").alias("_m"), F.max_by("class", F.struct("score", -F.col("class"))).alias("pred_label"), F.max("score").alias("_b"))
    none = F.raise_error(F.concat(F.lit("no mass: node "), F.coalesce(F.col("node").cast("string"), F.lit("null"))))
    mass = F.when(F.col("_m") > 0, F.col("_m")).otherwise(none)
    return nodes.select("node").join(w, "node", "left").select("node", "pred_label", (F.col("_b") / mass).alias("confidence"))


def class_shares(scores: DataFrame, slack: float = 1e-12) -> DataFrame:
    """(node, class, share): scores over their node's sum. Negative scores within ``slack`` are zeros; scores below it,
    null or not finite, and nodes without mass are errors."""
    s = F.col("score").cast("double")
    bad = lambda why: F.raise_error(F.concat(F.lit(f"{why}: node "), F.coalesce(F.col("node").cast("string"), F.lit("null"))))
    fit = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf")) & (s >= -slack)
    clean = scores.select("node", "class", F.when(fit, F.greatest(s, F.lit(0.0))).otherwise(bad("score below zero or not finite")).alias("_s"))
    mass = clean.withColumn("_m", F.sum("_s").over(Window.partitionBy("node")))
    return mass.select("node", "class", F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")).otherwise(bad("no mass")).alias("share"))


def dense_rows(scores: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, f): every node's scores in class order, zeros for the classes that it has no score of. ``classes`` is one
    row with the sorted array ``classes``."""
    own = scores.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("class", "score"))).alias("_m"))
    f = F.transform("classes", lambda c: F.coalesce(F.element_at("_m", c), F.lit(0.0)))
    return nodes.select("node").join(own, "node", "left").crossJoin(F.broadcast(classes)).select("node", f.alias("f"))  # classes: one row


def class_list(seeds: DataFrame) -> DataFrame:
    return seeds.agg(F.array_sort(F.collect_set("class")).alias("classes"))


def class_balanced_diffusion(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, component: DataFrame, alpha: float = 0.99, rounds: int = 20) -> DataFrame:
    """Truncated conjugate gradients of ``(I - a S) F = Y``, ``Y = 1 / seeds of the class``, over components with a seed;
    negatives are set to 0, certainty is the entropy confidence over its largest value, 1 for seeds."""
    seeded = component.join(seeds.select("node"), "node", "left_semi").select("component").distinct()
    live = component.join(seeded, "component", "left_semi").select("node")
    s = normalised_edges(edges).join(live.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst", F.col("s").alias("w"))
    sizes = seeds.groupBy("class").agg(F.count(F.lit(1)).alias("_n"))
    right = seeds.join(sizes, "class").select("node", "class", (1.0 / F.col("_n")).alias("y"))
    f = conjugate_gradients(matrix(s, live.withColumn("diagonal", F.lit(1.0)), -alpha), right, rounds, strict=False)
    return certain(f, live, seeds)


def certain(scores: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, pred_label, certainty) of class scores: clamped at 0, normalised, entropy confidence over the largest. Nodes
    without mass are left out."""
    classes = class_list(seeds)
    rows = dense_rows(scores.select("node", "class", F.greatest("score", F.lit(0.0)).alias("score")), nodes, classes)
    p = rows.withColumn("_m", total(F.col("f"))).where("_m > 0").withColumn("_p", F.transform("f", lambda x: x / F.col("_m")))
    best = F.element_at("classes", (argmax(F.col("_p")) + 1).cast("int"))
    made = _cut(p.crossJoin(F.broadcast(classes)).select("node", best.alias("pred_label"), entropy_confidence(F.col("_p")).alias("_c")))
    top = made.agg(F.max("_c").alias("_t"))
    s = seeds.select("node", F.lit(True).alias("_seed")).distinct()
    return made.crossJoin(F.broadcast(top)).join(s, "node", "left").select("node", "pred_label", F.when(F.col("_seed"), F.lit(1.0)).otherwise(F.col("_c") / F.col("_t")).alias("certainty"))


def confident(scores: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node, pred_label, confidence): the best class of each node and the entropy confidence of its scores over their
    absolute sum. A node whose scores are all zero (nothing reaches it from a seed) is an error."""
    classes = class_list(seeds)
    rows = dense_rows(scores, nodes, classes).crossJoin(F.broadcast(classes)).select("node", "classes", l1_unit(F.col("f")).alias("_p"))
    return rows.select("node", F.element_at("classes", (argmax(F.col("_p")) + 1).cast("int")).alias("pred_label"), entropy_confidence(F.col("_p")).alias("confidence"))


def mixed_propagation(edges: DataFrame, node_ids: DataFrame, seeds: DataFrame, mu: float = 1 / 99, beta: float = 1.0, temperature: float = 4.0, tolerance: float = 1e-10, rounds: int = 5000, solver: str = "cg") -> DataFrame:
    """Laplacian solve, dissimilarity weights on its edges, and a second solve with both: (node, class, score).

    ``solver`` "cg" starts the second solve from the first one's scores; "factor" factors both systems, which have their
    entries in the same places, by one set of patterns. Components of more than ``FACTOR_NODES`` are solved by conjugate
    gradients then too: their factor would fill up beyond a task's memory."""
    if solver not in ("cg", "factor"):
        raise ValueError(f"unknown solver {solver!r}")
    d = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("_d"))
    marked = node_ids.join(d, "node", "left").join(seeds.select("node", F.lit(mu).alias("_mu")).distinct(), "node", "left")
    nodes = _cut(marked.select("node", (F.coalesce("_d", F.lit(0.0)) + F.coalesce("_mu", F.lit(0.0))).alias("diagonal"), F.coalesce("_d", F.lit(0.0)).alias("degree")))
    right = seeds.select("node", "class", F.lit(mu).alias("y"))
    first = _cut(matrix(edges, nodes, -1.0))
    if solver == "factor":
        every = components(edges, node_ids, "node")
        # systems without a seed have the solution zero, and no factor: their matrix is singular
        component = _cut(every.join(every.join(seeds.select("node"), "node", "left_semi").select("component").distinct(), "component", "left_semi").select("node", "component"))
        wide = component.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FACTOR_NODES)
        large = _cut(component.join(wide, "component", "left_semi").select("node"))
        component = _cut(component.join(wide, "component", "left_anti"))
        known = patterns(first, component)

        def solved(m: DataFrame, f: DataFrame | None = None) -> DataFrame:
            own = lambda d, c: d.join(large.withColumnRenamed("node", c), c, "left_semi")
            direct = factored(m, component, right, known)
            if large.isEmpty():
                return direct
            return direct.unionByName(conjugate_gradients(own(m, "src"), own(right, "node"), rounds, tolerance, start=None if f is None else own(f, "node")))

        f0 = _cut(solved(first))
    else:
        f0 = _cut(conjugate_gradients(first, right, rounds, tolerance))
    g = _cut(dissimilarity(edges, dense_rows(f0, nodes, class_list(seeds)), nodes, temperature))
    sums = g.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("_g"))
    both = edges.select("src", "dst", (-F.col("w")).alias("w")).unionByName(g.select("src", "dst", (2 * beta * F.col("w")).alias("w")))
    filled = nodes.join(sums, "node", "left").select("node", (F.col("diagonal") + 2 * beta * F.coalesce("_g", F.lit(0.0))).alias("diagonal"))
    second = matrix(both, filled)
    return solved(_cut(second), f0) if solver == "factor" else conjugate_gradients(second, right, rounds, tolerance, start=f0)


def dissimilarity(edges: DataFrame, rows: DataFrame, nodes: DataFrame, temperature: float = 4.0) -> DataFrame:
    """``rows`` is (node, f) with f in class order. Per edge ``ec(p_i) ec(p_j) (1 - p_i . p_j)``, where ``p_i`` is the softmax of ``T (d_i f_i - w f_j)``."""
    rows = rows.join(nodes.select("node", "degree"), "node")
    a, b = (rows.select(F.col("node").alias(n), F.col("f").alias(f"f_{n}"), F.col("degree").alias(f"d_{n}")) for n in ("src", "dst"))
    j = edges.where("src < dst").join(a, "src").join(b, "dst")
    left = lambda x, y: F.zip_with(f"f_{x}", f"f_{y}", lambda u, v: temperature * (F.col(f"d_{x}") * u - F.col("w") * v))
    p = j.select("src", "dst", left("src", "dst").alias("_a"), left("dst", "src").alias("_b")).select("src", "dst", softmax(F.col("_a")).alias("_p"), softmax(F.col("_b")).alias("_q"))
    one = p.select("src", "dst", (entropy_confidence(F.col("_p")) * entropy_confidence(F.col("_q")) * (1 - dot(F.col("_p"), F.col("_q")))).alias("w"))
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
