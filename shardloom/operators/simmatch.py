"""A semi-supervised objective of four terms over a labelled and an unlabelled stream, a bank of labelled anchors and a
queue of unlabelled ones.

The unlabelled rows' neighbours among the labelled anchors are one graph, made once: it gives the propagated labels that
the node-node term uses. Relations to the queue are softmaxes over all of it, made by pairs of a block of rows and one of the
queue in two passes: the first gives the softmaxes' sums, the second the terms that they scale. A queue of any size fits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import doubles, dot, let, softmax, total, unit
from .alignment import distribution_alignment
from .graph import _cut
from .knn import BLOCK_BYTES, knn

EPS = 1e-7
KINDS = {"long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def log_softmax(v: Column) -> Column:
    """Shifted by the largest entry."""
    shifted = let(F.array_max(v), lambda top: F.transform(v, lambda x: x - top))
    return let(shifted, lambda s: let(F.ln(total(F.transform(s, F.exp))), lambda z: F.transform(s, lambda x: x - z)))


def cross_entropy(p: Column, q: Column, eps: float = EPS) -> Column:
    """``-sum p ln max(q, eps)``."""
    return -dot(p, F.transform(q, lambda x: F.ln(F.greatest(x, F.lit(eps)))))


def propagated(near: DataFrame, rows: DataFrame, anchors: DataFrame, classes: int, temperature: float, alpha: float, eps: float = EPS) -> DataFrame:
    """(id, propagated): each row's class probabilities spread through its anchors.

    ``near`` is (query_id, ref_id, rank), ``rows`` (id, v, p) and ``anchors`` (id, v, label), vectors of length 1. On a row
    and its anchors, ``(1 - a)(I - a P)^-1 Y`` with P the softmax of inner products over T without the diagonal and Y the
    row's own probabilities and the anchors' classes; the row's entry, not below zero, over its sum.
    """
    held = near.join(anchors.select(F.col("id").alias("ref_id"), F.col("v").alias("rv"), "label"), "ref_id")
    lists = held.groupBy(F.col("query_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "rv", "label"))).alias("a"))  # as many as asked for
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("propagated", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for batch in batches:
            out = []
            for v, p, a in zip(*(batch.column(c).to_pylist() for c in ("v", "p", "a")), strict=True):
                x = np.array([v, *[r["rv"] for r in a]])
                s = x @ x.T / temperature
                np.fill_diagonal(s, -np.inf)
                s = np.exp(s - s.max(axis=1, keepdims=True))
                s /= s.sum(axis=1, keepdims=True)
                y = np.zeros((len(x), classes))
                y[0] = p
                y[np.arange(1, len(x)), [int(r["label"]) for r in a]] = 1
                f = np.maximum((1 - alpha) * np.linalg.solve(np.eye(len(x)) - alpha * s, y)[0], 0)
                out.append((f / max(f.sum(), eps)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(pa.float64()))], names=kind.names)

    return rows.select("id", "v", "p").join(lists, "id").mapInArrow(run, kind)


def relations(rows: DataFrame, queue: DataFrame, columns: list[str], temperature: float) -> DataFrame:
    """(id, edge, expected): for two vectors of each row (``columns``: teacher, student), the cross entropy of the student's
    relations to the queue under the teacher's, and the queue's class probabilities under the student's relations.

    ``queue`` is (slot, v, p). A block of it takes ``BLOCK_BYTES`` at most; of each row and block come the largest logits and
    the sums below them in the first pass, and parts of the results in the second, so a task holds two blocks only.
    """
    size, width = queue.agg(F.count(F.lit(1)), F.max(F.size("v") + F.size("p"))).first()
    if not size:
        raise ValueError("the queue is empty")
    spark = rows.sparkSession
    parts = -(-size * width * 8 // BLOCK_BYTES)
    n = max(-(-rows.count() * 2 * width * 8 // BLOCK_BYTES), -(-2 * spark.sparkContext.defaultParallelism // parts))
    each = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    left = rows.select("id", *[F.col(c).alias(x) for c, x in zip(columns, ("t", "s"), strict=True)])
    right = _cut(queue.select("slot", "v", "p", F.pmod(F.xxhash64("slot"), F.lit(parts)).alias("part"))).withColumn("block", each(n))
    wide = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)

    def paired(rows: DataFrame, task: Callable, schema: str) -> DataFrame:
        """What ``task`` gives of each run of rows and block of the queue."""

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return pa.table({c.split()[0]: pa.array([], KINDS[c.split()[1]]) for c in schema.split(", ")})
            b = b.sort_by("slot")
            bank, probs, made = wide(b, "v"), wide(b, "p"), []
            step = max(1, (1 << 22) // len(bank))
            for at in range(0, a.num_rows, step):
                run_of = a.slice(at, step)
                made.append(task(run_of, *(wide(run_of, c) @ bank.T / temperature for c in ("t", "s")), probs))
            return pa.concat_tables(made)

        dealt = rows.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(n)), "part": each(parts)})
        return dealt.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, schema)

    def tops(a: pa.Table, t: np.ndarray, s: np.ndarray, probs: np.ndarray) -> pa.Table:
        high = {f"{n}_top": x.max(axis=1) for n, x in (("t", t), ("s", s))}
        sums = {f"{n}_sum": np.exp(x - high[f"{n}_top"][:, None]).sum(axis=1) for n, x in (("t", t), ("s", s))}
        return pa.table({"id": a.column("id"), **high, **sums})

    def terms(a: pa.Table, t: np.ndarray, s: np.ndarray, probs: np.ndarray) -> pa.Table:
        t -= a.column("t_log").to_numpy()[:, None]
        s -= a.column("s_log").to_numpy()[:, None]
        edge = -np.einsum("ij,ij->i", np.exp(t), np.maximum(s, np.log(EPS)))
        return pa.table({"id": a.column("id"), "edge": edge, "expected": pa.array((np.exp(s) @ probs).tolist(), pa.list_(pa.float64()))})

    found = paired(left, tops, "id long, t_top double, s_top double, t_sum double, s_sum double").withColumn("_own", F.struct("t_top", "t_sum", "s_top", "s_sum"))
    high = found.groupBy("id").agg(F.max("t_top").alias("t_high"), F.max("s_top").alias("s_high"), F.collect_list("_own").alias("_own"))  # a row per block of the queue
    log = lambda n: (F.col(f"{n}_high") + F.ln(total(F.transform("_own", lambda o: o[f"{n}_sum"] * F.exp(o[f"{n}_top"] - F.col(f"{n}_high")))))).alias(f"{n}_log")
    scaled = left.join(_cut(high.select("id", log("t"), log("s"))), "id")
    made = paired(scaled, terms, "id long, edge double, expected array<double>").groupBy("id").agg(F.sum("edge").alias("edge"), F.collect_list("expected").alias("_e"))
    summed = F.aggregate("_e", F.transform(F.element_at("_e", 1), lambda x: x * 0), lambda acc, e: F.zip_with(acc, e, lambda x, y: x + y))
    return made.select("id", "edge", summed.alias("expected"))


def total_loss(
    labelled: DataFrame, unlabelled: DataFrame, anchors: DataFrame, queue: DataFrame, classes: int, top_n: int = 8, temperature: float = 0.1, alpha: float = 0.1,
    threshold: float = 0.95, weights: tuple[float, float, float, float] = (1.0, 1.0, 1.0, 1.0), momentum: float | None = None,
) -> DataFrame:
    """One row: classification, node_node, edge_edge, node_edge, confident (share) and total, the weighted sum.

    ``labelled`` (id, label, logits); ``unlabelled`` (id, batch, student_logits, student, teacher_logits, teacher) with graph
    vectors student and teacher; ``anchors`` (id, v, label); ``queue`` (slot, v, p). Vectors are scaled to length 1. With
    ``momentum`` the teacher's probabilities are aligned to their running mean over the batches. Rows whose largest teacher
    probability is below ``threshold`` don't count in the node-node term, which still is a mean over all.
    """
    x = labelled.agg(F.avg(-F.element_at(log_softmax(doubles("logits")), F.col("label").cast("int") + 1)).alias("classification"))
    u = unlabelled.select("id", "batch", doubles("student_logits").alias("z"), unit(doubles("student")).alias("s"), unit(doubles("teacher")).alias("v"), softmax(doubles("teacher_logits")).alias("p"))
    if momentum is not None:
        u = distribution_alignment(u, "batch", "p", momentum).drop("p").withColumnRenamed("aligned", "p")
    u = _cut(u)
    anchors = _cut(anchors.select("id", unit(doubles("v")).alias("v"), "label"))
    queue = queue.select("slot", unit(doubles("v")).alias("v"), doubles("p").alias("p"))
    near = knn(u.select("id", "v"), anchors.select("id", "v"), "v", top_n, id_col="id", metric="dot", skip_self=False)
    parts = u.join(propagated(near, u, anchors, classes, temperature, alpha), "id").join(relations(u, queue, ["v", "s"], temperature), "id")
    sure = (F.array_max("p") >= threshold).cast("double")
    losses = parts.agg(
        F.avg(-dot(F.col("propagated"), log_softmax(F.col("z"))) * sure).alias("node_node"), F.avg("edge").alias("edge_edge"),
        F.avg(cross_entropy(F.col("p"), F.col("expected"))).alias("node_edge"), F.avg(sure).alias("confident"),
    )
    names = ("classification", "node_node", "edge_edge", "node_edge")
    both = x.crossJoin(losses)  # one row each
    weighted = [F.lit(float(w)) * F.col(n) for w, n in zip(weights, names, strict=True)]
    return both.select(*names, "confident", (weighted[0] + weighted[1] + weighted[2] + weighted[3]).alias("total"))
