"""Forward values of pairwise objectives over a batch of vectors (quadratic in a batch, as defined)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, doubles, squared_distance, unit


def _units(df: DataFrame, vec: str, id_col: str, label: str, names: tuple[str, str, str]) -> DataFrame:
    return df.select(F.col(id_col).alias(names[0]), F.col(label).alias(names[1]), unit(doubles(vec)).alias(names[2]))


def pair_distances(df: DataFrame, vec: str, batch: int, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """(i, j, li, lj, d): ``d = 2 - 2 cos`` for ``i < j`` of one batch. A batch is a run of ``batch`` consecutive ids, so
    the batches take every row, none has more than ``batch`` where ids are unique, and pairs grow in line with the rows."""
    a, b = _units(df, vec, id_col, label, ("i", "li", "x")), _units(df, vec, id_col, label, ("j", "lj", "y"))
    a, b = a.withColumn("g", F.floor(F.col("i") / batch)), b.withColumn("h", F.floor(F.col("j") / batch))
    return a.join(b, (F.col("g") == F.col("h")) & (F.col("i") < F.col("j"))).select("i", "j", "li", "lj", (2 - 2 * dot(F.col("x"), F.col("y"))).alias("d"))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def reference_entropy(queries: DataFrame, refs: DataFrame, vec: str, scale: float, id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """Entropy (nats) of the softmax of negative squared distances to one reference per class."""
    q = queries.select(F.col(id_col).alias("q"), doubles(vec).alias("x"))
    r = refs.select(F.col(label).alias("c"), doubles(vec).alias("y"))  # one per class
    s = q.crossJoin(F.broadcast(r)).select("q", "c", (-scale * squared_distance(F.col("x"), F.col("y"))).alias("s"))
    top = s.groupBy("q").agg(F.max("s").alias("t"))
    e = s.join(top, "q").withColumn("e", F.exp(F.col("s") - F.col("t")))
    per = e.groupBy("q").agg(F.sum("e").alias("z"), F.sum(F.col("e") * (F.col("s") - F.col("t"))).alias("w"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.ln("z") - F.col("w") / F.col("z")), 6).alias("entropy"))


def proxy_loss(df: DataFrame, proxies: DataFrame, vec: str, alpha: float = 32.0, margin: float = 0.1, id_col: str = "vec_id", label: str = "label", weight: str | None = None) -> DataFrame:
    """Softplus loss against one proxy per class, weighted, over the number of classes."""
    x = df.select(F.col(id_col).alias("i"), F.col(label).alias("l"), unit(doubles(vec)).alias("x"), (F.col(weight) if weight else F.lit(1.0)).alias("w"))
    p = proxies.select(F.col(label).alias("c"), unit(doubles(vec)).alias("p"))
    s = x.crossJoin(F.broadcast(p)).withColumn("s", dot(F.col("x"), F.col("p")))
    term = F.when(F.col("l") == F.col("c"), softplus(-alpha * (F.col("s") - margin))).otherwise(softplus(alpha * (F.col("s") + margin)))
    return s.agg(F.count_distinct("c").alias("classes"), F.round(F.sum(F.col("w") * term) / F.count_distinct("c"), 6).alias("loss"))


def contextual_similarity(near: DataFrame, k: int) -> DataFrame:
    """(i, j, ctx) from neighbour lists with self first: shared mutual neighbours over ``|V_i|`` where the pair is mutual,
    averaged over the first ``max(1, half-even(k / 2))`` neighbours' rows, symmetrised."""
    lists = near.where(F.col("rank") <= k).select(F.col("query_id").alias("i"), F.col("ref_id").alias("j"), "rank")
    back = lists.select(F.col("j").alias("i"), F.col("i").alias("j"))
    v = lists.join(back, ["i", "j"], "left_semi").select("i", "j")
    sizes = v.groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    shared = v.join(v.select(F.col("i").alias("m"), "j"), "j").groupBy("i", F.col("m").alias("j")).agg(F.count(F.lit(1)).alias("k"))
    ctx = shared.join(v, ["i", "j"], "left_semi").join(sizes, "i").select("i", "j", (F.col("k") / F.greatest("n", F.lit(1))).alias("c"))
    half = max(1, round(k / 2))
    first = lists.where(F.col("rank") <= half).select("i", F.col("j").alias("m"))
    mean = first.join(ctx.select(F.col("i").alias("m"), "j", "c"), "m").groupBy("i", "j").agg((F.sum("c") / half).alias("c"))
    both = mean.unionByName(mean.select(F.col("j").alias("i"), F.col("i").alias("j"), "c"))
    return both.groupBy("i", "j").agg(F.round(F.sum("c") / 2, 6).alias("ctx"))


def relaxed_contrastive(pairs: DataFrame, ctx: DataFrame, sigma: float = 1.0, delta: float = 1.0) -> DataFrame:
    """Weighted attraction and repulsion: weights ``(exp(-d / sigma) + ctx) / 2``, distances over their row means."""
    both = pairs.select("i", "j", "d").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    mean = both.withColumn("m", F.avg(F.sqrt(F.greatest("d", F.lit(0.0)))).over(Window.partitionBy("i")))
    r = F.sqrt(F.greatest("d", F.lit(0.0))) / F.col("m")
    w = (F.exp(-F.col("d") / sigma) + F.coalesce("ctx", F.lit(0.0))) / 2
    term = w * r * r + (1 - w) * F.pow(F.greatest(delta - r, F.lit(0.0)), F.lit(2))
    return mean.join(ctx, ["i", "j"], "left").agg(F.round(F.avg(term), 6).alias("loss"))


def kl_self_distillation(student: DataFrame, teacher: DataFrame) -> DataFrame:
    """Mean over rows of KL(teacher || student) of softmaxes of negative distances (i, j, d)."""
    def soft(t: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("i")
        e = t.withColumn("e", F.exp(-(F.col("d") - F.min("d").over(w))))
        return e.select("i", "j", (F.col("e") / F.sum("e").over(w)).alias(name))

    p = soft(teacher, "p").join(soft(student, "q"), ["i", "j"])
    rows = p.groupBy("i").agg(F.sum(F.when(F.col("p") > 0, F.col("p") * (F.ln("p") - F.ln("q"))).otherwise(0.0)).alias("k"))
    return rows.agg(F.round(F.avg("k"), 6).alias("kl"))


def neighbour_propagation(near: DataFrame, labels: DataFrame, vectors: DataFrame, vec: str, classes: int, n: int, temperature: float = 0.1, alpha: float = 0.1) -> DataFrame:
    """Per query: class probabilities from its ``n`` anchors by a dense ``(n + 1)``-node solve on transition
    probabilities of inner products, in NumPy per group."""
    import numpy as np
    import pandas as pd

    v = vectors.select(F.col("vec_id").alias("_id"), doubles(vec).alias("_v"))
    anchors = near.where(F.col("rank") <= n).join(v.withColumnsRenamed({"_id": "ref_id", "_v": "rv"}), "ref_id").join(v.withColumnsRenamed({"_id": "query_id", "_v": "qv"}), "query_id")
    anchors = anchors.join(labels.select(F.col("vec_id").alias("ref_id"), "label"), "ref_id")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rank")
        x = np.stack([part["qv"].iloc[0], *part["rv"]])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T / temperature
        np.fill_diagonal(s, -np.inf)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        y = np.zeros((len(x), classes))
        y[np.arange(1, len(x)), part["label"].astype(int)] = 1
        f = np.maximum((1 - alpha) * np.linalg.solve(np.eye(len(x)) - alpha * p, y)[0], 0)
        f = f / f.sum() if f.sum() else f
        return pd.DataFrame({"query_id": [part["query_id"].iloc[0]], "probs": [f.tolist()]})

    return anchors.groupBy("query_id").applyInPandas(solve, "query_id long, probs array<double>")
