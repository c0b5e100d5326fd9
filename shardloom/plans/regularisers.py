"""Regularisers: named terms over unlabelled rows that are added to a supervised loss.

A plug-in has three hooks, each giving a DataFrame: ``dataset`` (what it works on, from labelled and unlabelled rows),
``batches`` (that with a column ``batch``) and ``objective`` (a row a batch: batch, n, loss). :func:`total` runs them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGISTRY: dict[str, type[Regulariser]] = {}


class Regulariser:
    """Base of plug-ins; weights are finite, not negative and not both zero."""

    name = ""

    def __init__(self, weight: float = 1.0, supervised_weight: float = 1.0):
        for what, w in (("weight", weight), ("supervised_weight", supervised_weight)):
            if not math.isfinite(w) or w < 0:
                raise ValueError(f"{what} must be finite and not negative")
        if weight == 0 and supervised_weight == 0:
            raise ValueError("weight and supervised_weight cannot both be zero")
        self.weight, self.supervised_weight = float(weight), float(supervised_weight)

    def dataset(self, labelled: DataFrame, unlabelled: DataFrame) -> DataFrame:
        return unlabelled

    def batches(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("batch", F.lit(0).cast("long"))

    def objective(self, batches: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{type(self).__name__} has no objective")


def regulariser(name: str) -> Callable[[type[Regulariser]], type[Regulariser]]:
    """Registers a plug-in class; a name is taken once, and its three hooks must be there."""

    def put(kind: type[Regulariser]) -> type[Regulariser]:
        if name in REGISTRY:
            raise ValueError(f"regulariser {name!r} exists")
        if kind.objective is Regulariser.objective:
            raise TypeError(f"regulariser {name!r} has no objective")
        kind.name = name
        REGISTRY[name] = kind
        return kind

    return put


def get(name: str, **options) -> Regulariser:
    if name not in REGISTRY:
        raise ValueError(f"unknown regulariser {name!r}; known: {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](**options)


def total(plugin: Regulariser, labelled: DataFrame, unlabelled: DataFrame, supervised: DataFrame) -> DataFrame:
    """(name, supervised, regularisation, total) with ``supervised`` a row with ``loss``; batches count by their ``n``.
    A weight of zero leaves its side out of the plan: it is null, and nothing of it is read."""
    s = supervised.agg(F.first("loss").cast("double").alias("supervised")) if plugin.supervised_weight else None
    r = None
    if plugin.weight:
        made = plugin.objective(plugin.batches(plugin.dataset(labelled, unlabelled)))
        r = made.agg((F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("regularisation"))
    rows = s.crossJoin(r) if s is not None and r is not None else s if r is None else r  # one row each
    side = lambda df, name: F.col(name) if df is not None else F.lit(None).cast("double").alias(name)
    sums = [F.lit(w) * F.col(n) for df, w, n in ((s, plugin.supervised_weight, "supervised"), (r, plugin.weight, "regularisation")) if df is not None]
    return rows.select(F.lit(plugin.name).alias("name"), side(s, "supervised"), side(r, "regularisation"), (sums[0] + sums[1] if len(sums) > 1 else sums[0]).alias("total"))


@regulariser("laplacian")
class Laplacian(Regulariser):
    """Mean energy of the unlabelled rows' neighbour graph, over all its edges."""

    def __init__(self, neighbours: int = 10, **weights: float):
        super().__init__(**weights)
        self.neighbours = neighbours

    def objective(self, batches: DataFrame) -> DataFrame:
        from ..operators import graph
        from ..operators.knn import knn

        edges = graph.binary_graph(knn(batches, batches, "embedding", self.neighbours))
        return graph.energy(edges, batches, "embedding").select(F.lit(0).alias("batch"), F.col("edges").alias("n"), F.col("mean_energy").alias("loss"))


@regulariser("pair_entropy")
class PairEntropy(Regulariser):
    """Binary entropy of pairs with an unlabelled row, in batches of consecutive ids; the midpoint is the labelled rows'."""

    def __init__(self, temperature: float = 0.5, band: float | None = None, size: int = 256, fallback: float = 1.0, **weights: float):
        super().__init__(**weights)
        self.temperature, self.band, self.size, self.fallback = temperature, band, size, fallback

    def dataset(self, labelled: DataFrame, unlabelled: DataFrame) -> DataFrame:
        free = unlabelled.withColumn("label", F.lit(None).cast("long"))
        return labelled.select("vec_id", "embedding", F.col("label").cast("long").alias("label")).unionByName(free.select("vec_id", "embedding", "label"))

    def batches(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("batch", F.floor(F.col("vec_id") / self.size))

    def objective(self, batches: DataFrame) -> DataFrame:
        from ..operators import pair_trace as T

        eta = T.midpoint(batches, "embedding", self.fallback)
        inside = T.block_trace(batches, "embedding", eta, self.temperature, self.band, width=self.size, within=True)
        n = F.sum("selected")
        return inside.groupBy(F.col("left_block").alias("batch")).agg(n.alias("n"), F.coalesce(F.sum(F.col("selected") * F.col("mean_entropy")) / n, F.lit(0.0)).alias("loss"))
