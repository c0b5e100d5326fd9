"""Retrieval metrics over ranked neighbours, a block of queries at a time.

Precision at R looks at a query's first R references, R being its own class's size, so a query needs no deeper ranks than
that (or the largest k). A task holds a block of queries and sees all references once, in id order and in small runs; each
query keeps the scores of its best ones so far and whether they are partners, and nothing else. How many queries make a
block follows from how deep they look, so a task's memory grows neither with the references nor with the classes, and what
leaves it is a row per query. References are stored packed and read by every block's task, without a copy for each on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _cut
from .knn import STEP_QUERIES

#: Bytes of what a block of queries keeps, of a packed row of vectors, and references that are scored at once.
STATE_BYTES, PACK_BYTES, STEP = 160 << 20, 128 << 10, 4096
#: Bytes of a kept reference (a score and whether it is a partner); packed rows that go to Python at once.
SLOT, ROWS_AT_ONCE = 9, 32


def _room(need: np.ndarray) -> np.ndarray:
    """References that a query has room for: what it needs, and what comes until the worst go again."""
    return need + np.maximum(STEP, need // 2)


def _unit(blob: bytes, kind: str, width: int) -> np.ndarray:
    x = np.frombuffer(blob, dtype=kind).reshape(-1, max(1, width)).astype(np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


class Ranking:
    """The best references of each query of a block, as they come in id order."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, need: np.ndarray, same_source: bool):
        self.x, self.ids, self.labels, self.need, self.same_source = x, ids, labels, need, same_source
        ends = np.cumsum(_room(need))
        self.base, self.room = ends - _room(need), _room(need)
        self.scores, self.rel = np.empty(ends[-1]), np.empty(ends[-1], dtype=bool)
        self.fill, self.floor = np.zeros(len(x), dtype=np.int64), np.full(len(x), -np.inf)

    def add(self, y: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        for j in range(0, len(y), STEP):
            for i in range(0, len(self.x), STEP_QUERIES):
                self._tile(slice(i, min(i + STEP_QUERIES, len(self.x))), y[j : j + STEP], ids[j : j + STEP], labels[j : j + STEP])

    def _tile(self, at: slice, y: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        s = self.x[at] @ y.T
        if self.same_source:
            s[self.ids[at, None] == ids[None, :]] = -np.inf
        over = s > self.floor[at, None]  # later ids do not displace equal scores
        partner: dict[int, np.ndarray] = {}
        for i, n in enumerate(np.count_nonzero(over, axis=1).tolist()):
            if not n:
                continue
            k, c = at.start + i, int(self.labels[at.start + i])
            if self.fill[k] + n > self.room[k]:
                self._prune(k)
            if c not in partner:
                partner[c] = labels == c
            to = slice(self.base[k] + self.fill[k], self.base[k] + self.fill[k] + n)
            np.compress(over[i], s[i], out=self.scores[to])
            np.compress(over[i], partner[c], out=self.rel[to])
            self.fill[k] += n

    def _prune(self, k: int) -> None:
        """Leaves the best ``need`` references of a query, of equal ones the first, in the order they came."""
        n, need, base = self.fill[k], self.need[k], self.base[k]
        if n <= need:
            return
        v = self.scores[base : base + n]
        least = np.partition(v, n - need)[n - need]
        keep = v > least
        keep[np.flatnonzero(v == least)[: need - np.count_nonzero(keep)]] = True
        self.scores[base : base + need], self.rel[base : base + need] = np.compress(keep, v), np.compress(keep, self.rel[base : base + n])
        self.fill[k], self.floor[k] = need, least

    def partners(self) -> Iterator[tuple[int, np.ndarray]]:
        """For each query how many references it ranked, and the ranks of its partners among them, ascending."""
        for k in range(len(self.x)):
            self._prune(k)
            n, base = self.fill[k], self.base[k]
            v, rel = self.scores[base : base + n], self.rel[base : base + n]
            up = np.sort(v)
            if (up[1:] == up[:-1]).any():
                yield n, np.flatnonzero(rel[np.argsort(-v, kind="stable")]) + 1
            else:
                yield n, n - np.searchsorted(up, np.sort(v[rel])[::-1])


def _packed(rows: DataFrame, key: str, kind: str, width: int, size: int) -> DataFrame:
    """Runs of at most ``size`` rows of one ``key``, in the order of the rows' partitions: (key, ids, labels, needs, vectors)."""
    schema = f"{key} long, ids binary, labels binary, needs binary, vectors binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column("_key").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                while a < b:
                    held = sum(x.num_rows for x in kept)
                    if held and (kept[0].column("_key")[0].as_py() != keys[a] or held == size):
                        yield blob(kept)
                        kept, held = [], 0
                    c = min(b, a + size - held)
                    kept.append(batch.slice(a, c - a))
                    a = c
        if kept:
            yield blob(kept)

    def blob(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
        if len(flat) != t.num_rows * width:
            raise ValueError("vectors of several lengths")
        cells = [t.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "_label", "_need")]
        first = t.column("_key")[0].as_py() if key == "block" else t.column("id")[0].as_py()
        return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), *[pa.array([c], pa.binary()) for c in (*cells, flat.tobytes())]], names=["_k", "ids", "labels", "needs", "vectors"])

    return rows.mapInArrow(run, schema.replace(key, "_k", 1)).withColumnRenamed("_k", key)


def _ranked(queries: DataFrame, refs: DataFrame, vec: str, label: str, least: int, id_col: str, same_source: bool, give: Callable, schema: str) -> DataFrame:
    """What ``give`` makes (query ids, labels' hashes, r, :class:`Ranking`) of each block of queries, with ``label``; stored."""
    spark = refs.sparkSession
    size = refs.where(F.col(label).isNotNull()).groupBy(label).agg((F.count(F.lit(1)) - (1 if same_source else 0)).alias("_r")).where("_r > 0")
    classes = _cut(size.withColumn("_label", F.xxhash64(label)))
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"), label).join(classes, label).withColumn("_need", F.greatest("_r", F.lit(least)).cast("long"))
    total, n = q.agg(F.sum(F.col("_need") + F.greatest(F.lit(STEP), F.floor(F.col("_need") / 2))), F.count(F.lit(1))).first()
    width = refs.agg(F.max(F.size(vec))).first()[0] or 0
    kind = "<f4" if dict(queries.dtypes)[vec] == dict(refs.dtypes)[vec] == "array<float>" else "<f8"
    blocks = max(1, -(-(total or 0) * SLOT // STATE_BYTES), min(n, 3 * spark.sparkContext.defaultParallelism))
    left = q.select("id", "v", "_label", F.col("_r").alias("_need"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("_key"))
    left = _packed(left.repartition(blocks, "_key").sortWithinPartitions("_key", "id"), "block", kind, width, 1 << 30)
    right = refs.select(F.col(id_col).cast("long").alias("id"), F.col(vec).alias("v"), F.when(F.col(label).isNotNull(), F.xxhash64(label)).otherwise(F.lit(0)).alias("_label"), F.lit(0).cast("long").alias("_need"), F.lit(0).cast("long").alias("_key"))
    size_of = np.dtype(kind).itemsize * max(1, width)
    right = _cut(_packed(right.orderBy("id"), "first", kind, width, max(1, PACK_BYTES // size_of)).drop("needs"))
    right = right.repartition(1).sortWithinPartitions("first").select(*[F.col(c).alias(f"ref_{c}") for c in ("ids", "labels", "vectors")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, waiting = None, None, []

        def add() -> None:
            if waiting:
                ids, labels = (np.frombuffer(b"".join(w[i] for w in waiting), dtype=np.int64) for i in (0, 1))
                state.add(_unit(b"".join(w[2] for w in waiting), kind, width), ids, labels)
                waiting.clear()

        def done() -> Iterator[pa.RecordBatch]:
            add()
            yield from give(state.ids, state.labels, r, state)

        for batch in batches:
            keys = batch.column("block").to_pylist()
            for k, key in enumerate(keys):
                if key != at:
                    if state is not None:
                        yield from done()
                    ids, labels, r = (np.frombuffer(batch.column(c)[k].as_buffer(), dtype=np.int64).copy() for c in ("ids", "labels", "needs"))
                    at, state = key, Ranking(_unit(batch.column("vectors")[k].as_buffer(), kind, width), ids, labels, np.maximum(r, least), same_source)
                waiting.append([batch.column(c)[k].as_py() for c in ("ref_ids", "ref_labels", "ref_vectors")])
                if sum(len(w[0]) for w in waiting) >= 8 * STEP:
                    add()
        if state is not None:
            yield from done()

    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(conf)
    spark.conf.set(conf, str(ROWS_AT_ONCE))  # packed rows are large
    try:
        made = _cut(pairs.mapInArrow(run, schema))
    finally:
        spark.conf.set(conf, was)
    return made.join(classes.select("_label", F.col(label).alias("label"), F.col("_r").alias("r")), "_label")


def ranked_hits(queries: DataFrame, refs: DataFrame, vec: str, label: str, least: int, id_col: str = "vec_id", same_source: bool = True) -> DataFrame:
    """(query_id, label, r, rank, rel, cum): the first ``max(r, least)`` references of each query that has ``r > 0``
    partners, by cosine, ties to the lower id; ``rel`` is 1 for a partner and ``cum`` counts those so far. Null labels have
    no partners."""

    def give(ids: np.ndarray, labels: np.ndarray, r: np.ndarray, state: Ranking) -> Iterator[pa.RecordBatch]:
        for k, (n, ranks) in enumerate(state.partners()):
            rel = np.zeros(n, dtype=np.int32)
            rel[ranks - 1] = 1
            yield pa.RecordBatch.from_pydict({"query_id": np.full(n, ids[k]), "_label": np.full(n, labels[k]), "rank": np.arange(1, n + 1), "rel": rel, "cum": np.cumsum(rel, dtype=np.int64)})

    rows = _ranked(queries, refs, vec, label, least, id_col, same_source, give, "query_id long, _label long, rank long, rel int, cum long")
    return rows.select("query_id", "label", "r", "rank", "rel", "cum")


def query_metrics(queries: DataFrame, refs: DataFrame, vec: str, label: str, id_col: str = "vec_id", ks: tuple[int, ...] = (1, 5, 10), same_source: bool = True) -> DataFrame:
    """Per eligible query: precision_at_1, map_at_r, r_precision and hit_at_k. Queries without a partner are left out."""
    names = ["precision_at_1", "map_at_r", "r_precision", *[f"hit_at_{k}" for k in ks if k > 1]]

    def give(ids: np.ndarray, labels: np.ndarray, r: np.ndarray, state: Ranking) -> Iterator[pa.RecordBatch]:
        out = np.empty((len(ids), len(names)))
        for k, (_, ranks) in enumerate(state.partners()):
            inside = ranks[: np.searchsorted(ranks, r[k], side="right")]
            out[k, :3] = len(ranks) > 0 and ranks[0] == 1, (np.arange(1, len(inside) + 1) / inside).sum() / r[k], len(inside) / r[k]
            out[k, 3:] = [len(ranks) > 0 and ranks[0] <= m for m in ks if m > 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), *[pa.array(out[:, i]) for i in range(len(names))]], names=["query_id", "_label", *names])

    rows = _ranked(queries, refs, vec, label, max(ks), id_col, same_source, give, "query_id long, _label long, " + ", ".join(f"{c} double" for c in names))
    return rows.select("query_id", "label", *names)


def averaged(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    names = [c for c in metrics.columns if c not in ("query_id", "label")]
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("num_queries"), *[F.round(F.avg(c), 6).alias(c) for c in names])


def class_summary(per_class: DataFrame, metric: str, weight: str) -> DataFrame:
    """Count-weighted and plain mean of finite class values, with extremes and population deviation."""
    ok = per_class.where(~F.isnan(metric))
    return ok.agg(
        F.round(F.sum(F.col(weight) * F.col(metric)) / F.sum(weight), 6).alias("weighted"), F.round(F.avg(metric), 6).alias("macro"),
        F.round(F.min(metric), 6).alias("min"), F.round(F.max(metric), 6).alias("max"), F.round(F.stddev_pop(metric), 6).alias("std"),
    )
