"""Feature caches on a shared store: whole results of a study, and features of single rows by content.

Both survive the session and are safe among sessions that run at once: what is missing is claimed (:mod:`.claims`) before
it is computed, and what others are computing is waited for. A result counts once its mark is there, so what a lost session
has left half written is never read.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .claims import Claims, Store

SHARDS = 16


class StudyCache:
    """Datasets by key, computed once for all trials and sessions of a study.

    ``stats()``: ``hits`` (found ready at the first look), ``misses`` (computed here), ``waits`` (another one's work was
    waited for), and the store's ``entries`` and ``bytes``.
    """

    def __init__(self, spark: SparkSession, path: str, lease: float = 600.0, poll: float = 0.2):
        self.spark, self.store = spark, Store(spark, path)
        self.claims = Claims(self.store, lease, poll)
        self.counts = {"hits": 0, "misses": 0, "waits": 0}
        self._lock = threading.Lock()
        self._here: dict[str, threading.Lock] = {}

    def _count(self, what: str) -> None:
        with self._lock:
            self.counts[what] += 1

    def _ready(self, key: str) -> DataFrame | None:
        at = self.store.read(f"{key}/done")
        return self.spark.read.parquet(f"{self.store.root}/{key}/{at}") if at else None

    def get_or_compute(self, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
        """The dataset of ``key``. If ``compute`` fails the claim goes, the error is raised here, and one of those that wait
        computes instead."""
        found = self._ready(key)
        if found is not None:
            self._count("hits")
            return found
        with self._lock:
            here = self._here.setdefault(key, threading.Lock())
        waited = not here.acquire(blocking=False)
        if waited:  # another thread of this session
            self._count("waits")
            here.acquire()
        try:
            while True:
                found = self._ready(key)
                if found is not None:
                    if not waited:
                        self._count("hits")
                    return found
                if self.claims.take(f"{key}/claim"):
                    break
                if not waited:
                    waited = True
                    self._count("waits")
                time.sleep(self.claims.poll)
            with self.claims.held(f"{key}/claim"):
                found = self._ready(key)  # finished between the look and the claim
                if found is not None:
                    return found
                self._count("misses")
                folder = f"data-{uuid.uuid4().hex}"
                compute().write.parquet(f"{self.store.root}/{key}/{folder}")
                self.store.create(f"{key}/done", folder)  # a slower owner whose lease ran out finds it taken
            return self._ready(key)
        finally:
            here.release()

    def stats(self) -> dict[str, int]:
        done = [(n, at) for n in self.store.names() if (at := self.store.read(f"{n}/done"))]
        with self._lock:
            return {"entries": len(done), **self.counts, "bytes": sum(self.store.size(f"{n}/{at}") for n, at in done)}


@dataclass
class FeatureCache:
    """Features of rows by their content, for one ``version`` of what computes them.

    A batch's unknown contents are computed once each. Batches of different sessions meet in ``SHARDS`` shards of the key
    space: a session claims the shards that it lacks something of in ascending order, looks again, computes what is still
    missing of them in one job, and appends it, so a content is computed by one session only. ``stats`` counts rows:
    hits in what this session has read or made before (``memory``) and in the store (``disk``), misses, and distinct
    contents written; and batches with and without misses. Null contents are a content of their own.
    """

    spark: SparkSession
    path: str
    compute: Callable[[DataFrame], DataFrame]
    version: str = "1"
    lease: float = 600.0
    poll: float = 0.2
    stats: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("fully_cached_batches", "batches_with_misses", "hit_samples", "memory_hit_samples", "disk_hit_samples", "miss_samples", "written_samples"), 0))

    def __post_init__(self) -> None:
        self.store = Store(self.spark, f"{self.path.rstrip('/')}/v{self.version}")
        self.claims = Claims(self.store, self.lease, self.poll)
        self._own = Store(self.spark, f"{self.store.root}/sessions/{self.claims.owner}")

    def _key(self, content: str):
        return F.sha2(F.concat(F.lit(f"{self.version}:"), F.coalesce(F.concat(F.lit("="), F.col(content).cast("string")), F.lit("null"))), 256)

    def _known(self) -> DataFrame:
        """(key, feature, shard) of everything marked as done."""
        parts = [f"{self.store.root}/data/{n}" for n in self.store.names("data") if self.store.exists(f"data/{n}/_SUCCESS")]
        if not parts:
            return self.spark.createDataFrame([], "key string, feature array<double>")
        # a session that lost its lease may have written what its successor wrote too
        return self.spark.read.parquet(*parts).dropDuplicates(["key"])

    def _seen(self) -> DataFrame:
        parts = [f"{self._own.root}/{n}" for n in self._own.names()]
        return self.spark.read.parquet(*parts).distinct() if parts else self.spark.createDataFrame([], "key string")

    def get(self, batch: DataFrame, content: str) -> DataFrame:
        """``batch`` with ``key`` and ``feature``; ``compute`` gets (key, content) and gives (key, feature)."""
        keyed = batch.withColumn("key", self._key(content))
        distinct = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first(content).alias(content)).withColumn("shard", F.conv(F.substring("key", 1, 4), 16, 10).cast("long") % SHARDS)
        seen, known = self._seen().withColumn("memory", F.lit(True)), self._known().select("key", F.lit(True).alias("disk"))
        state = distinct.join(seen, "key", "left").join(known, "key", "left")
        rows = lambda c: F.coalesce(F.sum(F.when(F.expr(c), F.col("n"))), F.lit(0)).alias("n")
        memory, disk, miss, shards = state.agg(rows("memory is not null"), rows("memory is null and disk is not null"), rows("disk is null"), F.array_sort(F.collect_set(F.when(F.col("disk").isNull(), F.col("shard"))))).first()
        s = self.stats
        s["memory_hit_samples"] += memory
        s["disk_hit_samples"] += disk
        s["hit_samples"] += memory + disk
        s["miss_samples"] += miss
        s["batches_with_misses" if miss else "fully_cached_batches"] += 1
        if shards:
            s["written_samples"] += self._fill(distinct.drop("n"), content, shards)
        distinct.select("key").write.parquet(f"{self._own.root}/{uuid.uuid4().hex}")
        return keyed.join(self._known(), "key")

    def _fill(self, distinct: DataFrame, content: str, shards: list[int]) -> int:
        from contextlib import ExitStack

        with ExitStack() as claimed:
            for k in shards:  # ascending in every session, so none waits for one that waits for it
                while not self.claims.take(f"claims/{k}"):
                    time.sleep(self.poll)
                claimed.enter_context(self.claims.held(f"claims/{k}"))
            lacking = distinct.where(F.col("shard").isin(shards)).join(self._known().select("key"), "key", "left_anti")
            at = f"{self.store.root}/data/{uuid.uuid4().hex}"
            self.compute(lacking.select("key", content)).select("key", F.col("feature").cast("array<double>").alias("feature")).write.parquet(at)
            return self.spark.read.parquet(at).count()
