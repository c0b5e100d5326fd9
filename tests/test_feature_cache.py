"""Claims, the study's cache and the feature cache: counters, sessions at once, failures, leases."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from shardloom.sources.claims import Claims, Store
from shardloom.sources.feature_cache import FeatureCache, StudyCache


def doubled(calls):
    def compute(rows):
        calls.append(rows.count())
        return rows.select("key", F.array(F.length("t").cast("double") * 2).alias("feature"))

    return compute


def batch(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")


def test_counters_of_one_session(spark, tmp_path):
    calls = []
    cache = FeatureCache(spark, str(tmp_path), doubled(calls))
    two = batch(spark, ["a", "bb"])
    first, second = cache.get(two, "t").collect(), cache.get(two, "t").collect()
    assert sorted(first) == sorted(second) and {r["t"]: r["feature"] for r in first} == {"a": [2.0], "bb": [4.0]}
    cache.get(two, "t")
    assert calls == [2]
    assert cache.stats == {"fully_cached_batches": 2, "batches_with_misses": 1, "hit_samples": 4, "memory_hit_samples": 4, "disk_hit_samples": 0, "miss_samples": 2, "written_samples": 2}


def test_sessions_after_each_other_share_the_store(spark, tmp_path):
    calls = []
    FeatureCache(spark, str(tmp_path), doubled(calls)).get(batch(spark, ["a", "bb"]), "t")
    later = FeatureCache(spark, str(tmp_path), doubled(calls))
    later.get(batch(spark, ["a", "bb"]), "t")
    assert calls == [2] and (later.stats["hit_samples"], later.stats["memory_hit_samples"], later.stats["disk_hit_samples"]) == (2, 0, 2)
    other = FeatureCache(spark, str(tmp_path), doubled(calls), version="2")
    other.get(batch(spark, ["a"]), "t")
    assert other.stats["miss_samples"] == 1


def test_overlapping_batches_copies_and_nulls(spark, tmp_path):
    calls = []
    cache = FeatureCache(spark, str(tmp_path), doubled(calls))
    cache.get(batch(spark, ["a", "bb"]), "t")
    cache.get(batch(spark, ["bb", "ccc"]), "t")
    assert calls == [2, 1] and (cache.stats["hit_samples"], cache.stats["miss_samples"], cache.stats["written_samples"]) == (1, 3, 3)
    got = cache.get(batch(spark, ["dd", "dd", None, None, "null"]), "t")
    assert got.count() == 5 and calls[2:] == [3] and cache.stats["written_samples"] == 6
    assert cache.get(batch(spark, []), "t").count() == 0


def test_sessions_at_once_compute_a_content_once(spark, tmp_path):
    calls, caches = [], []

    def slow(rows):
        time.sleep(1)
        return doubled(calls)(rows)

    def session(texts):
        c = FeatureCache(spark, str(tmp_path), slow, poll=0.05)
        caches.append(c)
        c.get(batch(spark, texts), "t").collect()

    texts = ["x" * k for k in range(1, 30)]
    threads = [threading.Thread(target=session, args=(t,)) for t in (texts, texts[10:] + ["new"], texts[::-1])]
    [t.start() for t in threads]
    [t.join(180) for t in threads]
    assert sum(calls) == 30 == sum(c.stats["written_samples"] for c in caches)
    assert not Store(spark, f"{tmp_path}/v1").names("claims")


def frame(spark, n):
    return spark.range(n)


def test_study_computes_a_key_once(spark, tmp_path):
    made = []

    def compute():
        made.append(1)
        time.sleep(1.5)
        return frame(spark, 7)

    caches = [StudyCache(spark, str(tmp_path), poll=0.05) for _ in range(2)]
    got, threads = [], []
    for c in (caches[0], caches[0], caches[1]):
        threads.append(threading.Thread(target=lambda c=c: got.append(c.get_or_compute("k", compute).count())))
        threads[-1].start()
        time.sleep(0.3)
    [t.join(120) for t in threads]
    assert got == [7, 7, 7] and made == [1]
    assert caches[0].get_or_compute("k", compute).count() == 7
    a, b = caches[0].stats(), caches[1].stats()
    assert (a["entries"], a["hits"], a["misses"], a["waits"]) == (1, 1, 1, 1) and a["bytes"] > 0
    assert (b["hits"], b["misses"], b["waits"]) == (0, 0, 1)


def test_failed_work_is_done_by_one_that_waits(spark, tmp_path):
    begun, errors, got = threading.Event(), [], []

    def bad():
        begun.set()
        time.sleep(1)
        raise RuntimeError("no features")

    def first():
        try:
            StudyCache(spark, str(tmp_path), poll=0.05).get_or_compute("k", bad)
        except RuntimeError as e:
            errors.append(str(e))

    t = threading.Thread(target=first)
    t.start()
    begun.wait(30)
    second = StudyCache(spark, str(tmp_path), poll=0.05)
    got = second.get_or_compute("k", lambda: frame(spark, 3)).count()
    t.join(60)
    assert errors == ["no features"] and got == 3 and second.stats()["misses"] == 1


def test_lapsed_claims_pass_on_and_live_ones_are_renewed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    gone, live = Claims(store, lease=0.5), Claims(store, lease=0.5)
    assert gone.take("c") and not live.take("c")
    time.sleep(0.8)
    assert live.take("c") and live.mine("c") and not gone.mine("c")
    gone.release("c")
    assert store.exists("c")
    with live.held("c"):
        time.sleep(1.2)
        assert not gone.take("c")
    assert not store.exists("c") and gone.take("c")


def test_one_of_many_claims(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    won, start = [], threading.Barrier(8)

    def contender():
        c = Claims(store)
        start.wait()
        won.append(c.take("only"))

    threads = [threading.Thread(target=contender) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(won) == 1
    assert store.read("only") and store.read("other") is None and store.age("other") is None and not store.move("other", "x")
    with pytest.raises(Exception):  # noqa: B017
        store.size("other")
