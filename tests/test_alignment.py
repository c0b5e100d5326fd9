"""Running distribution alignment: batch fold, stream and a fold by hand agree."""

import json

import numpy as np
import pytest

from shardloom.operators import alignment
from shardloom.streaming.alignment import align_stream


def by_hand(batches, momentum, eps=1e-7):
    mean, out = np.full(batches[0].shape[1], 1 / batches[0].shape[1]), []
    for p in batches:
        r = p / np.maximum(mean, eps)
        out.append(r / np.maximum(r.sum(axis=1, keepdims=True), eps))
        mean = momentum * mean + (1 - momentum) * p.mean(axis=0)
    return out


def draws(n, seed, zero=False):
    rng = np.random.default_rng(seed)
    out = [rng.dirichlet(np.ones(4), rng.integers(1, 5)) for _ in range(n)]
    if zero:
        for p in out:
            p[:, 2] = 0
    return out


def test_first_steps_by_hand():
    a, b = by_hand([np.array([[0.8, 0.2]]), np.array([[0.5, 0.5]])], 0.5)
    assert np.allclose(a, [[0.8, 0.2]]) and np.allclose(b, [[0.35 / (0.35 + 0.65), 0.65]])


@pytest.mark.parametrize(("momentum", "n"), [(0.0, 6), (0.05, 40), (0.5, 120), (0.9, 30)])
def test_batch_fold(spark, momentum, n):
    batches = draws(n, 3, zero=momentum == 0.5)
    rows = [(10 * b, i, p.tolist()) for b, x in enumerate(batches) for i, p in enumerate(x)]  # numbers with gaps keep their order
    got = alignment.distribution_alignment(spark.createDataFrame(rows, "b long, i long, p array<double>").repartition(4), "b", "p", momentum).collect()
    want = by_hand(batches, momentum)
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose(r["aligned"], want[r["b"] // 10][r["i"]], rtol=1e-9, atol=1e-12)


def test_no_rows_and_bad_momentum(spark):
    none = spark.createDataFrame([], "b long, p array<double>")
    assert alignment.distribution_alignment(none, "b", "p", 0.9).collect() == []
    with pytest.raises(ValueError, match="momentum"):
        alignment.distribution_alignment(none, "b", "p", 1.0)


def test_stream_agrees(spark, tmp_path):
    batches = draws(7, 5)
    rows = [{"run": run, "batch": b, "size": len(x), "id": i, "p": p.tolist()} for run in ("a", "b") for b, x in enumerate(batches) for i, p in enumerate(x)]
    order = np.random.default_rng(1).permutation(len(rows))
    (tmp_path / "in").mkdir()
    for k, part in enumerate(np.array_split(order, 4)):  # batches arrive split and out of order
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(rows[i]) for i in part))
    stream = spark.readStream.schema("run string, batch long, size long, id long, p array<double>").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = align_stream(stream, 0.9).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = by_hand(batches, 0.9)
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose(r["aligned"], want[r["batch"]][r["id"]], rtol=1e-12)
