"""Metric logs as streams: windowed summaries with a watermark, and early stopping with state per run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and extremes per key and tumbling window; works on batch tables too."""
    s = stream.withWatermark(ts, late) if stream.isStreaming else stream
    out = s.groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("window_start"), key, "n", "mean", "min", "max")


def early_stopping(stream: DataFrame, run: str, epoch: str, value: str, patience: int) -> DataFrame:
    """(run, epoch, best, stopped) for each arriving row; best and the wait are state of the run."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, wait = state.get if state.exists else (float("-inf"), 0)
        for p in parts:
            rows = []
            for e, v in p.sort_values(epoch)[[epoch, value]].itertuples(index=False):
                if wait < patience:
                    best, wait = (v, 0) if v > best else (best, wait + 1)
                rows.append((key[0], e, best, wait >= patience))
            yield pd.DataFrame(rows, columns=["run", "epoch", "best", "stopped"])
        state.update((best, wait))

    kind = dict(stream.dtypes)
    return stream.groupBy(run).applyInPandasWithState(step, f"run {kind[run]}, epoch {kind[epoch]}, best double, stopped boolean", "best double, wait int", "append", "NoTimeout")
