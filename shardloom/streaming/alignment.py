"""Distribution alignment in a stream, its running mean as state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EPS = 1e-7


def align_stream(rows: DataFrame, momentum: float, eps: float = EPS) -> DataFrame:
    """(run, batch, id, aligned) from a stream of (run, batch, size, id, p): batches of a run are numbered from 0 and have
    ``size`` rows each.

    State per run: the running mean, the next batch's number and the rows that came early. A batch is aligned once it is
    whole and all before it were, whatever micro-batches its rows arrive in; then the mean moves on. Rows of batches that
    are over are late repeats and are left out.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, at, early = state.get if state.exists else ([], 0, "[]")
        waiting: dict[int, list] = {}
        for batch, size, i, p in json.loads(early):
            waiting.setdefault(batch, []).append((size, i, p))
        for part in parts:
            for batch, size, i, p in part[["batch", "size", "id", "p"]].itertuples(index=False):
                if batch >= at:
                    waiting.setdefault(int(batch), []).append((int(size), int(i), [float(x) for x in p]))
        while len(own := waiting.get(at, [])) >= (own[0][0] if own else 1):
            p = np.array([x for *_, x in own])
            m = np.array(mean) if len(mean) else np.full(p.shape[1], 1 / p.shape[1])
            ratio = p / np.maximum(m, eps)
            out = ratio / np.maximum(ratio.sum(axis=1, keepdims=True), eps)
            yield pd.DataFrame({"run": key[0], "batch": at, "id": [i for _, i, _ in own], "aligned": list(out)})
            mean = (momentum * m + (1 - momentum) * p.mean(axis=0)).tolist()
            del waiting[at]
            at += 1
        state.update((mean, at, json.dumps([(b, *r) for b, rows in waiting.items() for r in rows])))

    schema = "run string, batch long, id long, aligned array<double>"
    return rows.groupBy("run").applyInPandasWithState(step, schema, "mean array<double>, at long, early string", "append", GroupStateTimeout.NoTimeout)
