"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

``y = w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``: all pairwise interactions in time linear
in the features of a document (the sum-of-squares identity). Words are presence features, scaled to unit length;
structure statistics come as standardised values and as quantile indicators, so that their interactions are learned too.

Training takes at most ``MAX_TRAIN`` labelled rows (those of smallest id hash), whose sparse features, not texts, reach
the driver; the model has a fixed size. Scoring is one pass without a shuffle over every whole text.
Labels, language, source and id are never inputs of a score. Defined cases: null text counts as empty; an empty text is
scored by its statistics; without labels of both kinds every score is the share of label 1 (0.5 without labels);
repeated rows get equal scores; rows of a null id are in the held-out fold; of labels with one id the highest counts, of
documents with one id the one of least text hash trains; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

MAX_TRAIN = 8000
BITS = 14
FACTORS = 8
BUCKETS = 10
THRESHOLD = 0.3
FOLDS = 5
MODEL_SCHEMA = "score double, predicted int"

_CLASS = np.zeros(256, dtype=np.int64)  # 1 lower, 2 upper, 3 digit, 4 white space, 5 other ASCII, 6 not ASCII
_CLASS[:] = 5
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
N_STATS = 22


def features(text: str, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their values, and the statistics of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n, distinct = len(words), set(words)
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=7)
    size, solid = max(1, len(data)), max(1.0, len(data) - kinds[4])
    lines = data.split(b"\n")
    seen = set(lines)
    long_lines = [x for x in lines if len(x) >= 20]
    tail = np.bincount([w[-1] for w in words], minlength=256) if n else np.zeros(256, dtype=np.int64)
    odd_tail = int(tail.sum() - tail[97:123].sum() - tail[65:91].sum() - tail[48:58].sum() - tail[128:].sum())
    most = max(tail[33:48].max(initial=0), tail[58:65].max(initial=0), tail[91:97].max(initial=0), tail[123:127].max(initial=0))
    stats = np.array([
        np.log1p(len(data)), np.log1p(n), solid / max(1, n), kinds[2] / solid, kinds[3] / solid, kinds[5] / solid, kinds[6] / solid,
        counts[33] / solid, counts[[35, 36, 37, 38, 42, 94, 126]].sum() / solid, counts[124] / solid, counts[[60, 62, 123, 125, 61, 47, 92]].sum() / solid,
        (counts[44] + counts[46]) / solid, len(distinct) / max(1, n), len(seen) / len(lines), np.log1p(len(lines)), n / len(lines),
        1 - len(set(long_lines)) / max(1, len(long_lines)), odd_tail / max(1, n), most / max(1, n), counts[64] / max(1, n), np.log1p(kinds[4]) - np.log1p(n),
        np.log1p(max(0.0, float(n_chars if n_chars is not None and n_chars == n_chars else len(text)))),
    ])
    idx = np.fromiter((zlib.crc32(w) for w in distinct), dtype=np.int64, count=len(distinct)) & ((1 << BITS) - 1)
    idx.sort()
    return idx, np.full(len(idx), 1.0 / np.sqrt(max(1, len(idx)))), stats


class FactorisationMachine:
    """Trained by AdaGrad on the logistic loss, in a fixed order from a fixed seed."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.size = (1 << BITS) + N_STATS * (1 + BUCKETS)
        self.w0, self.w = 0.0, np.zeros(self.size)
        self.v = rng.normal(0, 0.02, (self.size, FACTORS))
        self.constant: float | None = None
        self.edges = np.zeros((N_STATS, BUCKETS - 1))
        self.mean, self.std = np.zeros(N_STATS), np.ones(N_STATS)

    def row(self, idx: np.ndarray, val: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.std, -4, 4)
        at = np.arange(N_STATS)
        bucket = (stats[:, None] > self.edges).sum(axis=1)
        more = np.concatenate([(1 << BITS) + at, (1 << BITS) + N_STATS + at * BUCKETS + bucket])
        return np.concatenate([idx, more]), np.concatenate([val, 0.3 * z, np.full(N_STATS, 0.5)])

    def fit(self, rows: list[tuple], labels: np.ndarray, steps: int = 800, batch: int = 64, rate: float = 0.05) -> None:
        """About ``steps`` batches: 6 passes at least and 60 at most."""
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return
        stats = np.array([r[2] for r in rows])
        self.mean, self.std = stats.mean(axis=0), stats.std(axis=0) + 1e-9
        self.edges = np.quantile(stats, np.linspace(0, 1, BUCKETS + 1)[1:-1], axis=0).T
        made = [self.row(*r) for r in rows]
        rate_1 = labels.mean()
        self.w0 = float(np.log(rate_1 / (1 - rate_1)))
        gw, gv, g0 = np.full(self.size, 1e-3), np.full((self.size, FACTORS), 1e-3), 1e-3
        rng = np.random.default_rng(11)
        for _ in range(min(60, max(6, -(-steps * batch // len(made))))):
            order = rng.permutation(len(made))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                lens = np.array([len(made[i][0]) for i in some])
                idx, x = np.concatenate([made[i][0] for i in some]), np.concatenate([made[i][1] for i in some])
                starts, of = np.cumsum(lens) - lens, np.repeat(np.arange(len(some)), lens)
                vx = self.v[idx] * x[:, None]
                s = np.add.reduceat(vx, starts)
                y = self.w0 + np.add.reduceat(self.w[idx] * x, starts) + 0.5 * (s**2 - np.add.reduceat(vx**2, starts)).sum(axis=1)
                d = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[some]) / len(some)
                dx = d[of] * x
                grad_v = dx[:, None] * (s[of] - vx)
                sort = np.argsort(idx, kind="stable")
                uniq, first = np.unique(idx[sort], return_index=True)
                u = np.add.reduceat(dx[sort], first) + 1e-6 * self.w[uniq]
                uv = np.add.reduceat(grad_v[sort], first) + 1e-6 * self.v[uniq]
                gw[uniq] += u**2
                gv[uniq] += uv**2
                g0 += d.sum() ** 2
                self.w[uniq] -= rate * u / np.sqrt(gw[uniq])
                self.v[uniq] -= rate * uv / np.sqrt(gv[uniq])
                self.w0 -= rate * d.sum() / np.sqrt(g0)

    def score(self, text: str, n_chars: float | None = None) -> float:
        if self.constant is not None:
            return self.constant
        idx, x = self.row(*features(text, n_chars))
        vx = self.v[idx] * x[:, None]
        y = self.w0 + self.w[idx] @ x + 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, y)))))


def fold(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> FactorisationMachine:
    """Fits on labelled rows outside the held-out fold, at most ``MAX_TRAIN``, in the order of their ids' hashes."""
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("label_id"), F.col("quality").cast("double").alias("label"))
        .where(F.col("label").isNotNull() & F.col("label_id").isNotNull())
        .where(fold("label_id") != 0)
        .groupBy("label_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(MAX_TRAIN)
    )
    metadata = F.col("n_chars").cast("double") if "n_chars" in df.columns else F.lit(None).cast("double")
    docs = df.select(F.col(id_col).cast("long").alias("label_id"), text_of(text_col).alias("text"), metadata.alias("n_chars"))
    one = F.min_by(F.struct("text", "n_chars"), F.struct(F.xxhash64("text"), "text", "n_chars")).alias("doc")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            made = [features(t, n) for t, n in zip(p["text"], p["n_chars"], strict=True)]
            yield pd.DataFrame({
                "label_id": p["label_id"], "label": p["label"],
                "idx": [m[0].astype("<i4").tobytes() for m in made], "stats": [m[2].tobytes() for m in made],
            })

    matched = docs.join(F.broadcast(chosen), "label_id").groupBy("label_id", "label").agg(one).select("label_id", "label", "doc.*")
    got = matched.mapInPandas(rows, "label_id long, label double, idx binary, stats binary").collect()
    got.sort(key=lambda r: r["label_id"])
    made = []
    for r in got:
        idx = np.frombuffer(r["idx"], dtype="<i4").astype(np.int64)
        made.append((idx, np.full(len(idx), 1.0 / np.sqrt(max(1, len(idx)))), np.frombuffer(r["stats"])))
    model = FactorisationMachine()
    model.fit(made, np.array([r["label"] for r in got]))
    return model


def score(df: DataFrame, model: FactorisationMachine, text_col: str = "text") -> DataFrame:
    """``df``'s columns as ``row``, with score and predicted."""
    spark, threshold = df.sparkSession, THRESHOLD
    shared = spark.sparkContext.broadcast(model)  # of fixed size
    metadata = F.col("n_chars").cast("double") if "n_chars" in df.columns else F.lit(None).cast("double")

    @F.pandas_udf("double")
    def of(text: pd.Series, n: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t, c) for t, c in zip(text, n, strict=True)], dtype="float64")

    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), of(text_of(text_col), metadata).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(F.col("row.doc_id").alias("doc_id"), (fold("row.doc_id") == 0).alias("held_out"), "score", "predicted")
