"""Mixing sources to target weights by Sainte-Lague apportionment.

Equal-token blocks are allocated to sources by highest quotients ``target / (2 q + 1)`` and, within a source, to its
shards alike (by their words; shards beyond ``SHARDS`` come in parts, which are dealt to first), never beyond
``max_epochs`` times what is there. A block has ``BLOCK`` words, or fewer where the smallest target would be less than
``LEAST_BLOCKS`` blocks, so that small sources come near theirs too. A shard's documents lie in seeded order end to end as
one stream of words; its quota is a seeded cyclic run of blocks of that stream, after whole passes. Documents are thus
taken whole, but for the two at a run's ends.

The tables that meet on the driver have a row per source, of which there may be ``MAX_SOURCES`` (more is an error).
A hot source only has more shards. Defined cases: null source is a source of its own, sorted last; null or empty text
has size 0 and nothing is taken; equal rows are dealt alike by their hash, ties in any order; null ids hash as null; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WS, WS_CHARS, text_of, written

WEIGHTS = (5, 2, 1)
BLOCK = 16
SHARD_WORDS = 100_000
SHARDS = 65_536
LEAST_BLOCKS = 32
MAX_SOURCES = 100_000


def targets(sizes: list[int], weights: list[float], epochs: float = 3.0) -> list[float]:
    """Shares of the total by weight; what exceeds ``epochs`` times a source's size is shared again by weight."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if left * weights[i] / w > epochs * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = epochs * sizes[i]
            open_.remove(i)
        left -= sum(out[i] for i in over)
    return out


def sainte_lague(seats: int, votes: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients ``votes / (2 q + 1)`` up to ``caps``; ties go to the earlier party.

    Equal to rounding ``votes * m`` for a common multiplier ``m``: the largest one that hands out no more than
    ``seats`` is found by bisection, and the last few seats go one by one.
    """
    votes, caps = np.asarray(votes, dtype=float), np.asarray(caps, dtype=np.int64)
    caps = np.where(votes > 0, caps, 0)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(votes), dtype=np.int64)

    def dealt(m: float) -> np.ndarray:
        return np.minimum(np.ceil(np.minimum(votes * m, caps + 1.0) - 0.5).astype(np.int64).clip(0), caps)

    low, high = 0.0, 1.0
    while dealt(high).sum() < seats:
        low, high = high, high * 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if dealt(mid).sum() <= seats else (low, mid)
    q = dealt(low)
    heap = [(-votes[i] / (2 * q[i] + 1), i) for i in range(len(votes)) if q[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(q.sum())):
        _, i = heapq.heappop(heap)
        q[i] += 1
        if q[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * q[i] + 1), i))
    return q


def _dealt(df: DataFrame, source_col: str, id_col: str, text_col: str, seed: int, block: int, epochs: int, carry: list[str]) -> DataFrame:
    """Each row (its columns ``carry``) with size, source_size, target and what the mix takes: ``passes`` whole and the run's two pieces."""
    spark = df.sparkSession
    body = F.btrim(text_of(text_col), F.lit(WS_CHARS))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col(source_col).cast("string").alias("src"),
        F.when(body == "", 0).otherwise(F.size(F.split(body, f"[{WS}]+"))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), text_of(text_col)).alias("order"),
    )
    by_source = rows.groupBy("src").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(((r["src"], int(r["n"])) for r in by_source), key=lambda x: (x[0] is None, x[0] or ""))
    sizes = [n for _, n in found]
    want = targets(sizes, [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(found))], epochs)
    block = max(1, min([block, *(int(t) // LEAST_BLOCKS for t in want if t > 0)]))
    seats = sainte_lague(round(sum(sizes) / block), np.array(want), np.array([-(-epochs * n // block) for n in sizes]))
    shards = [max(1, -(-n // SHARD_WORDS)) for n in sizes]
    plan = spark.createDataFrame(
        [(s, n, float(t), int(q), k, i) for i, ((s, n), t, q, k) in enumerate(zip(found, want, seats, shards, strict=True))],
        "s string, source_size long, target double, seats long, shards int, no int",
    )
    rows = rows.join(F.broadcast(plan), F.col("src").eqNullSafe(F.col("s"))).withColumn(
        "shard", F.pmod(F.xxhash64(F.lit(seed + 1), "order"), F.col("shards")).cast("int")
    )

    def dealt(party: str):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(party)
            rows["got"] = sainte_lague(int(rows["seats"].iloc[0]), rows["words"].to_numpy(), rows["cap"].to_numpy())
            return rows[["no", "part", party, "words", "got"]] if party != "part" else rows[["no", "part", "got"]]

        return run

    sharded = rows.groupBy("no", "shard", "seats").agg(F.sum("size").alias("words"))
    sharded = sharded.withColumns({"part": F.floor(F.col("shard") / SHARDS).cast("int"), "cap": F.ceil(F.col("words") * epochs / block).cast("long")})
    sharded = written(sharded, "shards")  # read twice
    parts = sharded.groupBy("no", "part", "seats").agg(F.sum("words").alias("words"), F.sum("cap").alias("cap"))
    parts = parts.groupBy("no").applyInPandas(dealt("part"), "no int, part int, got long").withColumnRenamed("got", "seats")
    quota = sharded.drop("seats").join(parts, ["no", "part"]).groupBy("no", "part").applyInPandas(dealt("shard"), "no int, part int, shard int, words long, got long")
    quota = quota.select("no", "shard", "words", F.least(F.col("got") * block, F.col("words") * epochs).alias("quota"))  # the last block may be partial
    # the join's partitioning serves the window too: one shuffle of the rows
    at = Window.partitionBy("no", "shard").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(quota, ["no", "shard"]).withColumn("end", F.sum("size").over(at))
    rest = F.when(F.col("words") > 0, F.col("quota") % F.col("words")).otherwise(0)
    start = F.lit(block) * F.pmod(F.xxhash64(F.lit(seed + 2), "no", "shard"), F.greatest(F.floor(F.col("words") / block), F.lit(1)))
    rows = rows.withColumns({
        "passes": F.when(F.col("words") > 0, F.floor(F.col("quota") / F.col("words"))).otherwise(0).cast("long"),
        "rest": rest.cast("long"), "start": start.cast("long"), "begin": F.col("end") - F.col("size"),
    })
    for name, shift in (("head", 0), ("tail", 1)):
        a = F.greatest("begin", F.col("start") - F.col("words") * shift)
        b = F.least("end", F.col("start") + F.col("rest") - F.col("words") * shift)
        rows = rows.withColumns({f"{name}_from": a - F.col("begin"), f"{name}_n": F.greatest(b - a, F.lit(0))})
    return rows.withColumn("taken", F.col("passes") * F.col("size") + F.col("head_n") + F.col("tail_n"))


def mix(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: int = 17, block: int = BLOCK, epochs: int = 3,
) -> DataFrame:
    """Per row: ``id_col``, size, source_size, target and taken (words the mix takes, repeats counted)."""
    light = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    out = _dealt(light, "source", "id", "text", seed, block, epochs, ["id"])
    return out.select(F.col("row.id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mix_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: int = 17, block: int = BLOCK, epochs: int = 3,
) -> DataFrame:
    """The mixed table, columns as given: a row for each whole pass, and one for each piece of a run.

    A piece of the whole text is the text as it is; a shorter one its words joined by single spaces.
    """
    d = _dealt(df, source_col, id_col, text_col, seed, block, epochs, df.columns)
    text = text_of(f"row.{text_col}")
    words = F.split(F.btrim(text, F.lit(WS_CHARS)), f"[{WS}]+")
    piece = lambda k: F.when(F.col(f"{k}_n") == F.col("size"), text).otherwise(
        F.array_join(F.slice(words, (F.col(f"{k}_from") + 1).cast("int"), F.col(f"{k}_n").cast("int")), " ")
    )
    parts = F.concat(
        F.when(F.col("passes") > 0, F.array_repeat(text, F.col("passes").cast("int"))).otherwise(F.array().cast("array<string>")),
        *[F.when(F.col(f"{k}_n") > 0, F.array(piece(k))).otherwise(F.array().cast("array<string>")) for k in ("head", "tail")],
    )
    out = d.where("taken > 0").select("row", F.explode(parts).alias("part"))
    cols = {c: F.col(f"row.`{c}`") for c in df.columns} | {text_col: F.col("part")}
    if dict(df.dtypes).get("n_chars") == "bigint":
        cols["n_chars"] = F.char_length("part").cast("long")
    return out.select(*[v.alias(c) for c, v in cols.items()])


def query(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
