"""Vector code compression: product codes by partial-distance search.

Components become integers ``floor(1024 * x)``, vectors are cut into ``PARTS`` equal consecutive parts, and each part is
coded by the nearest of up to ``ENTRIES`` codebook entries. A codebook starts as that part of the first vectors in id
order and is refined by ``ROUNDS`` rounds of assigning all parts and replacing entries by floored means.

The search is exact: dimensions are processed in descending variance of the codebook. The first few give every entry a
partial distance; the least of them is completed and is the current best. Masks then drop the entries whose accumulated
integer distance strictly exceeds the best complete one, dimension by dimension; halfway the most promising survivor is
completed and the best may fall. Equal distances are never dropped, so ties go to the lower index.

A round is one scan of the integer table: each task sums its own rows by entry, and only ``PARTS * ENTRIES`` sums a task
are shuffled. The driver holds the codebooks alone, whose size is fixed.

Defined cases: rows whose vector is null or has null or non-finite components are left out; null ids come after all
others, equal ids go by their components; repeated rows are rows of their own; with under 256 rows codebooks are shorter;
an empty table gives an empty result; extra columns are ignored. Vectors of different lengths, lengths that 4 does not
divide and integers of 2**27 or more in magnitude are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 27
BLOCK = 512
DENSE = 6


def integers(vector: Column) -> Column:
    """``floor(1024 * x)`` of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def _bounded(vector: Column) -> Column:
    fits = F.forall(vector, lambda x: F.abs(x.cast("double") * SCALE) < float(LIMIT - 1))
    return F.when(fits, vector).otherwise(F.raise_error(F.lit("a component is too large for exact integer distances")))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry of each row, by partial distances; ties to the lower index."""
    index, distance = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
    order = np.argsort(-book.var(axis=0), kind="stable")
    book = book[:, order]
    for lo in range(0, len(x), BLOCK):
        part = x[lo : lo + BLOCK, order]
        index[lo : lo + BLOCK], distance[lo : lo + BLOCK] = _nearest_block(part, book)
    return index, distance


def _nearest_block(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n, d = x.shape

    def complete(entry: np.ndarray) -> np.ndarray:
        return ((x - book[entry]) ** 2).sum(axis=1)

    partial = np.zeros((n, len(book)), dtype=np.int64)
    for j in range(min(DENSE, d)):
        partial += (x[:, j, None] - book[None, :, j]) ** 2
    best = complete(partial.argmin(axis=1))
    row, entry = np.nonzero(partial <= best[:, None])
    sums = partial[row, entry]
    for j in range(min(DENSE, d), d):
        if j == (DENSE + d) // 2:
            best = np.minimum(best, complete(entry[_least(row, sums)[0]]))
            alive = sums <= best[row]
            row, entry, sums = row[alive], entry[alive], sums[alive]
        sums += (x[row, j] - book[entry, j]) ** 2
        alive = sums <= best[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
    at, least = _least(row, sums)
    return entry[at], least


def _least(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (they ascend and none is missing): where its least value stands first, and that value."""
    start = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(value, start) if len(start) else value
    hit = np.flatnonzero(value == least[row])
    return hit[np.flatnonzero(np.diff(row[hit], prepend=-1))], least


@dataclass
class Codebooks:
    """``books[p]``: the entries of part ``p``, one a row."""

    books: list[np.ndarray]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.ravel().tolist()).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries and squared distances of each vector's parts, ``(vectors, PARTS)`` each."""
        width = vectors.shape[1] // PARTS
        found = [nearest(vectors[:, p * width : (p + 1) * width], b) for p, b in enumerate(self.books)]
        return np.stack([i for i, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sums(books: Codebooks):
    """Per task: count and component sums of the rows of each used entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), dtype=np.int64) for b in books.books]
        total = [np.zeros(b.shape, dtype=np.int64) for b in books.books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            width = x.shape[1] // PARTS
            index, _ = books.assign(x)
            for p in range(PARTS):
                order = np.argsort(index[:, p], kind="stable")
                used, start = np.unique(index[order, p], return_index=True)
                total[p][used] += np.add.reduceat(x[order, p * width : (p + 1) * width], start, axis=0)
                count[p] += np.bincount(index[:, p], minlength=len(count[p]))
        rows = [(p, int(e), int(count[p][e]), total[p][e].tolist()) for p in range(PARTS) for e in np.flatnonzero(count[p])]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

    return run


def fit(vectors: DataFrame, id_col: str, vector_col: str, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of a table of integer vectors; the table is scanned once a round."""
    first = vectors.orderBy(F.col(id_col).asc_nulls_last(), vector_col).limit(ENTRIES).select(vector_col).collect()
    start = np.array([r[0] for r in first], dtype=np.int64)
    width = start.shape[1] // PARTS
    books = Codebooks([start[:, p * width : (p + 1) * width].copy() for p in range(PARTS)])
    for _ in range(rounds):
        sums = vectors.select(vector_col).mapInArrow(_sums(books), "part int, entry int, n long, s array<long>")
        merged = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(width)])
        after = Codebooks([b.copy() for b in books.books])
        for part, entry, n, *s in merged.collect():
            after.books[part][entry] = [v // n for v in s]
        books = after
    return books


def encode(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks | None]:
    """Per usable row its id, label, ``code`` (the parts' entries in hex) and ``error``; and the codebooks (None without rows)."""
    schema = T.StructType([T.StructField("vec_id", df.schema[id_col].dataType), T.StructField("label", df.schema[label_col].dataType), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    vector = F.col(vector_col)
    vectors = written(df.where(_usable(vector)).select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), integers(_bounded(vector)).alias("v")), "vectors")
    low, high = vectors.agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if low is None:
        return df.sparkSession.createDataFrame([], schema), None
    if low != high or not low or low % PARTS:
        raise ValueError(f"vectors have {low} to {high} components; all need one length, a multiple of {PARTS}")
    books = fit(vectors, "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                index, distance = books.assign(_matrix(batch.column(2)))
                code = [bytes(row).hex() for row in index.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(distance.sum(axis=1), pa.int64())], names=schema.names)

    return vectors.mapInArrow(run, schema), books


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """``codes`` with the vector (array<double>) that each code stands for, as ``decoded``."""
    parts = [F.array(*[F.array(*[F.lit(v / SCALE) for v in e]) for e in b.tolist()]) for b in books.books]
    at = [F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") for p in range(PARTS)]
    return codes.withColumn("decoded", F.concat(*[b[i] for b, i in zip(parts, at, strict=True)]))


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = encode(table(spark, sf_dir, "embeddings"))
    coded = written(coded, "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))


def _oracle() -> str:
    """The rounds as common table expressions: distances by dot products of exact doubles."""
    steps = ["""
kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS rid, v FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
parts AS MATERIALIZED (SELECT rid, p, list_slice(v, p * len(v) // 4 + 1, (p + 1) * len(v) // 4) AS x FROM kept, range(4) r(p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM parts WHERE rid <= 256)"""]
    near = """
near{i} AS MATERIALIZED (SELECT rid, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT rid, p, e, list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS d FROM parts JOIN book{i} USING (p)) GROUP BY rid, p)"""
    for i in range(ROUNDS):
        steps.append(near.format(i=i))
        steps.append(f"""
mean{i} AS (SELECT p, e, list(m ORDER BY j) AS c FROM (
  SELECT p, e, j, floor(sum(y) / count(*)) AS m FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM near{i} JOIN parts USING (rid, p)) GROUP BY p, e, j) GROUP BY p, e),
book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m USING (p, e))""")
    steps.append(near.format(i=ROUNDS))
    steps.append(f"""
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY rid),
sha AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept USING (rid), sha"""


ORACLE = _oracle()
