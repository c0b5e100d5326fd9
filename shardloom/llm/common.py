"""What the operators of this subpackage share: table access, shared storage, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]`` as a regular-expression class, for Spark's and for Python's engine.
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or in local mode a temporary one where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="shardloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, list[str]] = {}


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage, survives lost executors. The shuffle
    files of the write go when it ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def drop_written(df: DataFrame) -> None:
    """Deletes a table of :func:`written` once all that read it is itself written."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def clear_written(spark: SparkSession) -> None:
    """Deletes what :func:`written` made in this application and is left. Results that were not written yet read from
    it, so call this once they are."""
    for path in _made.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def row_key(id_col: str, text_col: str) -> Column:
    """SHA-256 of a row's id and text: rows that share it are repeated rows, null ids included."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")), F.lit(":"), text_of(text_col)), 256))


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    """A text column, null counting as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


_WORD_SEP = np.zeros(256, dtype=bool)
_WORD_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply), so that sums of products become evenly spread hashes."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            p = np.full(max(n, 2 * len(_POWERS)), np.uint64(_BASE))
            p[0] = 1
            _POWERS = np.multiply.accumulate(p)
    return _POWERS


def word_hashes(data: bytes, fold: bool = True) -> np.ndarray:
    """A 64-bit hash for each maximal run of bytes outside ``[\\x20\\x09-\\x0D]``, in order.

    UTF-8 never uses these separators inside a character, so byte runs are the code-point runs. ``fold`` lower-cases
    A-Z first. One vectorised pass: a multilinear hash over the bytes of a word, by position in the word, then mixed.
    """
    a = np.frombuffer(data, dtype=np.uint8)
    if not len(a):
        return np.empty(0, dtype=np.uint64)
    if fold:
        a = _FOLD[a]
    word = ~_WORD_SEP[a]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.empty(0, dtype=np.uint64)
    length = end - begin
    code = a[word].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(length) - length
    at = np.arange(len(code)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        h = np.add.reduceat(code * _powers(int(length.max()) + 1)[at], first)
        return mix64(h + length.astype(np.uint64) * _MUL)


def shingle_hashes(data: bytes, n: int) -> np.ndarray:
    """The sorted distinct hashes of the ``n``-word shingles of a text; with fewer words, one of the whole sequence."""
    w = word_hashes(data)
    if not len(w):
        return w
    m = min(n, len(w))
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - m + 1, dtype=np.uint64)
        for i in range(m):
            h = mix64(h * _MUL + w[i : len(w) - m + 1 + i] + np.uint64(i + 1))
        if m < n:
            h = mix64(h + np.uint64(m))
    return np.unique(h)


def batch_shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, with the offsets where each text's begin (one more at
    the end). Equal to :func:`shingle_hashes` text by text, but hashed in one pass over all of them."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    data = b" ".join(texts)
    a = _FOLD[np.frombuffer(data, dtype=np.uint8)] if data else np.empty(0, dtype=np.uint8)
    word = ~_WORD_SEP[a]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    begin, end = edge[::2], edge[1::2]
    bounds = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
    if len(begin):
        length = end - begin
        first = np.cumsum(length) - length
        at = np.arange(int(length.sum())) - np.repeat(first, length)
        with np.errstate(over="ignore"):
            w = mix64(np.add.reduceat((a[word].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()) + 1)[at], first) + length.astype(np.uint64) * _MUL)
            h = np.zeros(max(0, len(w) - n + 1), dtype=np.uint64)
            for i in range(n):
                h = mix64(h * _MUL + w[i : i + len(h)] + np.uint64(i + 1))
    parts, lens = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for d, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        if hi - lo >= n:
            s = h[lo : hi - n + 1].copy()
            s.sort()
            keep = np.empty(len(s), dtype=bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        elif hi > lo:
            s = shingle_hashes(texts[d], n)
        else:
            continue
        parts.append(s)
        lens[d + 1] = len(s)
    return (np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)), np.cumsum(lens)
