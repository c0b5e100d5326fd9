"""Exact deduplication by Grace hashing.

Two levels. Every input partition first removes its own copies in an open-addressing table that compares complete
content, so that a group holding a third of all rows reaches the shuffle as a few rows per partition. What is left is
partitioned by content hash (Spark's shuffle files are the first level of spill files and survive lost executors);
a bucket whose different contents still exceed the memory bound is partitioned again, recursively, by further bits of the
hash to spill files of the task, until each fits an open-addressing table. Rows enter the table as they are read and equal
contents fold into one entry at once, so that memory holds a content once, however many rows have it.
A content that many partitions hold (more than ``HOT`` of their winners with one hash) is folded by salted parts first,
again and again until few are left, so that no task reads all of them.

Defined cases: null text counts as empty; texts are compared after each run of ``[\\x20\\x09-\\x0D]`` becomes one space;
of repeated rows (equal id and text) one arbitrary row stays; null ids rank after all others. Extra columns are
carried by :func:`exact_dedup_rows` and ignored by :func:`exact_dedup`. Empty tables give empty results.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WS, shuffle_partitions, text_of, written

LOCAL_BYTES = 48 << 20
BUCKET_BYTES = 64 << 20
FANOUT = 16
DEPTH = 12
HOT = 64


class ContentTable:
    """Open addressing with linear probing: slots hold entry numbers, equality compares hash and whole content."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.mask = slots - 1
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def find_or_add(self, h: int, content: bytes) -> tuple[int, bool]:
        """The number of the entry with this content; whether it is new."""
        i = (h ^ (h >> 32)) & self.mask
        while (e := self.slots[i]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                return e, False
            i = (i + 1) & self.mask
        self.slots[i] = e = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 200
        if 2 * e > self.mask:
            self._grow()
        return e, True

    def _grow(self) -> None:
        self.mask = 2 * self.mask + 1
        self.slots = [-1] * (self.mask + 1)
        for e, h in enumerate(self.hashes):
            i = (h ^ (h >> 32)) & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = e


def grace_groups(
    rows: Iterable[tuple[int, bytes, object]], max_bytes: int = BUCKET_BYTES, fold: Callable | None = None, depth: int = 0
) -> Iterator[list[tuple[int, bytes, object]]]:
    """Groups ``(hash, content, folded payloads)`` of equal content, over ``(hash, content, payload)`` rows, a list for
    each bucket, in bounded memory. ``fold(a, b)`` of two payloads is one; without it, payloads are lists and join.

    Rows go into the table until it exceeds ``max_bytes``; then its entries, and the rows still to come, are dealt to
    ``FANOUT`` spill files by the next bits of the hash, and each file is treated alike. Past the last bits (different
    contents of one hash) there is nothing more to divide by.
    """
    fold = fold or (lambda a, b: a + b)
    table, folded, rows = ContentTable(), [], iter(rows)
    for h, content, payload in rows:
        e, new = table.find_or_add(h, content)
        if new:
            folded.append(payload)
            if table.bytes > max_bytes and depth < DEPTH:
                break
        else:
            folded[e] = fold(folded[e], payload)
    else:
        yield list(zip(table.hashes, table.contents, folded, strict=True))
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files = [open(os.path.join(folder, str(i)), "w+b") for i in range(FANOUT)]  # noqa: SIM115
        try:
            counts = [0] * FANOUT

            def deal(row: tuple) -> None:
                i = (row[0] >> (4 * depth)) & (FANOUT - 1)
                pickle.dump(row, files[i], protocol=5)
                counts[i] += 1

            for row in zip(table.hashes, table.contents, folded, strict=True):
                deal(row)
            del table, folded
            for row in rows:
                deal(row)
            for i, f in enumerate(files):
                f.seek(0)
                yield from grace_groups((pickle.load(f) for _ in range(counts[i])), max_bytes, fold, depth + 1)
                f.close()
        finally:
            for f in files:
                f.close()


def _rank(doc_id: int | None, key: int) -> tuple:
    return (doc_id is None, doc_id or 0, key)


def _prepared(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key, id, hash and normalised text beside the row as a struct."""
    return df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(text_of(text_col), f"[{WS}]+", " ").alias("norm"),
    ).withColumns({"h": F.xxhash64("norm"), "key": F.monotonically_increasing_id()})


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    The first pass writes a light table of (row key, local representative) with the text of representatives only; the
    shuffle takes each representative's text once; the answer comes back over the representatives' keys, of which a
    hot group has one for every flush of every partition, so no key is hot.
    """
    out = T.StructType().add("key", "long").add("rep", "long").add("id", "long").add("h", "long")
    out.add("best_id", "long").add("best_key", "long").add("n", "long").add("norm", "string")
    fields = _arrow(out)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def reset() -> None:
            state.update(table=ContentTable(), reps=[], best=[], n=[])

        def flush() -> pa.RecordBatch:
            t: ContentTable = state["table"]
            best = state["best"]
            cols = [None_ := [None] * len(best), state["reps"], None_, t.hashes, [b[0] for b in best], [b[1] for b in best], state["n"], [c.decode("utf-8", "surrogatepass") for c in t.contents]]
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=fields)
            reset()
            return made

        reset()
        for batch in batches:
            keys, ids, hs = (batch.column(c).to_pylist() for c in ("key", "id", "h"))
            norm = batch.column("norm").cast(pa.binary()).to_pylist()
            reps = []
            for key, i, h, content in zip(keys, ids, hs, norm, strict=True):
                e, new = state["table"].find_or_add(h, content)
                if new:
                    state["reps"].append(key)
                    state["best"].append((i, key))
                    state["n"].append(1)
                else:
                    state["n"][e] += 1
                    if _rank(i, key) < _rank(*state["best"][e]):
                        state["best"][e] = (i, key)
                reps.append(state["reps"][e])
            none = pa.nulls(len(keys), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(reps, pa.int64()), batch.column("id"), none, none, none, none, pa.nulls(len(keys), fields.field("norm").type)], schema=fields)
            if state["table"].bytes > LOCAL_BYTES:
                yield flush()
        if state["reps"]:
            yield flush()

    first = written(_prepared(df.select(id_col, text_col), id_col, text_col).select("key", "id", "h", "norm").mapInArrow(local, out), "exact-local")
    classes = T.StructType().add("rep", "long").add("top", "long").add("h", "long").add("best_id", "long").add("best_key", "long").add("n", "long").add("norm", "string")
    class_fields = _arrow(classes)

    def fold(a: tuple, b: tuple) -> tuple:
        return (a[0] + b[0], min(a[1], b[1], key=lambda x: _rank(*x)), a[2] + b[2])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each representative with the one it goes to, which is also a row with the content."""

        def rows() -> Iterator[tuple]:
            for b in batches:
                hs, reps, ids, keys, ns = (b.column(c).to_pylist() for c in ("h", "rep", "best_id", "best_key", "n"))
                for h, content, rep, i, key, n in zip(hs, b.column("norm").cast(pa.binary()).to_pylist(), reps, ids, keys, ns, strict=True):
                    yield h, content, ([rep], (i, key), n)

        for groups in grace_groups(rows(), fold=fold):
            made, size = [], 0
            for h, content, (reps, best, n) in groups:
                made += [(rep, reps[0], h, *best, n, content.decode("utf-8", "surrogatepass") if rep == reps[0] else None) for rep in reps]
                size += len(content)
                if size > LOCAL_BYTES // 4:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), class_fields, strict=True)], schema=class_fields)
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), class_fields, strict=True)], schema=class_fields)

    parts = shuffle_partitions(df.sparkSession)
    reps = first.where("n is not null").select("h", "rep", "best_id", "best_key", "n", "norm")
    links: list[DataFrame] = []
    before = None
    while (salted := _salted(reps, before)) is not None:
        hot, reps, before = salted
        again = written(hot.repartition(parts, "h", "salt").drop("salt").mapInArrow(merged, classes), "exact-merged")
        links.append(again.select("rep", "top"))
        reps = reps.unionByName(again.where("rep = top").select("h", "rep", "best_id", "best_key", "n", "norm"))
    done = reps.repartition(parts, "h").mapInArrow(merged, classes)
    # a content's rows all come from one task's table, its first row with the text
    found = done.select("rep", F.struct(F.col("best_key").alias("keep_key"), F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"), F.sha2("norm", 256).alias("sha"), "top").alias("class"))
    found = written(found, "exact-classes")
    shas = found.where("class.sha is not null").select(F.col("class.top").alias("top"), F.col("class.sha").alias("text_sha256"))
    found = found.select("rep", "class.keep_key", "class.keep_id", "class.group_size", "class.top").join(shas, "top").drop("top")
    for link in reversed(links):
        up = link.join(found.withColumnRenamed("rep", "top"), "top").drop("top")
        found = found.join(link, found["rep"] == link["top"], "left_anti").unionByName(up)
    members = first.where("n is null").select("key", "rep", "id")
    return members.join(found, "rep").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        (F.col("key") == F.col("keep_key")).alias("kept"),
        "text_sha256",
    )


def _salted(reps: DataFrame, before: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Rows of hashes that more than ``HOT`` rows have, with a salt that leaves about so many to a part, the others, and
    the hashes with their rows; None where there are none of the former. A hash whose rows have not become fewer since
    ``before`` has that many different contents, and is not salted again."""
    counts = reps.groupBy("h").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > HOT)
    if before is not None:
        counts = counts.join(before.select("h", F.col("_rows").alias("_was")), "h", "left")
    else:
        counts = counts.withColumn("_was", F.lit(None).cast("long"))
    counts = written(counts, "exact-hot")
    hot = counts.where("_was is null or _rows < _was").drop("_was")
    if hot.isEmpty():
        return None
    salt = F.pmod(F.xxhash64("rep"), F.ceil(F.col("_rows") / (HOT + 1)))
    return reps.join(hot, "h").withColumn("salt", salt).drop("_rows"), reps.join(hot, "h", "left_anti"), counts.drop("_was")


def exact_dedup_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one shuffle, of each partition's own winners."""
    schema = T.StructType().add("row", df.schema).add("id", "long").add("norm", "string").add("h", "long").add("key", "long")
    fields = _arrow(schema)

    def winners(state: ContentTable, best: list) -> pa.RecordBatch:
        rows, ids, keys = zip(*[(r, i, k) for (i, k), r in best], strict=True)
        cols = [list(rows), list(ids), [c.decode("utf-8", "surrogatepass") for c in state.contents], state.hashes, list(keys)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            rows, ids, hs, keys = (b.column(c).to_pylist() for c in ("row", "id", "h", "key"))
            yield from zip(hs, b.column("norm").cast(pa.binary()).to_pylist(), ids, keys, rows, strict=True)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, best = ContentTable(), []
        for h, content, i, key, row in read(batches):
            e, new = t.find_or_add(h, content)
            if new:
                best.append(((i, key), row))
            elif _rank(i, key) < _rank(*best[e][0]):
                best[e] = ((i, key), row)
            if t.bytes > LOCAL_BYTES // 4:  # a row holds its text besides
                yield winners(t, best)
                t, best = ContentTable(), []
        if best:
            yield winners(t, best)

    def globally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in grace_groups(((h, c, ((i, k), r)) for h, c, i, k, r in read(batches)), fold=lambda a, b: min(a, b, key=lambda x: _rank(*x[0]))):
            for at in range(0, len(groups), 1000):
                rows, ids, keys, hs = zip(*[(r, i, k, h) for h, _, ((i, k), r) in groups[at : at + 1000]], strict=True)
                cols = [list(rows), list(ids), [None] * len(rows), list(hs), list(keys)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, fields, strict=True)], schema=fields)

    norm = F.regexp_replace(text_of(f"row.{text_col}"), f"[{WS}]+", " ").alias("norm")
    parts = shuffle_partitions(df.sparkSession)

    def folded(winners: DataFrame, *by: str) -> DataFrame:
        rows = winners.repartition(parts, *by).select("row", "id", norm, "h", "key")
        return rows.mapInArrow(globally, schema).drop("norm")

    near = written(_prepared(df, id_col, text_col).select("row", "id", "norm", "h", "key").mapInArrow(local, schema).drop("norm"), "exact-rows")
    rest = near.withColumnRenamed("key", "rep")
    before = None
    while (salted := _salted(rest, before)) is not None:
        hot, rest = (x.withColumnRenamed("rep", "key") for x in salted[:2])
        before = salted[2]
        rest = rest.unionByName(written(folded(hot, "h", "salt"), "exact-rows")).withColumnRenamed("key", "rep")
    return folded(rest.withColumnRenamed("rep", "key"), "h").select("row.*")


ORACLE = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
