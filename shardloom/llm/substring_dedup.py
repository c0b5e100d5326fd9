"""Removal of repeated byte strings by difference-cover blockwise suffix sorting.

A corpus-wide suffix array would be several times the corpus, so suffixes are dealt to buckets that are sorted one block
of buckets at a time. The bucket of a suffix is the least hash among the ``K``-byte strings in its first ``LENGTH`` bytes
(leftmost of equals): equal strings of ``LENGTH`` bytes have it in common, and neighbouring suffixes mostly share it, so a
bucket entry is a short segment of text that stands for the run of suffixes which chose its anchor.

1. Anchor hashes of every text; those that occur once anywhere can't repeat and go.
2. Segments at the others, equal ones collapsed with their count, first within a text, then where they are read.
3. A block of buckets is one text to its task. The positions in ``COVER`` (mod ``PERIOD``), a difference cover, are ranked
   once by their next ``RANKED`` bytes. Any two suffixes reach positions of the cover after an equal number of bytes, so
   bytes up to there, the ranks and the few bytes behind them decide every comparison, however long the tie. The
   suffixes of each bucket are put in lexicographic order that way; one equal to a neighbour repeats.
4. Buckets of more than ``HEAVY`` segments are dealt again by a second and third anchor; what stays that large
   leaves the method: its suffixes, as their first ``LENGTH`` bytes, are grouped by Spark, which is exact but no order.
5. The bytes under repeating suffixes, merged per document, are removed.

Defined cases: null text counts as empty; texts shorter than ``LENGTH`` lose nothing; every row is a document of its own,
whatever its id, so equal rows repeat each other; matches never cross documents; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, mix64, shuffle_partitions, text_of, written

LENGTH = 200
K = 50
PERIOD, COVER = 3, (0, 1)  # the differences 0, 1 and 2 of its members are all there are mod 3
RANKED = 197  # least suffix length that is ranked; LENGTH less the longest way to the cover, and one
HEAVY = 4000
LEVELS = 3
BLOCK_BYTES = 96 << 10
CHUNK = 1 << 20
_POS = np.uint64(CHUNK * 2 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_cache: dict[str, np.ndarray] = {}


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_cache.get(name, ())) < n:
        p = np.full(max(n, 2 * CHUNK), base)
        p[0] = 1
        with np.errstate(over="ignore"):
            _cache[name] = np.multiply.accumulate(p)
    return _cache[name][:n]


def rolling(a: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """A mixed 64-bit hash of each ``k``-byte string of ``a``."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, len(a)))])
        h = mix64((sums[k:] - sums[:-k]) * _powers("down", _INV, len(a) - k + 1))
        return mix64(h + np.uint64(salt) * _BASE) if salt else h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, from running minima of blocks of ``w`` both ways."""
    n = len(x)
    wide = np.concatenate([x, np.full(-n % w, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(wide, axis=1).ravel()[:n]
    behind = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    return np.minimum(behind[: n - w + 1], ahead[w - 1 :])


def anchored_runs(texts: list[bytes], salt: int = 0) -> tuple[np.ndarray, ...]:
    """Runs of suffixes of at least ``LENGTH`` bytes with one anchor: text number, first and last start, anchor's
    position, hash. Positions are within the text. Long texts are read in overlapping pieces."""
    pieces: list[tuple[int, int, bytes]] = []
    for t, data in enumerate(texts):
        for at in range(0, max(0, len(data) - LENGTH + 1), CHUNK - LENGTH):
            pieces.append((t, at, data[at : at + CHUNK - 1]))
    out: list[tuple[np.ndarray, ...]] = []
    group: list[tuple[int, int, bytes]] = []

    def flush() -> None:
        if not group:
            return
        a = np.frombuffer(b"".join(p[2] for p in group), dtype=np.uint8)
        size = np.array([len(p[2]) for p in group])
        base = np.cumsum(size) - size
        h = rolling(a, K, salt)
        tagged = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        least = (sliding_min(tagged, LENGTH - K + 1) & _POS).astype(np.int64)
        of = np.repeat(np.arange(len(group)), size)[: len(least)]
        ok = np.arange(len(least)) + LENGTH <= (base + size)[of]
        start = np.flatnonzero(ok)
        anchor, of = least[start], of[start]
        cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])) if len(start) else start
        last = np.concatenate([cut[1:], [len(start)]]) - 1 if len(start) else start
        piece = of[cut]
        number, shift = np.array([p[0] for p in group]), np.array([p[1] for p in group])
        move = shift[piece] - base[piece]
        out.append((number[piece], start[cut] + move, start[last] + move, anchor[cut] + move, h[anchor[cut]]))
        group.clear()

    size = 0
    for p in pieces:
        if group and size + len(p[2]) >= CHUNK:
            flush()
            size = 0
        group.append(p)
        size += len(p[2])
    flush()
    if not out:
        e = np.empty(0, dtype=np.int64)
        return e, e, e, e, np.empty(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.uint64)


def _ahead(rank: np.ndarray, n_bytes: int) -> np.ndarray:
    """Ranks ``n_bytes`` (whole periods) further on."""
    k = n_bytes // PERIOD * len(COVER)
    return np.concatenate([rank[k:], np.zeros(k, dtype=rank.dtype)])


def cover_ranks(flat: np.ndarray) -> np.ndarray:
    """Ranks of the cover's positions in a text that ends in at least 8 spare bytes, by their next ``RANKED`` bytes; the
    rank of position ``p`` is at ``p // 3 * 2 + p % 3``. Windows that overlap keep the order: 8 bytes, then four of them
    make 26, four of those 98, and three of those 197."""
    p = np.arange(len(flat) - 7)
    p = p[p % PERIOD < len(COVER)]
    rank = _dense(np.lib.stride_tricks.sliding_window_view(flat, 8)[p].view(">u8").ravel())
    for ways in ((6, 12, 18), (24, 48, 72), (96, 99)):
        bits = int(rank.max(initial=0)).bit_length()
        wide, used, out = np.uint64(bits), bits, rank
        for n_bytes in ways:
            if used + bits > 64:
                out = _dense(out)
                used = int(out.max(initial=0)).bit_length()
            out = out << wide | _ahead(rank, n_bytes)
            used += bits
        rank = _dense(out)
    return rank


def suffix_order(flat: np.ndarray, at: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``at`` in the order of (block, first ``LENGTH`` bytes), and which of them equal their predecessor.

    The suffixes on the cover (classes 0 and 1) are ordered by their own ranks, those off it (class 2) by the ranks one
    byte on; the two are merged by binary search, where class 2 meets class 0 one byte on and class 1 two bytes on.
    """
    rank = cover_ranks(flat)
    of = (at % PERIOD).astype(np.int8)
    bits = max(1, int(rank.max(initial=0)).bit_length())
    if bits + 24 + int(block.max(initial=0)).bit_length() > 64:
        raise ValueError("a block of buckets is too large")
    lead = block.astype(np.uint64)

    def key(rows: np.ndarray, way: int) -> np.ndarray:
        p = at[rows]
        out = lead[rows]
        for k in range(way):
            out = out << np.uint64(8) | flat[p + k]
        q = p + way
        out = out << np.uint64(bits) | rank[q // PERIOD * len(COVER) + q % PERIOD]
        for k in range(way + RANKED, LENGTH):
            out = out << np.uint64(8) | flat[p + k]
        return out

    keys = np.zeros((PERIOD, len(at)), dtype=np.uint64)
    on, off = np.flatnonzero(of < 2), np.flatnonzero(of == 2)
    for way, rows in ((0, on), (1, np.flatnonzero(of != 1)), (2, np.flatnonzero(of != 0))):
        keys[way, rows] = key(rows, way)
    on, off = on[np.argsort(keys[0, on])], off[np.argsort(keys[1, off])]
    before = np.arange(len(off))
    for way, kind in ((1, 0), (2, 1)):
        before += np.searchsorted(keys[way, on[of[on] == kind]], keys[way, off])
    order = np.empty(len(at), dtype=np.int64)
    rest = np.ones(len(at), dtype=bool)
    rest[before] = False
    order[before], order[rest] = off, on
    x, y = order[:-1], order[1:]
    way = np.where((of[x] < 2) & (of[y] < 2), 0, np.where(of[x] + of[y] == 3, 2, 1))
    return order, np.concatenate([[False], keys[way, x] == keys[way, y]])[: len(at)]


def repeating(block: np.ndarray, count: np.ndarray, segments: list[bytes]) -> list[np.ndarray]:
    """For each segment, which of its suffixes repeat, over whole buckets (``block``: numbers of the segments' buckets)."""
    size = np.array([len(s) for s in segments])
    flat = np.frombuffer(b"".join(segments) + bytes(LENGTH + 8), dtype=np.uint8)
    n = size - LENGTH + 1
    seg = np.repeat(np.arange(len(segments)), n)
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(first, n) + (np.cumsum(size) - size)[seg]
    order, same = suffix_order(flat, at, block[seg])
    hit = np.zeros(len(at), dtype=bool)
    hit[order[same]] = True
    hit[order[:-1][same[1:]]] = True
    hit |= (count > 1)[seg]
    return np.split(hit, np.cumsum(n)[:-1])


def covered(starts: np.ndarray) -> np.ndarray:
    """Merged byte ranges ``[from, to)`` under the strings that begin at ``starts`` (sorted), as rows."""
    if not len(starts):
        return np.empty((0, 2), dtype=np.int64)
    cut = np.flatnonzero(np.concatenate([[True], starts[1:] - starts[:-1] > LENGTH]))
    return np.stack([starts[cut], starts[np.concatenate([cut[1:], [len(starts)]]) - 1] + LENGTH], axis=1)


def _texts(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        values = batch.column(column).cast(pa.binary()).to_pylist()
        at = 0
        while at < len(values):
            end, size = at, 0
            while end < len(values) and (end == at or size + len(values[end]) <= most):
                size += len(values[end])
                end += 1
            yield batch.slice(at, end - at), values[at:end]
            at = end


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, n_bytes, n_removed, n_spans and kept_sha256."""
    parts = shuffle_partitions(df.sparkSession)
    base = df.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), text_of(text_col).cast("binary").alias("body"))
    base = written(base, "bodies")  # the keys are fixed from here on
    long_ones = base.where(F.octet_length("body") >= LENGTH).select("key", "body")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, "body"):
            of, _, _, _, h = anchored_runs(texts)
            order = np.lexsort((h, of))
            of, h = of[order], h[order]
            cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])]))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of[cut])), pa.array(h[cut].view(np.int64)), pa.array(np.diff(np.append(cut, len(h))), pa.int64())], names=["key", "bucket", "n"])

    found = written(long_ones.mapInArrow(anchors, "key long, bucket long, n long"), "anchors")
    # a table of its own, so that both sides of the join are shuffled and Spark can split a hot bucket
    often = written(found.groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").select("bucket"), "often")
    places = written(found.join(often, "bucket").groupBy("key").agg(F.collect_list("bucket").alias("buckets")), "places")
    drop_written(found)
    drop_written(often)
    schema = "key long, starts binary, n long, bucket long, digest binary, segment binary"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]
        for batch, texts in _texts(batches, "body", 1 << 20):
            keys, wished = batch.column("key").to_pylist(), batch.column("buckets").to_pylist()
            of, lo, hi, at, h = anchored_runs(texts)
            cols: list[list] = [[] for _ in names]
            bound = np.searchsorted(of, np.arange(len(texts) + 1))
            for t, data in enumerate(texts):
                rows = np.arange(bound[t], bound[t + 1])
                rows = rows[np.isin(h[rows].view(np.int64), np.array(wished[t]))]
                own: dict[bytes, tuple[list[int], int, bytes]] = {}
                for a, b, p, bucket in zip(lo[rows].tolist(), hi[rows].tolist(), at[rows].tolist(), h[rows].view(np.int64).tolist(), strict=True):
                    segment = data[a : b + LENGTH]
                    digest = hashlib.blake2b(segment, digest_size=16, salt=(p - a).to_bytes(4, "little")).digest()
                    if digest in own:
                        own[digest][0].append(a)
                    else:
                        own[digest] = ([a], bucket, segment)
                made = own.values()
                new = (
                    [keys[t]] * len(own), [np.array(x[0], dtype="<i4").tobytes() for x in made], [len(x[0]) for x in made],
                    [x[1] for x in made], list(own), [x[2] for x in made],
                )
                for c, v in zip(cols, new, strict=True):
                    c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    runs = written(long_ones.join(places, "key").mapInArrow(segments, schema), "segments")
    different = runs.groupBy("bucket", "digest").agg(F.sum("n").alias("n"), F.first("segment").alias("segment"))
    different = written(different.select("bucket", "digest", F.lit(0).alias("at"), "n", "segment"), "buckets")
    light, todo = None, different
    for level in range(1, LEVELS + 2):
        heavy = written(todo.groupBy("bucket").count().where(F.col("count") > HEAVY).select("bucket"), "heavy")
        if heavy.isEmpty():
            light = todo if light is None else light.union(todo)
            todo = None
            break
        rest = todo.join(heavy, "bucket", "left_anti")
        light = rest if light is None else light.union(rest)
        todo = todo.join(heavy, "bucket", "left_semi")
        if level <= LEVELS:
            todo = written(todo.mapInArrow(_dealt_again(level), todo.schema), "buckets")
    flagged = light.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_buckets, "digest binary, spans binary")
    if todo is not None:
        flagged = flagged.union(_by_ranges(todo))
    flagged = written(flagged, "flagged")
    drop_written(different)
    per_doc = runs.select("key", "starts", "digest").join(flagged, "digest").groupBy("key").agg(F.collect_list("starts").alias("starts"), F.collect_list("spans").alias("spans"))
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, spans, digest = [], [], [], []
            for body, starts, hits in zip(*(batch.column(c).to_pylist() for c in ("body", "starts", "spans")), strict=True):
                size.append(len(body))
                if not starts:
                    removed.append(0)
                    spans.append(0)
                    digest.append(hashlib.sha256(body).hexdigest())
                    continue
                out = removed_bytes(len(body), starts, hits)
                removed.append(int(out.sum()))
                spans.append(int(np.count_nonzero(np.diff(out.astype(np.int8), prepend=0) == 1)))
                digest.append(hashlib.sha256(np.frombuffer(body, dtype=np.uint8)[~out].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(digest, pa.string())], names=names)

    return base.join(per_doc, "key", "left").select("id", "body", "starts", "spans").mapInArrow(cut, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def removed_bytes(n: int, starts: list[bytes], hits: list[bytes]) -> np.ndarray:
    """Which of ``n`` bytes lie under a segment's hits (ranges within it) at one of its starts."""
    begin, end = [], []
    many = [k for k, x in enumerate(starts) if len(x) > 4]
    for k in many:
        at, span = np.frombuffer(starts[k], dtype="<i4"), np.frombuffer(hits[k], dtype="<i4").reshape(-1, 2)
        begin.append((at[:, None] + span[:, 0]).ravel())
        end.append((at[:, None] + span[:, 1]).ravel())
    if len(many) < len(starts):
        one = [k for k, x in enumerate(starts) if len(x) == 4]
        at = np.frombuffer(b"".join(starts[k] for k in one), dtype="<i4")
        span = np.frombuffer(b"".join(hits[k] for k in one), dtype="<i4").reshape(-1, 2)
        at = np.repeat(at, [len(hits[k]) // 8 for k in one])
        begin.append(at + span[:, 0])
        end.append(at + span[:, 1])
    gone = np.bincount(np.concatenate(begin), minlength=n + 1) - np.bincount(np.concatenate(end), minlength=n + 1)
    return np.cumsum(gone)[:n] > 0


def _flagged(digests: list[bytes], ats: list[int], hits: list[np.ndarray]) -> pa.RecordBatch:
    keep = [i for i, x in enumerate(hits) if x.any()]
    spans = [(covered(np.flatnonzero(hits[i])) + ats[i]).astype("<i4").tobytes() for i in keep]
    return pa.RecordBatch.from_arrays([pa.array([digests[i] for i in keep], pa.binary()), pa.array(spans, pa.binary())], names=["digest", "spans"])


def _sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole buckets, of ``BLOCK_BYTES`` and what the last bucket has beyond."""
    held: list[list] = [[], [], [], [], []]

    def done(lo: int, hi: int) -> pa.RecordBatch:
        bucket, digest, at, count, segment = (c[lo:hi] for c in held)
        return _flagged(digest, at, repeating(np.unique(bucket, return_inverse=True)[1], np.array(count), segment))

    for batch in batches:
        for c, name in zip(held, ("bucket", "digest", "at", "n", "segment"), strict=True):
            c += batch.column(name).to_pylist()
        bucket, size = np.array(held[0]), np.cumsum([len(x) for x in held[4]])
        ends = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1  # the last bucket may go on
        lo = 0
        while True:
            hi = ends[np.searchsorted(size[ends - 1], (size[lo - 1] if lo else 0) + BLOCK_BYTES) :]
            if not len(hi):
                break
            yield done(lo, int(hi[0]))
            lo = int(hi[0])
        for c in held:
            del c[:lo]
    if held[0]:
        yield done(0, len(held[0]))


def _dealt_again(level: int):
    """Splits the segments of heavy buckets into shorter ones by another anchor: equal suffixes share that one too."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, segments in _texts(batches, "segment", 1 << 20):
            bucket, at = batch.column("bucket").to_numpy().view(np.uint64), batch.column("at").to_numpy()
            of, lo, hi, _, h = anchored_runs(segments, level)
            with np.errstate(over="ignore"):
                new = mix64(bucket[of] ^ mix64(h + np.uint64(level)))
            made = [segments[t][a : b + LENGTH] for t, a, b in zip(of.tolist(), lo.tolist(), hi.tolist(), strict=True)]
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), batch.column("digest").take(take), pa.array((at[of] + lo).astype(np.int32)), batch.column("n").take(take), pa.array(made, pa.binary())], names=["bucket", "digest", "at", "n", "segment"])

    return split


def _by_ranges(segments: DataFrame) -> DataFrame:
    """Buckets that no anchor splits, suffix by suffix with their bytes, which Spark groups over all tasks."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches, "segment", 1 << 18):
            n = np.array([len(x) - LENGTH + 1 for x in texts])
            of = np.repeat(np.arange(len(texts)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            made = [texts[t][a : a + LENGTH] for t, a in zip(of.tolist(), at.tolist(), strict=True)]
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([batch.column("bucket").take(take), batch.column("digest").take(take), pa.array((at + batch.column("at").to_numpy()[of]).astype(np.int32)), batch.column("n").take(take), pa.array(made, pa.binary())], names=["bucket", "digest", "at", "n", "suffix"])

    each = written(segments.mapInArrow(suffixes, "bucket long, digest binary, at int, n long, suffix binary"), "suffixes")
    repeated = written(each.groupBy("bucket", "suffix").agg(F.sum("n").alias("all")).where("all > 1").select("bucket", "suffix"), "repeated")
    starts = each.join(repeated, ["bucket", "suffix"]).groupBy("digest").agg(F.array_sort(F.collect_set("at")).alias("ats"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [covered(np.array(x)).astype("<i4").tobytes() for x in batch.column("ats").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(made, pa.binary())], names=["digest", "spans"])

    return starts.mapInArrow(spans, "digest binary, spans binary")


def query(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
