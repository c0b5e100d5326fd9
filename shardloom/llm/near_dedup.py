"""MinHash near-deduplication: a Chosen-Path set similarity join.

1. One pass over the texts gives each document's shingle set size, a digest of the set and ``T`` minwise values.
   Equal sets collapse to one class each, pre-aggregated where they are read.
2. Each class is branched by its selected minwise tokens: token ``(i, value)`` is taken at a node when a hash of the
   node's path and the token falls below ``1 / (threshold * T)``. ``TREES`` independent trees bring the chance that a
   pair at the threshold never meets below 0.04 %.
3. Small nodes are compared exhaustively on 4-bit sketches, with a cut 4.5 deviations below the threshold; large ones
   branch further. What a node gives is linear in it: ties of each candidate cluster to its first member.
4. Candidate clusters are merged over all nodes. Their full shingle sets are made once and meet in groups, where links
   are confirmed exactly (one set against all those not reached yet). Large groups are dealt to blocks that share a few
   pivots; what these tie is contracted, and only blocks of different contracted components meet again. Components of
   the confirmed links are the answer. No pair list of documents is ever written, no candidate is capped.

A document is a row; its id only names it. Defined cases: texts without words have an empty set, link with nothing and
are kept; null ids rank after all others (a group of null ids alone has a null component_id, and one row of it is kept);
rows with equal ids and different texts are documents of their own that share a name (:func:`near_dedup` marks those
whose id is their group's component_id, :func:`near_dedup_rows` keeps one row a group); extra columns are ignored by
:func:`near_dedup` and carried by :func:`near_dedup_rows`; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, batch_shingles, mix64, row_key, shuffle_partitions, text_of, unused, written
from .components import components

T = 64
TREES = 9
SMALL_NODE = 512
MATRIX_NODE = 4096
FRONTIER_SEEDS = 4
HEAVY_NODE = 4096
VAST_NODE = 32_768
MAX_DEPTH = 6
REPEATS = 4
BLOCK = 512
BLOCK_BYTES = 16 << 20
PIVOTS = 32

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 2**63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, T, dtype=np.uint64)
_SEED = np.uint64(0xD1B54A32D192ED03)


def minwise(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minwise values (32 bits) of each non-empty set, ``(sets, T)``; sets are taken in runs that fit the cache."""
    starts = offsets[:-1]
    out = np.empty((len(starts), T), dtype=np.uint32)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + 60_000, side="right")) - 1)
        part, at = hashes[offsets[lo] : offsets[hi]], starts[lo:hi] - offsets[lo]
        with np.errstate(over="ignore"):
            for i in range(T):
                out[lo:hi, i] = np.minimum.reduceat(part * _A[i] + _B[i], at) >> np.uint64(32)
        lo = hi
    return out


def nibbles(sig: np.ndarray) -> np.ndarray:
    """Sketches: 4 mixed bits of every minwise value, ``(rows, T)``."""
    with np.errstate(over="ignore"):
        return (mix64(sig.astype(np.uint64) + np.arange(1, T + 1, dtype=np.uint64) * _SEED) >> np.uint64(60)).astype(np.uint8)


def pack(n: np.ndarray) -> np.ndarray:
    return (n[:, 0::2] << 4) | n[:, 1::2]


def unpack(p: np.ndarray) -> np.ndarray:
    out = np.empty((len(p), T), dtype=np.uint8)
    out[:, 0::2], out[:, 1::2] = p >> 4, p & 15
    return out


def branch(path: np.ndarray, tokens: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows that branch and the child node of each: tokens whose hash with the path is below ``1/(threshold T)``."""
    with np.errstate(over="ignore"):
        h = mix64(path[:, None] ^ mix64(tokens.astype(np.uint64) * _SEED + np.arange(1, T + 1, dtype=np.uint64)[None, :]))
        row, i = np.nonzero(h < np.uint64(int(2**64 / (threshold * T))))
        return row, mix64(h[row, i] + path[row] * _SEED)


def least_agreement(threshold: float) -> int:
    """Equal nibbles of 64 that a pair at the threshold has but for 4.5 deviations."""
    p = threshold + (1 - threshold) / 16
    return int(np.floor(T * p - 4.5 * np.sqrt(T * p * (1 - p))))


def _onehot(n: np.ndarray) -> np.ndarray:
    out = np.zeros((len(n), T * 16), dtype=np.float32)
    out[np.arange(len(n))[:, None], np.arange(T) * 16 + n] = 1
    return out


def _product_clusters(hot: np.ndarray, least: int) -> np.ndarray:
    label = np.full(len(hot), -1)
    near = np.empty((len(hot), len(hot)), dtype=bool)
    for lo in range(0, len(hot), 512):
        near[lo : lo + 512] = (hot[lo : lo + 512] @ hot.T) >= least
    for seed in range(len(hot)):
        if label[seed] < 0:
            label[seed], frontier = seed, near[seed] & (label < 0)
            frontier[seed] = False
            while frontier.any():
                label[frontier] = seed
                frontier = near[frontier].any(axis=0) & (label < 0)
    return label


def clusters(n: np.ndarray, least: int) -> np.ndarray:
    """Single-linkage labels (the first row of each component) by equal nibbles: frontiers are compared with what has
    not been reached yet. Once ``FRONTIER_SEEDS`` components are known, up to ``MATRIX_NODE`` rows left take one product."""
    label = np.full(len(n), -1)
    hot, left, seeds = _onehot(n), np.arange(len(n)), 0
    while len(left):
        if seeds >= FRONTIER_SEEDS and len(left) <= MATRIX_NODE:
            label[left] = left[_product_clusters(hot[left], least)]
            break
        seed, left, seeds = left[0], left[1:], seeds + 1
        label[seed], frontier = seed, np.array([seed])
        while len(frontier) and len(left):
            near = np.zeros(len(left), dtype=bool)
            now, frontier = frontier[:64], frontier[64:]
            for at in range(0, len(left), 4096):
                near[at : at + 4096] = ((hot[now] @ hot[left[at : at + 4096]].T) >= least).any(axis=0)
            label[left[near]] = seed
            frontier, left = np.concatenate([frontier, left[near]]), left[~near]
    return label


def node_ties(node: np.ndarray, doc: np.ndarray, sketch: np.ndarray, threshold: float, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Ties (document, first document of its cluster) of all nodes in sorted arrays."""
    least, a, b = least_agreement(threshold), [], []
    edge = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
    size = np.diff(edge)
    rows_size = np.repeat(size, size)
    small = np.flatnonzero((rows_size > 1) & (rows_size <= 16))
    if len(small):  # all pairs of small nodes at once, by their distance in the order
        n, d, of = unpack(sketch[small]), doc[small], node[small]
        x, y = [], []
        for k in range(1, 16):
            i = np.flatnonzero(of[k:] == of[:-k])
            if not len(i):
                break
            i = i[(n[i] == n[i + k]).sum(axis=1) >= least]
            x.append(i)
            y.append(i + k)
        x, y = np.concatenate(x), np.concatenate(y)
        label = np.arange(len(d))
        while True:
            low = np.minimum(label[x], label[y])
            was = label.copy()
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            label = label[label]
            if (label == was).all():
                break
        tied = np.flatnonzero(label != np.arange(len(d)))
        a.append(d[tied])
        b.append(d[label[tied]])
    for k in np.flatnonzero(size > 16):
        at = slice(edge[k], edge[k + 1])
        n, d = unpack(sketch[at]), doc[at]
        m = len(d)
        step = n[:: max(1, m // 64)]
        dense = (step[:-1] == step[1:]).mean() > 0.4
        if m <= SMALL_NODE or dense or depth >= MAX_DEPTH:
            label = clusters(n, least)
            tied = np.flatnonzero(label != np.arange(m))
            a.append(d[tied])
            b.append(d[label[tied]])
            continue
        for repeat in range(REPEATS):
            with np.errstate(over="ignore"):
                path = np.full(m, mix64(node[at][:1] + np.uint64(repeat + 1)))
            row, child = branch(path, n, threshold)
            order = np.argsort(child, kind="stable")
            row, child = row[order], child[order]
            if len(row):
                p, q = node_ties(child, d[row], sketch[at][row], threshold, depth + 1)
                a.append(p)
                b.append(q)
    if not a:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
    return both[0], both[1]


def _bytes_matrix(column: pa.Array, width: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def linked(sets: list[np.ndarray], threshold_pct: int, known: np.ndarray | None = None) -> np.ndarray:
    """Labels of the components of ``100 * intersection >= pct * union`` among full sets, exactly. Sets with equal
    ``known`` are taken as one component from the start, and not compared with each other."""
    m, label = len(sets), np.full(len(sets), -1)
    known = np.arange(m) if known is None else known
    sizes = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark, left = np.zeros(int(code.max()) + 1, dtype=np.int32), np.arange(m)
    while len(left):
        seed = left[0]
        label[seed], near = seed, known[left] == known[seed]
        frontier, left = left[near].tolist(), left[~near]
        label[frontier] = seed
        while frontier and len(left):
            i = frontier.pop()
            own = code[starts[i] : starts[i] + sizes[i]]
            fit = left[(sizes[left] * 100 >= threshold_pct * sizes[i]) & (sizes[i] * 100 >= threshold_pct * sizes[left])]
            if not len(fit):
                continue
            mark[own] = 1
            if len(fit) * 2 > m:
                both = np.add.reduceat(mark[code], starts)[fit]
            else:
                both = np.array([mark[code[starts[j] : starts[j] + sizes[j]]].sum() for j in fit])
            mark[own] = 0
            near = fit[100 * both >= threshold_pct * (sizes[i] + sizes[fit] - both)]
            if len(near):
                reached = np.isin(known[left], known[near])
                label[left[reached]] = seed
                frontier += left[reached].tolist()
                left = left[~reached]
    return label


def _links(groups: DataFrame, keys: list[str], threshold_pct: int) -> DataFrame:
    """Ties (node, first node of its component) of all groups of full sets, rows (keys, node, known, hashes)."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, known, sets = None, [], [], []

        def done() -> pa.RecordBatch:
            label, ids = linked(sets, threshold_pct, np.unique(known, return_inverse=True)[1]), np.array(nodes)
            tied = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[label[tied]])], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            rest = (batch.column(c).to_pylist() for c in ("node", "known", "hashes"))
            for key, node, sub, hashes in zip(zip(*columns, strict=True), *rest, strict=True):
                if key != now:
                    if len(sets) > 1:
                        yield done()
                    now, nodes, known, sets = key, [], [], []
                nodes.append(node)
                known.append(sub)
                sets.append(np.frombuffer(hashes, dtype="<u8"))
        if len(sets) > 1:
            yield done()

    rows = groups.select(*keys, "node", "known", "hashes").repartition(shuffle_partitions(groups.sparkSession), *keys)
    return rows.sortWithinPartitions(*keys).mapInArrow(confirm, "a long, b long")


def _confirmed(sets: DataFrame, threshold_pct: int) -> DataFrame:
    """Exact links within candidate groups, from ``sets(component, blocks, members, node, hashes)``.

    Groups of one block are compared whole. In larger ones each block is first compared with itself and a few pivots
    that all blocks of the group share; what that links is contracted. Blocks are then made anew, of one contracted
    component each where it fills them, and only pairs of blocks that may still link different components meet."""
    whole = sets.where("blocks = 1").select("component", F.lit(0).alias("s"), "node", F.col("node").alias("known"), "hashes")
    large = sets.where("blocks > 1")
    pivot = F.pmod(F.xxhash64("node", F.lit(3)), "members") < PIVOTS
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    dealt = large.withColumn("s", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    first = written(_links(whole.union(dealt.select("component", "s", "node", F.col("node").alias("known"), "hashes")), ["component", "s"], threshold_pct), "links")
    light = large.select("component", "node", F.octet_length("hashes").alias("bytes"))
    if light.isEmpty():
        return first
    joined = components(first)
    light = light.join(joined.select("node", F.col("component").alias("found")), "node", "left").withColumn("known", F.coalesce("found", "node"))
    parts = written(light.groupBy("component", "known").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b")), "parts")
    fills = (F.col("n") >= BLOCK) | (F.col("b") >= BLOCK_BYTES)
    parts = parts.withColumn("big", F.when(fills, F.col("known")))
    size = lambda n, b: F.greatest(F.ceil(F.sum(n) / BLOCK), F.ceil(F.sum(b) / BLOCK_BYTES)).cast("int")
    many = parts.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("component")
    bins = written(parts.join(many, "component").groupBy("component", "big").agg(size("n", "b").alias("bins")), "bins")
    if bins.isEmpty():
        return first
    placed = light.join(parts.select("component", "known", "big"), ["component", "known"]).join(bins.withColumnRenamed("big", "of"), (F.col("of").eqNullSafe(F.col("big"))) & (bins["component"] == light["component"])).drop(bins["component"])
    placed = placed.select("component", "node", "known", "big", F.pmod(F.xxhash64("known", "node"), "bins").cast("int").alias("bin"))
    blocks = bins.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1))).select("component", "big", "bin", F.xxhash64("big", "bin").alias("block"))
    x, y = blocks.alias("x"), blocks.alias("y")
    apart = F.col("x.big").isNull() | F.col("y.big").isNull() | (F.col("x.big") != F.col("y.big"))
    pairs = x.join(y, (F.col("x.component") == F.col("y.component")) & (F.col("x.block") <= F.col("y.block")) & apart)
    pairs = pairs.where("x.block < y.block or x.big is null").select(F.col("x.component").alias("component"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = pairs.select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    met = placed.withColumn("block", F.xxhash64("big", "bin")).join(sides, ["component", "block"]).select("component", "i", "j", "node", "known")
    second = _links(met.join(large.select("node", "hashes"), "node"), ["component", "i", "j"], threshold_pct)
    return first.union(second)


def _found(df: DataFrame, id_col: str, text_col: str, words: int, threshold_pct: int) -> tuple[DataFrame, DataFrame]:
    """The written rows (id, rk, key, n, digest) and, per set digest, its component's first row ``best`` (no, id, rk, key)."""
    spark, threshold = df.sparkSession, threshold_pct / 100
    parts = shuffle_partitions(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("rk"), text_of(text_col).alias("text"))

    def sliced(texts: list[bytes]) -> Iterator[tuple[int, int]]:
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < 4 << 20:
                size += len(texts[end])
                end += 1
            yield at, end
            at = end

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for at, end in sliced(texts):
                h, off = batch_shingles(texts[at:end], words)
                n = np.diff(off)
                full = np.flatnonzero(n)
                sig, digest = [None] * len(n), [None] * len(n)
                if len(full):
                    values = minwise(h, np.concatenate([off[full], off[-1:]]))
                    for k, i in enumerate(full):
                        sig[i] = values[k].tobytes()
                        digest[i] = hashlib.blake2b(h[off[i] : off[i + 1]].tobytes(), digest_size=16).digest()
                some = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("rk"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], names=["id", "rk", "n", "digest", "sig"])

    rows = docs.mapInArrow(signatures, "id long, rk binary, n long, digest binary, sig binary").withColumn("key", F.monotonically_increasing_id())
    rows = written(rows, "signatures")
    best = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "rk", "key")).alias("best")
    classes = rows.where("n > 0").groupBy("digest").agg(best, F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ids = _bytes_matrix(batch.column("sig"), T, "<u4"), batch.column("node").to_numpy()
            if not len(ids):
                continue
            packed = pack(nibbles(values))
            for tree in range(TREES):
                path = mix64(np.full(len(ids), tree + 1, dtype=np.uint64))
                row, child = branch(path, values, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[row]), pa.array([x.tobytes() for x in packed[row]], pa.binary())], names=["node", "id", "sketch"])

    nodes = classes.select("node", "sig").mapInArrow(roots, "node long, id long, sketch binary")
    nodes = _split_heavy(nodes, threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def done(rows: list) -> pa.RecordBatch:
            node, doc, sketch = (np.concatenate(x) for x in zip(*rows, strict=True))
            a, b = node_ties(node, doc, sketch, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column("node").to_numpy().view(np.uint64), batch.column("id").to_numpy(), _bytes_matrix(batch.column("sketch"), T // 2, "u1")))
            if sum(len(x[0]) for x in held) >= 100_000:
                node, doc, sketch = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.flatnonzero(node != node[-1])[-1]) + 1 if node[0] != node[-1] else 0
                if cut:
                    yield done([(node[:cut], doc[:cut], sketch[:cut])])
                held = [(node[cut:], doc[cut:], sketch[cut:])]
        if held:
            yield done(held)

    ties = nodes.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(compare, "a long, b long")
    groups = components(ties).join(classes.select("node", "n", F.col("best.rk").alias("rk")), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    groups = written(groups, "groups")
    sized = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"), blocks.alias("blocks"))
    wanted = written(groups.join(sized, "component").select("component", "blocks", "members", "node", "rk"), "members")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for at, end in sliced(texts):
                h, off = batch_shingles(texts[at:end], words)
                made = [h[a:b].astype("<u8").tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(at, end - at).columns[:4], pa.array(made, pa.binary())], names=["component", "blocks", "members", "node", "hashes"])

    texts = docs.select("rk", "text").join(wanted.hint("merge"), "rk")  # the same plan at every size
    texts = texts.select("component", "blocks", "members", "node", "text")
    sets = texts.mapInArrow(shingled, "component long, blocks int, members long, node long, hashes binary")
    # repeated rows share a key: one of each
    sets = sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("component", "blocks", "members", "hashes")])
    sets = written(sets, "sets")
    joined = components(_confirmed(sets, threshold_pct))
    own = classes.select("node", "digest", "best").join(joined, "node", "left").withColumn("c", F.coalesce("component", "node"))
    names = own.groupBy("c").agg(F.min("best").alias("best"))
    return rows.select("id", "rk", "key", "n", "digest"), own.select("digest", "c").join(names, "c").select("digest", "best")


def near_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold_pct: int = 80,
) -> DataFrame:
    """Per row: ``id_col``, n_shingles, component_id (smallest id reachable by links) and kept."""
    rows, named = _found(df, id_col, text_col, words, threshold_pct)
    out = rows.join(named, "digest", "left")
    component = F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id"))
    kept = F.col("best").isNull() | F.when(F.col("best.id").isNull(), F.col("key") == F.col("best.key")).otherwise(F.col("id").eqNullSafe(F.col("best.id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _split_heavy(nodes: DataFrame, threshold: float) -> DataFrame:
    """Nodes beyond ``HEAVY_NODE`` rows are dealt as pairs of blocks, so that no task reads a whole one; those beyond
    ``VAST_NODE`` branch further first, and what stays that large (documents alike in most tokens) is dealt alike."""

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, ids, packed = batch.column("node").to_numpy().view(np.uint64), batch.column("id").to_numpy(), _bytes_matrix(batch.column("sketch"), T // 2, "u1")
            for repeat in range(REPEATS):
                with np.errstate(over="ignore"):
                    row, child = branch(mix64(node + np.uint64(repeat + 1)), unpack(packed), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[row]), pa.array([x.tobytes() for x in packed[row]], pa.binary())], names=["node", "id", "sketch"])

    def in_blocks(rows: DataFrame, heavy: DataFrame) -> DataFrame:
        g = F.ceil(F.col("count") / (HEAVY_NODE // 2)).cast("int")
        rows = rows.join(heavy, "node").withColumn("g", g).withColumn("s", F.pmod(F.xxhash64("id"), "g").cast("int"))
        rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        return rows.select(F.xxhash64("node", F.least("s", "o"), F.greatest("s", "o")).alias("node"), "id", "sketch")

    out, depth = None, 0
    while True:
        heavy = written(nodes.groupBy("node").count().where(F.col("count") > HEAVY_NODE), "heavy")
        if heavy.isEmpty():
            return nodes if out is None else out.union(nodes)
        nodes = written(nodes, "nodes")
        light = nodes.join(heavy, "node", "left_anti")
        last = depth == MAX_DEPTH // 2
        light = light.union(in_blocks(nodes, heavy if last else heavy.where(F.col("count") <= VAST_NODE)))
        out = light if out is None else out.union(light)
        vast = heavy.where(F.col("count") > VAST_NODE)
        if last or vast.isEmpty():
            return out
        nodes, depth = nodes.join(vast.select("node"), "node", "left_semi").mapInArrow(deeper, "node long, id long, sketch binary"), depth + 1


def near_dedup_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold_pct: int = 80) -> DataFrame:
    """One row of each group (the smallest id; null ids last), with all its columns, and every row without words."""
    rows, named = _found(df, id_col, text_col, words, threshold_pct)
    rk, blank = unused(df, "_rk"), F.btrim(text_of(text_col), F.lit(WS_CHARS)) == ""
    kept = named.select(F.col("best.rk").alias(rk)).distinct()
    many = written(rows.where("n > 0").groupBy("rk").count().where("count > 1").select(F.col("rk").alias(rk)), "repeated")
    stay = df.where(~blank).withColumn(rk, row_key(id_col, text_col)).join(kept, rk, "left_semi")
    if not many.isEmpty():  # rows that repeat id and text: one of them
        stay = stay.join(many, rk, "left_anti").union(stay.join(many, rk, "left_semi").dropDuplicates([rk]))
    return stay.drop(rk).union(df.where(blank))


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
