"""Conversation prefix trie: what sharing prefixes would save, by smallest-member ownership.

A node is a distinct sequence of first turns (role, text); its members are the conversations that begin with it, and its
owner is the smallest of them. A conversation that owns a node is a member of, and the smallest in, every deeper node on
its path that it is in: what it owns is a suffix of its path. So each subtree's sums come from its members alone:

1. Turns are sorted by range, not by conversation, and numbered from the runs of each range, so a conversation may be of
   any length. Each conversation's path is rebuilt (:func:`rebuilt`).
2. A node's key is a digest of the sums, over the turns before it, of 128 hash bits of (turn, depth): running sums by
   stretches of ``STRETCH`` turns plus what earlier stretches carry.
3. Windows mark owned nodes: first within (node, salt), then among the salts' first members, so that a node whose members
   are a third of all conversations is no single task's sort.
4. One group-by of keys adds, over a node's members, the tokens that occur at or below it less those of owned turns (what
   is left are the tokens of turns that a smaller member owns: the saved ones) and the flags of owned leaves.
5. A node below its owner's first owned one has that owner's node as its parent. Only the first owned nodes, one a
   conversation, look their parents up.
6. Ids of conversations that end at a node are sorted by range into blocks, whose texts are hashed in order as a stream.

Tokens are code points. Defined cases: null roles and texts are empty; null turns come first; rows of one turn number go
by role, then text, and repeated rows are turns of their own; rows without a conversation id belong to no conversation and
are left out; ``%`` rounds to zero for negative ids; an empty table has no root and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, text_of, written

FAMILY = 100
MOST_LEAD = 6
STRETCH = 4096
LANES = 4
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 1), body (digest of role and text) and chars of every turn; and ``own``, its conversation's turns."""
    n = shuffle_partitions(df.sparkSession)
    role, text = text_of(role_col), text_of(text_col)
    keys = ["conv", "turn", "role", "text", "tie"]
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("tie"))
    body = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    turns = written(
        rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("conv", body.alias("body"), F.length("text").cast("long").alias("chars"), F.monotonically_increasing_id().alias("seq")),
        "turns",
    ).withColumn("span", F.shiftright("seq", 33))
    by_span = W.partitionBy("conv").orderBy("span")
    runs = turns.groupBy("conv", "span").agg(F.min("seq").alias("first"), F.count("*").alias("rows"))
    runs = runs.withColumns({"before": F.sum("rows").over(by_span) - F.col("rows"), "own": F.sum("rows").over(W.partitionBy("conv"))})
    return turns.join(runs, ["conv", "span"]).select("conv", (F.col("seq") - F.col("first") + F.col("before") + 1).alias("pos"), "body", "chars", "own")


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv, d, body, chars, len: the paths by depth, the root (d = 0) included.

    The first h turns of conversation ``c - c % 100`` (all if fewer, none if absent), then c's own turns after its first
    h; h is ``crc32(c) % 6``. Only conversations of these ids meet their family, by at most five turns each.
    """
    convs = turns.where("pos = 1").select("conv", "own", (F.crc32(F.col("conv").cast("string")) % MOST_LEAD).alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("family"))
    heads = turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") < MOST_LEAD)).select(F.col("conv").alias("family"), "pos", "body", "chars", F.least("own", F.lit(MOST_LEAD - 1)).alias("there"))
    lead = F.least("h", F.coalesce("there", F.lit(0)))
    convs = convs.join(heads.where("pos = 1").select("family", "there"), "family", "left").select("conv", "family", "h", lead.alias("lead"), (lead + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    root = convs.select("conv", F.lit(0).cast("long").alias("d"), F.lit("").alias("body"), F.lit(0).cast("long").alias("chars"), "len")
    shared = convs.join(heads.drop("there"), "family").where("pos <= lead").select("conv", F.col("pos").alias("d"), "body", "chars", "len")
    own = turns.select("conv", "pos", "body", "chars").join(convs, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("lead")).alias("d"), "body", "chars", "len")
    return root.unionByName(shared).unionByName(own)


def keyed(paths: DataFrame) -> DataFrame:
    """conv, d, len, node and up (the keys of the node and its parent), before (tokens of the turns above) and chars."""
    mixed = F.md5(F.concat_ws(":", "body", F.col("d").cast("string")))
    lanes = [f"lane{i}" for i in range(LANES)]
    sums = [*lanes, "chars"]
    paths = written(
        paths.withColumn("mixed", mixed).select("conv", "d", "len", "chars", F.floor(F.col("d") / STRETCH).alias("stretch"), *[F.when(F.col("d") > 0, F.conv(F.substring("mixed", 8 * i + 1, 8), 16, 10).cast("long")).otherwise(F.lit(0)).alias(c) for i, c in enumerate(lanes)]),
        "paths",
    )
    by_stretch = W.partitionBy("conv").orderBy("stretch")
    carried = paths.where(F.col("len") >= STRETCH).groupBy("conv", "stretch").agg(*[F.sum(c).alias(c) for c in sums])
    carried = carried.select("conv", "stretch", *[(F.sum(c).over(by_stretch) - F.col(c)).alias(f"{c}_in") for c in sums])
    running = W.partitionBy("conv", "stretch").orderBy("d")
    total = {c: F.sum(c).over(running) + F.coalesce(F.col(f"{c}_in"), F.lit(0)) for c in sums}
    rows = paths.join(carried, ["conv", "stretch"], "left").select("conv", "d", "len", "chars", *lanes, *[v.alias(f"{c}_to") for c, v in total.items()])

    def key(depth: Column, parts: list[Column]) -> Column:
        return F.unhex(F.md5(F.concat_ws(",", *[x.cast("string") for x in [depth, *parts]])))

    node = key(F.col("d"), [F.col(f"{c}_to") for c in lanes])
    up = F.when(F.col("d") > 0, key(F.col("d") - 1, [F.col(f"{c}_to") - F.col(c) for c in lanes]))
    return rows.select("conv", "d", "len", node.alias("node"), up.alias("up"), (F.col("chars_to") - F.col("chars")).alias("before"), "chars")


def marked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``owned`` (conv is its node's smallest member) and ``leaf`` (owned, and no member goes further)."""
    salt = F.pmod(F.xxhash64("conv"), F.lit(shuffle_partitions(rows.sparkSession)))
    part = W.partitionBy("node", "salt")
    rows = rows.withColumn("salt", salt).withColumns({"first": F.row_number().over(part.orderBy("conv")) == 1, "longest": F.max("len").over(part)})
    rows = rows.withColumn("salt", F.when(F.col("first"), F.lit(-1)).otherwise(F.col("salt")))
    rows = rows.withColumns({"owned": F.col("first") & (F.row_number().over(part.orderBy("conv")) == 1), "longest": F.max("longest").over(part)})
    return rows.withColumn("leaf", F.col("owned") & (F.col("longest") == F.col("d"))).drop("salt", "first", "longest")


def ends(rows: DataFrame) -> DataFrame:
    """node, ends_sha256: the ids that end at each node, ascending, comma-joined and hashed as a stream."""
    n = shuffle_partitions(rows.sparkSession)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, conv = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cut = [0, *[i for i in range(1, len(node)) if node[i] != node[i - 1]], len(node)] if node else [0]
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([node[a] for a, _ in spans], pa.binary()), pa.array([conv[a] for a, _ in spans], pa.int64()), pa.array([",".join(map(str, conv[a:b])) for a, b in spans], pa.string())], names=["node", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_node, sha = None, None
        for batch in batches:
            nodes, shas = [], []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if node == open_node:
                    sha.update(b"," + ids.encode())
                    continue
                if sha is not None:
                    nodes.append(open_node)
                    shas.append(sha.hexdigest())
                open_node, sha = node, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(shas, pa.string())], names=["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_node], pa.binary()), pa.array([sha.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    last = rows.where("d = len").select("node", "conv")
    runs = last.repartitionByRange(n, "node", "conv").sortWithinPartitions("node", "conv").mapInArrow(blocks, "node binary, first long, ids string")
    return runs.repartition(n, "node").sortWithinPartitions("node", "first").mapInArrow(digests, "node binary, ends_sha256 string")


def trie(paths: DataFrame) -> DataFrame:
    """The nodes of paths (conv, d, body, chars, len; with a row of d = 0 each)."""
    rows = written(marked(keyed(paths)), "marked")
    per_conv = rows.groupBy("conv").agg(
        F.coalesce(F.min(F.when(F.col("owned"), F.col("before"))), F.max(F.col("before") + F.col("chars"))).alias("shared"),
        F.min(F.when(F.col("owned"), F.col("d"))).alias("top"),
        F.max(F.col("leaf").cast("long")).alias("leaf"),
    )
    # tokens of turns at or below the node less the owned among them
    unowned = F.greatest(F.col("shared") - F.col("before"), F.lit(0))
    nodes = written(
        rows.drop("leaf").join(per_conv, "conv").groupBy("node").agg(
            F.min("conv").alias("conv_id"), F.min("d").alias("depth"), F.first("up").alias("up"), F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(unowned).alias("saved_tokens"),
            F.max(F.when(F.col("owned"), (F.col("len") > F.col("d")).cast("long"))).alias("own_child"), F.max(F.col("owned") & (F.col("top") == F.col("d"))).alias("is_top"),
        ),
        "nodes",
    )
    tops = nodes.where("is_top and depth > 0")
    parents = nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.where("is_top").join(parents, "up", "left").select(*nodes.columns, "parent_conv_id")
    inner = nodes.where("not is_top").withColumn("parent_conv_id", F.col("conv_id"))
    children = tops.groupBy(F.col("up").alias("node")).agg(F.count("*").alias("others"))
    return (
        linked.unionByName(inner).join(children, "node", "left").join(ends(rows), "node", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", (F.col("own_child") + F.coalesce("others", F.lit(0))).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(numbered(table(spark, sf_dir, "conversations"))))


ORACLE = """WITH
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
  length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS body, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS family, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor((xor(a, b) >> 1), CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, pos, body, chars, 0 AS own FROM h JOIN t ON t.c = h.family AND pos <= h.h UNION ALL SELECT t.c, pos, body, chars, 1 FROM t JOIN h ON t.c = h.c AND pos > h.h),
p AS (SELECT c, d, chars, array_to_string(list(sha256(body)) OVER (PARTITION BY c ORDER BY d), ',') AS k FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d FROM r)
  UNION ALL SELECT c, 0, 0, '' FROM h),
len AS (SELECT c, max(d) AS len FROM p GROUP BY c),
n AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, list(c ORDER BY c) FILTER (d = len) AS ends FROM p JOIN len USING (c) GROUP BY d, k),
below AS (SELECT DISTINCT a.k AS k, b.k AS kb FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d),
kids AS (SELECT a.k AS k, min(pn.conv_id) AS parent, a.d AS d, pn.k AS pk FROM n a JOIN p x ON x.k = a.k AND x.c = a.conv_id JOIN p y ON y.c = x.c AND y.d = x.d - 1 JOIN n pn ON pn.k = y.k GROUP BY ALL),
counts AS (SELECT pk AS k, count(*) AS n_children FROM kids GROUP BY pk),
sums AS (SELECT b.k, sum((u.n_convs - 1) * u.chars)::BIGINT AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves FROM below b JOIN n u ON u.k = b.kb LEFT JOIN counts c ON c.k = u.k GROUP BY b.k)
SELECT n.conv_id, n.d::BIGINT AS depth, kids.parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(array_to_string(ends, ','), '')) AS ends_sha256
FROM n LEFT JOIN kids USING (k) LEFT JOIN counts USING (k) JOIN sums USING (k)"""
