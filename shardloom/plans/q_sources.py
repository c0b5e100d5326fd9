"""Queries over text formats and joins with metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..sources import parsers as R
from .registry import query


@query("path_group_key", """
WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') AS a FROM pages)
SELECT page_id, array_to_string(a[1:2], '/') AS group_key FROM p
""")
def _(read):
    return read("pages").select("page_id", text.group_key(F.regexp_replace("url", "^[a-z]+://", ""), []).alias("group_key"))


@query("split_list_tokens", r"""
WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) - 1 AS n FROM pages), t AS (SELECT page_id, n, list_filter(string_split_regex(trim(line, ' '), '[ \t\n\x0B\f\r]+'), lambda x: regexp_full_match(lower(x), '(?s).*\.(net|org)'))[1] AS token FROM l)
SELECT token, min(page_id * 1048576 + n) AS line_no FROM t WHERE token IS NOT NULL GROUP BY 1
""")
def _(read):
    """Every line of all pages, blank ones and those without a token included; a page has fewer than 2**20 lines here."""
    lines = read("pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("n", "value"))
    return R.split_list(lines.select("value", (F.col("page_id") * 1048576 + F.col("n")).alias("line_no")), [".net", ".org"])


@query("indexed_text", "SELECT CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS id, c_mktsegment AS rest, count(*) OVER (PARTITION BY CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT)) AS copies FROM customer")
def _(read):
    return R.indexed_text(read("customer").select(F.concat(F.regexp_extract("c_name", "([0-9]+)$", 1), F.lit(" "), F.col("c_mktsegment")).alias("value")))


@query("partition_list", "SELECT CAST(c_custkey AS VARCHAR) AS image, 'item' || CAST(c_nationkey AS VARCHAR) AS item, CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'query' ELSE 'gallery' END AS status FROM customer")
def _(read):
    s = F.when(F.col("c_custkey") % 3 == 0, "train").when(F.col("c_custkey") % 3 == 1, "query").otherwise("gallery")
    return R.partition_list(read("customer").select(F.concat_ws("  ", F.col("c_custkey").cast("string"), F.concat(F.lit("item"), F.col("c_nationkey").cast("string")), s).alias("value")))


@query("status_ordered", "SELECT o_orderkey, o_orderstatus AS status, CAST(CASE o_orderstatus WHEN 'P' THEN 1 ELSE 2 END AS BIGINT) AS status_order FROM orders WHERE o_orderstatus IN ('P', 'F')")
def _(read):
    return R.status_ordered(read("orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), ["P", "F"])


@query("natural_labels", "SELECT p_brand AS item, CAST(CASE WHEN u THEN n ELSE i END AS BIGINT) AS label FROM (SELECT p_brand, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT) AS n, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(DISTINCT regexp_extract(p_brand, '([0-9]+)$', 1)) OVER () = count(*) OVER () AS u FROM (SELECT DISTINCT p_brand FROM part))")
def _(read):
    return R.natural_labels(read("part").select(F.col("p_brand").alias("item")), "item").select("item", "label")


@query("metadata_integrity", "SELECT c_nationkey AS k, 'right' AS missing_in FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey > 3)) UNION ALL SELECT n_nationkey, 'left' FROM nation WHERE n_nationkey > 3 AND n_nationkey NOT IN (SELECT c_nationkey FROM customer)")
def _(read):
    return R.integrity(read("customer").select(F.col("c_nationkey").alias("k")), read("nation").where("n_nationkey > 3").select(F.col("n_nationkey").alias("k")), "k")


@query("class_metadata", "SELECT n_nationkey AS class_id, n_regionkey + 1 AS super_class_id, lower(regexp_replace(r_name, ' ', '_')) AS superclass FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(read):
    r = F.broadcast(read("region"))
    return read("nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("class_id"), (F.col("n_regionkey") + 1).alias("super_class_id"), F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("superclass"))


@query("offset_alignment", "SELECT CAST(c_nationkey + CASE WHEN (SELECT min(c_nationkey) FROM customer) = 0 THEN 1 ELSE 0 END AS BIGINT) AS aligned, count(*) AS n FROM customer GROUP BY 1")
def _(read):
    c = read("customer").select("c_nationkey")
    off = F.broadcast(c.agg(F.when(F.min("c_nationkey") == 0, 1).otherwise(0).alias("o")))
    return c.crossJoin(off).groupBy((F.col("c_nationkey") + F.col("o")).cast("long").alias("aligned")).agg(F.count(F.lit(1)).alias("n"))


@query("content_keys", "SELECT doc_id, sha256(coalesce(text, '')) AS key FROM documents")
def _(read):
    return read("documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))


@query("cache_misses", "SELECT sha256(text) AS key, min(doc_id) AS doc_id FROM documents WHERE doc_id % 2 = 0 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1) GROUP BY 1")
def _(read):
    d = read("documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return d.where("doc_id % 2 = 0").join(d.where("doc_id % 2 = 1"), "key", "left_anti").groupBy("key").agg(F.min("doc_id").alias("doc_id"))


@query("path_blacklist", "SELECT page_id, NOT (len(list_filter(string_split(url, '/'), lambda x: x IN ('page', 'tmp', 'a'))) > 0) AS wanted FROM pages")
def _(read):
    bad = F.array(F.lit("page"), F.lit("tmp"), F.lit("a"))
    return read("pages").select("page_id", (~F.arrays_overlap(F.split("url", "/"), bad)).alias("wanted"))


@query("two_source_diff", "SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' ELSE 'same' END AS kind FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer) a FULL JOIN (SELECT s_suppkey * 3 AS k, s_nationkey AS v FROM supplier) b ON a.k = b.k")
def _(read):
    a = read("customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("a"))
    b = read("supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_nationkey").alias("b"))
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, "k", "full_outer").select("k", kind.alias("kind"))
