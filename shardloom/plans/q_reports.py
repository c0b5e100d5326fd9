"""Queries over class distributions and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import distribution as D
from ..operators import splits as S
from ..operators import views as V
from .registry import query

_T = "SELECT c_mktsegment AS split, c_nationkey AS label, c_custkey AS sample FROM customer"
_N = "WITH t AS (" + _T + "), c AS (SELECT split, label, count(*) AS n FROM t GROUP BY ALL)"


def _splits(read):
    return read("customer").select(F.col("c_mktsegment").alias("split"), F.col("c_nationkey").alias("label"), F.col("c_custkey").alias("sample"))


@query("class_distribution", "SELECT label, count(*) AS sample_count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM embeddings GROUP BY label")
def _(read):
    return D.class_distribution(read("embeddings"), "label")


@query("class_distribution_by_split", f"{_N} SELECT split, label, n AS sample_count, round(100.0 * n / sum(n) OVER (PARTITION BY split), 6) AS percentage FROM c")
def _(read):
    return D.class_distribution(_splits(read), "label", ("split",))


@query("class_distribution_named", """
WITH c AS (SELECT c_nationkey AS label, count(*) AS sample_count FROM customer GROUP BY 1)
SELECT c.label, sample_count, coalesce(n_name, '') AS class_name, r_name AS superclass FROM c LEFT JOIN nation ON n_nationkey = c.label LEFT JOIN region ON r_regionkey = n_regionkey
""")
def _(read):
    meta = read("nation").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("label"), "n_name", "r_name")
    c = D.class_distribution(_splits(read), "label").select("label", "sample_count")
    return c.join(F.broadcast(meta), "label", "left").select("label", "sample_count", F.coalesce("n_name", F.lit("")).alias("class_name"), F.col("r_name").alias("superclass"))


_SUMMARY = f"""{_N}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n) AS i, count(*) OVER (PARTITION BY split) AS k,
  sum(n) OVER (PARTITION BY split) AS a, min(n) OVER (PARTITION BY split) AS lo, max(n) OVER (PARTITION BY split) AS hi FROM c)
SELECT split, CAST(max(a) AS BIGINT) AS num_samples, count(*) AS num_classes, min(n) AS min_samples, max(n) AS max_samples, round(avg(n), 6) AS avg_samples,
  round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS median, round(quantile_cont(n, 0.75), 6) AS q75, round(stddev_pop(n), 6) AS std_samples,
  round(max(n) / min(n), 6) AS imbalance_ratio, count(*) FILTER (WHERE n = 1) AS num_singleton_classes, count(*) FILTER (WHERE n < 2) AS num_classes_lt_2,
  count(*) FILTER (WHERE n < 4) AS num_classes_lt_4, round(CAST(sum((2 * i - k - 1) * n) AS DOUBLE) / CAST(max(k) * sum(n) AS DOUBLE), 6) AS gini,
  round(-sum(n / a * log2(n / a)), 6) AS entropy_bits, round(CASE WHEN count(*) = 1 THEN 1.0 ELSE -sum(n / a * log2(n / a)) / log2(count(*)) END, 6) AS normalized_entropy,
  string_agg(CAST(label AS VARCHAR), ';' ORDER BY label) FILTER (WHERE n = lo) AS min_count_classes,
  string_agg(CAST(label AS VARCHAR), ';' ORDER BY label) FILTER (WHERE n = hi) AS max_count_classes FROM r GROUP BY split"""


@query("split_summary", _SUMMARY)
def _(read):
    return D.split_summary(_splits(read), "split", "label")


@query("gini_entropy", f"""{_N}, r AS (SELECT split, n, row_number() OVER (PARTITION BY split ORDER BY n) AS i, count(*) OVER (PARTITION BY split) AS k FROM c)
SELECT split, round(CAST(sum((2 * i - k - 1) * n) AS DOUBLE) / CAST(max(k) * sum(n) AS DOUBLE), 6) AS gini FROM r GROUP BY split""")
def _(read):
    c = _splits(read).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return D.gini(c, "split", "n").select("split", F.round("gini", 6).alias("gini"))


@query("class_overlap", """
WITH s AS (SELECT DISTINCT p_brand AS split, p_size AS label FROM part), n AS (SELECT split, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.split AS split_a, b.split AS split_b, a.n AS num_classes_a, b.n AS num_classes_b FROM n a JOIN n b ON a.split < b.split),
i AS (SELECT a.split AS split_a, b.split AS split_b, count(*) AS k, string_agg(CAST(label AS VARCHAR), ';' ORDER BY label) AS names FROM s a JOIN s b USING (label) WHERE a.split < b.split GROUP BY ALL)
SELECT split_a, split_b, num_classes_a, num_classes_b, coalesce(k, 0) AS num_intersection, num_classes_a + num_classes_b - coalesce(k, 0) AS num_union,
  round(coalesce(k, 0) / (num_classes_a + num_classes_b - coalesce(k, 0)), 6) AS jaccard, coalesce(names, '') AS intersection_classes FROM p LEFT JOIN i USING (split_a, split_b)
""")
def _(read):
    return D.class_overlap(read("part").select(F.col("p_brand").alias("split"), F.col("p_size").alias("label")), "split", "label")


@query("pairwise_class_sets", """
WITH s AS (SELECT DISTINCT p_brand AS k, p_size AS l FROM part), b AS (SELECT DISTINCT k FROM s),
p AS (SELECT x.k AS a, y.k AS b FROM b x JOIN b y ON x.k < y.k),
m AS (SELECT p.a, p.b, l, bool_or(s.k = p.a) AS in_a, bool_or(s.k = p.b) AS in_b FROM p JOIN s ON s.k IN (p.a, p.b) GROUP BY ALL)
SELECT a AS left_key, b AS right_key, bool_and(in_a AND in_b) AS same_classes, bool_and(in_b OR NOT in_a) AS left_subset, bool_and(in_a OR NOT in_b) AS right_subset,
  count(*) FILTER (WHERE in_a AND in_b) AS num_intersection, count(*) AS num_union, round(count(*) FILTER (WHERE in_a AND in_b) / count(*), 6) AS jaccard,
  coalesce(string_agg(CAST(l AS VARCHAR), ';' ORDER BY l) FILTER (WHERE NOT in_b), '') AS only_left, coalesce(string_agg(CAST(l AS VARCHAR), ';' ORDER BY l) FILTER (WHERE NOT in_a), '') AS only_right
FROM m GROUP BY a, b
""")
def _(read):
    return D.pairwise_class_sets(read("part").select(F.col("p_brand").alias("k"), F.col("p_size").alias("l")), "k", "l")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("class_pivot", "WITH t AS (" + _T + ") SELECT label, " + ", ".join(f"count(*) FILTER (WHERE split = '{s}') AS \"{s}\"" for s in _SEGMENTS) + " FROM t GROUP BY label")
def _(read):
    return D.class_pivot(_splits(read), "label", "split", _SEGMENTS)


@query("sample_membership", "WITH t AS (" + _T + ") SELECT *, row_number() OVER (PARTITION BY split ORDER BY sample) - 1 AS position_in_split, dense_rank() OVER (PARTITION BY split ORDER BY label) - 1 AS mapped_class_label FROM t")
def _(read):
    return D.membership(_splits(read), "split", "sample", "label")


@query("top_bottom_classes", """
WITH c AS (SELECT c_nationkey AS label, count(*) AS n FROM customer GROUP BY 1)
SELECT * FROM (SELECT *, 'smallest' AS side FROM c ORDER BY n, label LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'largest' AS side FROM c ORDER BY n DESC, label LIMIT 5)
""")
def _(read):
    return D.top_bottom(_splits(read).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", "n", 5)


@query("class_list_render", """
WITH s AS (SELECT DISTINCT p_brand AS split, p_partkey % 97 AS l FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY l) AS i, count(*) OVER (PARTITION BY split) AS n FROM s)
SELECT split, string_agg(CAST(l AS VARCHAR), ';' ORDER BY l) FILTER (WHERE i <= 50) || CASE WHEN max(n) > 50 THEN ';...(+' || CAST(max(n) - 50 AS VARCHAR) || ')' ELSE '' END AS classes FROM r GROUP BY split
""")
def _(read):
    s = read("part").select(F.col("p_brand").alias("split"), (F.col("p_partkey") % 97).alias("l"))
    return s.groupBy("split").agg(F.collect_set("l").alias("c")).select("split", text.class_list(F.col("c")).alias("classes"))


@query("superclass_counts", """
SELECT n_regionkey AS superclass, count(*) AS samples, count(DISTINCT c_nationkey) AS classes FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1
""")
def _(read):
    n = F.broadcast(read("nation").select("n_nationkey", F.col("n_regionkey").alias("superclass")))
    return read("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("superclass").agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("c_nationkey").alias("classes"))


@query("value_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def _(read):
    return read("orders").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("numeric_summary", """
SELECT o_orderpriority, count(o_totalprice) AS n, round(min(o_totalprice), 6) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(median(o_totalprice), 6) AS median,
  round(quantile_cont(o_totalprice, 0.75), 6) AS p75, round(max(o_totalprice), 6) AS max, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders GROUP BY 1
""")
def _(read):
    return D.numeric_summary(read("orders"), "o_totalprice", ("o_orderpriority",)).withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("min_group_size_filter", "SELECT p_partkey, p_type, count(*) OVER (PARTITION BY p_type) AS group_size FROM part QUALIFY count(*) OVER (PARTITION BY p_type) >= 15")
def _(read):
    p = read("part").select("p_partkey", "p_type")
    big = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("group_size")).where("group_size >= 15")
    return p.join(big, "p_type").select("p_partkey", "p_type", "group_size")


@query("group_size_statistics", "WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS rows, min(n) AS min, median(n) AS median, round(avg(n), 6) AS mean, max(n) AS max FROM c")
def _(read):
    c = read("part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.min("n").alias("min"), F.median("n").alias("median"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("max"))


@query("threshold_sweep", """
WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1), h AS (SELECT n AS threshold, CAST(sum(n) AS BIGINT) AS r, count(*) AS g FROM c GROUP BY n),
s AS (SELECT threshold, CAST(sum(r) OVER (ORDER BY threshold DESC) AS BIGINT) AS rows_kept, CAST(sum(g) OVER (ORDER BY threshold DESC) AS BIGINT) AS groups_kept FROM h)
SELECT *, abs(rows_kept - 1500) + 1000 * abs(groups_kept - 100) AS distance FROM s ORDER BY distance, threshold LIMIT 5
""")
def _(read):
    from pyspark.sql import Window

    c = read("part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    h = c.groupBy(F.col("n").alias("threshold")).agg(F.sum("n").alias("r"), F.count(F.lit(1)).alias("g"))
    w = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)  # a row per distinct count
    s = h.select("threshold", F.sum("r").over(w).alias("rows_kept"), F.sum("g").over(w).alias("groups_kept"))
    return s.withColumn("distance", F.abs(F.col("rows_kept") - 1500) + 1000 * F.abs(F.col("groups_kept") - 100)).orderBy("distance", "threshold").limit(5)


@query("expected_count_check", "SELECT (SELECT count(*) FROM nation) = 25 AS nations_ok, (SELECT count(*) FROM region) = 5 AS regions_ok, (SELECT count(DISTINCT n_regionkey) FROM nation) = 5 AS covered_ok")
def _(read):
    n = read("nation").agg((F.count(F.lit(1)) == 25).alias("nations_ok"), (F.count_distinct("n_regionkey") == 5).alias("covered_ok"))
    return n.crossJoin(read("region").agg((F.count(F.lit(1)) == 5).alias("regions_ok")))


@query("dense_relabel", "SELECT p_partkey, p_size, dense_rank() OVER (ORDER BY p_size) - 1 AS mapped FROM part")
def _(read):
    return S.dense_relabel(read("part"), "p_partkey", "p_size")


@query("label_lookup", """
WITH m AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS mapped FROM (SELECT DISTINCT label FROM embeddings WHERE vec_id % 5 = 0 AND label < 7))
SELECT vec_id, e.label, coalesce(mapped, -1) AS mapped FROM embeddings e LEFT JOIN m USING (label)
""")
def _(read):
    e = read("embeddings")
    m = S.dense_relabel(e.where("vec_id % 5 = 0 and label < 7"), "vec_id", "label").select("label", "mapped").distinct()
    return S.mapped_or(e.select("vec_id", "label"), m, "label")


@query("position_remap", "WITH k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings WHERE label <> 3) SELECT vec_id, position FROM k WHERE vec_id % 3 = 0")
def _(read):
    e = read("embeddings").select("vec_id", "label")
    return S.remapped(e.where("vec_id % 3 = 0"), e.where("label <> 3"), "vec_id").select("vec_id", "position")


@query("filter_by_class_set", "SELECT vec_id, label FROM embeddings WHERE label IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 12)")
def _(read):
    keep = read("nation").where("n_nationkey < 12").select(F.col("n_regionkey").alias("label")).distinct()
    return read("embeddings").select("vec_id", "label").join(F.broadcast(keep), "label", "left_semi")


@query("union_of_positions", "SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0 UNION SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0")
def _(read):
    e = read("embeddings").select("vec_id")
    return e.where("vec_id % 3 = 0").union(e.where("vec_id % 5 = 0")).distinct()


@query("unused_rows", "SELECT vec_id FROM embeddings WHERE NOT (vec_id % 3 = 0 OR vec_id % 5 = 0)")
def _(read):
    e = read("embeddings").select("vec_id")
    return e.join(e.where("vec_id % 3 = 0 or vec_id % 5 = 0"), "vec_id", "left_anti")


@query("class_set_algebra", """
WITH a AS (SELECT DISTINCT p_retailprice AS l FROM part WHERE p_type = 'ECONOMY'), b AS (SELECT DISTINCT p_retailprice AS l FROM part WHERE p_size <= 25)
SELECT 'both' AS kind, l FROM (SELECT l FROM a INTERSECT SELECT l FROM b) UNION ALL SELECT 'left' AS kind, l FROM (SELECT l FROM a EXCEPT SELECT l FROM b) UNION ALL SELECT 'either' AS kind, l FROM (SELECT l FROM a UNION SELECT l FROM b)
""")
def _(read):
    a, b = (read("part").where(x).select(F.col("p_retailprice").alias("l")).distinct() for x in ("p_type = 'ECONOMY'", "p_size <= 25"))
    tag = lambda d, k: d.select(F.lit(k).alias("kind"), "l")
    return tag(a.intersect(b), "both").unionByName(tag(a.exceptAll(b), "left")).unionByName(tag(a.union(b).distinct(), "either"))


@query("scenario_id", "SELECT DISTINCT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') || '_f' || replace(CAST(p_size / 4 AS VARCHAR), '.', 'p') AS scenario_id FROM part")
def _(read):
    return read("part").select(F.concat(text.slug(F.col("p_type")), F.lit("_f"), text.float_token(F.col("p_size") / 4)).alias("scenario_id")).distinct()


@query("markdown_table", "SELECT '| ' || CAST(n_nationkey AS VARCHAR) || ' | ' || replace(n_name, '|', chr(92) || '|') || ' | ' || format('{:.4f}', n_regionkey / 3) || ' |' AS line FROM nation")
def _(read):
    from ..sources.sinks import markdown_rows

    return markdown_rows(read("nation").select("n_nationkey", "n_name", (F.col("n_regionkey") / 3).alias("share")))


@query("external_pool_union", "SELECT c_custkey AS sample_id, CAST(c_nationkey AS BIGINT) AS label, 'split' AS origin FROM customer UNION ALL SELECT s_suppkey, -1, 'external' FROM supplier")
def _(read):
    own = read("customer").select(F.col("c_custkey").alias("sample_id"), F.col("c_nationkey").alias("label"))
    return V.with_external(own, read("supplier").select(F.col("s_suppkey").alias("sample_id")), "split_and_external")


@query("concatenated_sources", """
SELECT 'nation' AS source, CAST(n_nationkey AS BIGINT) AS local_id, row_number() OVER (ORDER BY n_nationkey) - 1 AS global_id FROM nation
UNION ALL SELECT 'supplier', s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 + (SELECT count(*) FROM nation) FROM supplier
""")
def _(read):
    return V.concatenated([("nation", read("nation").select(F.col("n_nationkey").alias("i"))), ("supplier", read("supplier").select(F.col("s_suppkey").alias("i")))], "i")


@query("hidden_views", "SELECT vec_id, v AS view, vec_id * 3 + v AS view_id, CAST(-1 AS BIGINT) AS label FROM embeddings, (SELECT CAST(unnest([0, 1, 2]) AS INTEGER) AS v)")
def _(read):
    return V.hidden_views(read("embeddings"), "vec_id", 3)


@query("regrouped_views", "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ';' ORDER BY l_linenumber, l_partkey) AS views, count(DISTINCT l_returnflag) AS labels FROM lineitem GROUP BY 1")
def _(read):
    v = V.regrouped(read("lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return v.select("l_orderkey", F.array_join(F.col("views").cast("array<string>"), ";").alias("views"), "labels")


@query("joint_index_space", """
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS joint_id, vec_id, CAST(0 AS BIGINT) AS role FROM embeddings WHERE vec_id % 5 <> 0
UNION ALL SELECT row_number() OVER (ORDER BY vec_id) - 1 + (SELECT count(*) FROM embeddings WHERE vec_id % 5 <> 0), vec_id, 1 FROM embeddings WHERE vec_id % 5 = 0
""")
def _(read):
    e = read("embeddings").select("vec_id")
    return V.joint_space(e.where("vec_id % 5 <> 0"), e.where("vec_id % 5 = 0"), "vec_id")


@query("disjoint_violations", "SELECT label, count(DISTINCT vec_id % 2) AS parts FROM embeddings GROUP BY 1 HAVING count(DISTINCT vec_id % 2) > 1")
def _(read):
    return S.disjoint_violations(read("embeddings").select("label", (F.col("vec_id") % 2).alias("part")), "part", "label")


@query("split_assembly", "SELECT 'labeled' AS split, count(*) AS n, count(DISTINCT label) AS classes FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT 'unlabeled', count(*), count(DISTINCT label) FROM embeddings WHERE vec_id % 5 <> 0 UNION ALL SELECT 'train', count(*), count(DISTINCT label) FROM embeddings")
def _(read):
    e = read("embeddings").select("vec_id", "label")
    names = F.array(F.lit("train"), F.when(F.col("vec_id") % 5 == 0, "labeled").otherwise("unlabeled"))
    return e.select(F.explode(names).alias("split"), "label").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("label").alias("classes"))
