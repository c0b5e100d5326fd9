"""Queries over the smaller operators: batches, records, lookups, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches as B
from ..operators import graph as G
from ..operators.knn import knn
from . import config
from .q_vectors import _G, _K, _e, _near
from .registry import query


@query("two_stream_batches")
def _(read):
    c = read("customer").select(F.col("c_custkey").alias("s"), F.col("c_nationkey").alias("l"))
    return B.two_stream(c.where("s % 5 <> 0"), c.where("s % 5 = 0"), "s", "l", 3, 8, 24, 8, 4)


@query("neighbour_batches", f"WITH {_K}, b AS (SELECT vec_id AS query_id, (row_number() OVER (ORDER BY md5(concat('3:', CAST(vec_id AS VARCHAR))), vec_id) - 1) // 16 AS batch FROM embeddings) SELECT batch, query_id, query_id AS member, CAST(0 AS BIGINT) AS place FROM b UNION ALL SELECT batch, query_id, ref_id, rank FROM k JOIN b USING (query_id) WHERE rank <= 3")
def _(read):
    return B.neighbour_batches(_near(read, 3), 3, 16)


@query("edge_batches", f"WITH {_G}, z AS (SELECT src, dst, row_number() OVER (ORDER BY md5(concat('3:', CAST(src AS VARCHAR), '-', CAST(dst AS VARCHAR))), src, dst) - 1 AS i FROM b WHERE src < dst) SELECT i // 64 AS batch, i % 64 AS position, src, dst FROM z")
def _(read):
    return B.edge_batches(G.binary_graph(_near(read, 10)), 3, 64)


@query("sampled_edges", f"WITH {_G} SELECT src, dst FROM b WHERE src < dst ORDER BY md5(concat('3:', CAST(src AS VARCHAR), '-', CAST(dst AS VARCHAR))), src, dst LIMIT 100")
def _(read):
    return B.sampled_edges(G.binary_graph(_near(read, 10)), 3, 100).select("src", "dst")


@query("diagnostic_nodes", f"WITH {_K}, d AS (SELECT query_id AS src, ref_id AS dst FROM k WHERE rank <= 1 AND query_id % 4 = 0), z AS (SELECT src AS node FROM d UNION SELECT dst FROM d) SELECT vec_id AS node, z.node IS NOT NULL AS endpoint FROM embeddings LEFT JOIN z ON z.node = vec_id ORDER BY z.node IS NULL, md5(concat('3:', CAST(vec_id AS VARCHAR))), vec_id LIMIT 300")
def _(read):
    near = _near(read, 1).where("query_id % 4 = 0")
    return B.diagnostic_nodes(near.select(F.col("query_id").alias("src"), F.col("ref_id").alias("dst")), _e(read), "vec_id", 3, 300)


@query("edge_report", f"WITH {_G}, l AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN label ELSE -1 END AS l FROM embeddings) SELECT src, dst, round(w, 6) AS w, x.l AS source_label, y.l AS target_label, CASE WHEN x.l >= 0 THEN 'labeled' ELSE 'unlabeled' END AS source_kind, CASE WHEN y.l >= 0 THEN 'labeled' ELSE 'unlabeled' END AS target_kind FROM a JOIN l x ON x.vec_id = src JOIN l y ON y.vec_id = dst")
def _(read):
    nodes = _e(read).select("vec_id", F.when(F.col("vec_id") % 5 == 0, F.col("label")).alias("label"))
    return B.edge_report(G.mixed_affinity(_near(read, 10)), nodes, "vec_id", "label").withColumn("w", F.round("w", 6))


@query("reference_batches", """WITH r AS (SELECT c_nationkey AS l, c_custkey AS s, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(concat('3:', CAST(c_custkey AS VARCHAR))), c_custkey) - 1 AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
g AS (SELECT DISTINCT l, n, b, d FROM r, (SELECT CAST(unnest([0, 1, 2]) AS BIGINT) AS b), (SELECT CAST(unnest([0, 1]) AS BIGINT) AS d)) SELECT b AS batch, g.l, d AS draw, s FROM g JOIN r ON r.l = g.l AND r.r = (b * 2 + d) % g.n""")
def _(read):
    return B.reference_batches(read("customer").select(F.col("c_custkey").alias("s"), F.col("c_nationkey").alias("l")), "s", "l", 3, 3, 2)


@query("fitting_choices", "WITH c AS (SELECT unnest(['16:4', '32:4', '64:2', '64:4', '128:8', '10:4']) AS choice), p AS (SELECT choice, CAST(split_part(choice, ':', 1) AS BIGINT) AS batch, CAST(split_part(choice, ':', 2) AS BIGINT) AS m FROM c), f AS (SELECT count(DISTINCT c_nationkey) AS k FROM customer GROUP BY c_custkey % 3) SELECT * FROM p WHERE batch % m = 0 AND m * (SELECT min(k) FROM f) >= batch")
def _(read):
    c = read("customer")
    choices = c.limit(1).select(F.explode(F.array(*[F.lit(x) for x in ("16:4", "32:4", "64:2", "64:4", "128:8", "10:4")])).alias("choice"))
    return B.fitting_choices(c.select((F.col("c_custkey") % 3).alias("f"), F.col("c_nationkey").alias("l")), "f", "l", choices)


@query("metrics_tall", "SELECT o_orderkey AS step, name, value FROM (SELECT o_orderkey, 'total' AS name, o_totalprice AS value FROM orders UNION ALL SELECT o_orderkey, 'cust', CAST(o_custkey AS DOUBLE) FROM orders)")
def _(read):
    wide = read("orders").select(F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("total"), F.col("o_custkey").cast("double").alias("cust"))
    return wide.unpivot(["step"], ["total", "cust"], "name", "value")


@query("metrics_wide", "SELECT o_custkey AS run, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS f, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
def _(read):
    p = read("orders").groupBy(F.col("o_custkey").alias("run")).pivot("o_orderstatus", ["F", "O"]).agg(F.sum("o_totalprice"))
    return p.withColumnsRenamed({"F": "f", "O": "o"})


@query("metrics_log_sparse", "SELECT event_type AS split, count(*) AS rows, count(CASE WHEN value > 50 THEN value END) AS with_loss, round(avg(CASE WHEN value > 50 THEN value END), 4) AS mean_loss FROM events GROUP BY 1")
def _(read):
    loss = F.when(F.col("value") > 50, F.col("value"))
    return read("events").groupBy(F.col("event_type").alias("split")).agg(F.count(F.lit(1)).alias("rows"), F.count(loss).alias("with_loss"), F.round(F.avg(loss), 4).alias("mean_loss"))


@query("resolved_paths", "SELECT s_suppkey, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'a/' || s_name END, CASE WHEN s_suppkey % 3 = 0 THEN 'b/' || s_name END) AS path FROM supplier")
def _(read):
    from ..sources.parsers import resolved

    s = read("supplier").select("s_suppkey", "s_name")
    there = s.where("s_suppkey % 2 = 0").select(F.concat(F.lit("a/"), "s_name").alias("path")).union(s.where("s_suppkey % 3 = 0").select(F.concat(F.lit("b/"), "s_name")))
    return resolved(s, "s_name", there, "path", ["a/", "b/", "c/"]).select("s_suppkey", "path")


@query("partition_header_check", "SELECT count(*) AS rows, count(*) = 25 AS header_ok FROM nation")
def _(read):
    from ..sources.parsers import header_check

    return header_check(read("nation"), 25)


@query("product_list", "SELECT c_custkey AS image_id, CAST(c_nationkey AS BIGINT) AS class_id, CAST(c_nationkey % 5 AS BIGINT) AS super_class_id, 'seg' || CAST(c_nationkey % 5 AS VARCHAR) AS superclass FROM customer")
def _(read):
    from ..sources.parsers import product_list

    s = F.col("c_nationkey") % 5
    line = F.concat_ws(" ", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), s.cast("string"), F.concat(F.lit("seg"), s.cast("string"), F.lit("_final/x.JPG")))
    return product_list(read("customer").select(line.alias("value")))


@query("original_labels", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey + 100 END, c_nationkey) AS label FROM customer")
def _(read):
    return read("customer").select("c_custkey", F.coalesce(F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey") + 100), "c_nationkey").alias("label"))


@query("plot_groups", "SELECT c_custkey, coalesce(r_name, CAST(c_nationkey AS VARCHAR)) AS grp FROM customer LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey < 20) ON n_nationkey = c_nationkey")
def _(read):
    meta = read("nation").where("n_nationkey < 20").join(F.broadcast(read("region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return read("customer").join(F.broadcast(meta), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("r_name", F.col("c_nationkey").cast("string")).alias("grp"))


@query("superclass_map", "SELECT c_custkey, n_regionkey AS superclass FROM customer JOIN nation ON n_nationkey = c_nationkey")
def _(read):
    known = F.broadcast(read("nation").select("n_nationkey", "n_regionkey"))
    fine = F.coalesce("n_regionkey", F.raise_error(F.concat(F.lit("unknown class "), F.col("c_nationkey").cast("string"))).cast("int"))
    return read("customer").join(known, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", fine.alias("superclass"))


@query("set_summary", "SELECT count(*) AS samples, count(DISTINCT label) AS classes FROM embeddings")
def _(read):
    return _e(read).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("label").alias("classes"))


@query("index_validation", "SELECT count(*) AS n, min(vec_id) >= 0 AS low_ok, max(vec_id) < (SELECT count(*) FROM embeddings) AS high_ok, count(DISTINCT vec_id) = count(*) AS unique_ok FROM embeddings")
def _(read):
    e = read("embeddings").select("vec_id")
    size = F.broadcast(e.agg(F.count(F.lit(1)).alias("size")))
    q = e.crossJoin(size)
    return q.agg(F.count(F.lit(1)).alias("n"), (F.min("vec_id") >= 0).alias("low_ok"), (F.max("vec_id") < F.max("size")).alias("high_ok"), (F.count_distinct("vec_id") == F.count(F.lit(1))).alias("unique_ok"))


@query("superclass_coverage", """WITH o AS (SELECT n_nationkey AS l, n_regionkey AS g, row_number() OVER (ORDER BY md5(concat('20:class:', CAST(n_nationkey AS VARCHAR))), n_nationkey) AS n FROM nation), p AS (SELECT l, g FROM o WHERE n <= 4)
SELECT r_regionkey AS superclass, count(p.l) AS drawn, count(p.l) = 0 AS missing FROM region LEFT JOIN p ON p.g = r_regionkey GROUP BY 1""")
def _(read):
    from ..operators.sampling import class_order

    n = read("nation").select(F.col("n_nationkey").alias("l"), F.col("n_regionkey").alias("g"))
    drawn = class_order(n, "l", 20).where("class_no <= 4").join(n, "l").groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    return read("region").join(F.broadcast(drawn), F.col("g") == F.col("r_regionkey"), "left").select(F.col("r_regionkey").alias("superclass"), F.coalesce("k", F.lit(0)).cast("long").alias("drawn"), F.col("k").isNull().alias("missing"))


@query("trials_mentioning", "SELECT event_id FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def _(read):
    from ..operators.trials import mentions
    from .q_trials import _props

    return mentions(_props(read), "params", "k").select("event_id")


@query("joint_parameters", "SELECT DISTINCT p_size AS n, CAST(p_size * 2 AS VARCHAR) AS a, CAST(p_size % 7 AS VARCHAR) AS b FROM part")
def _(read):
    n = F.col("p_size")
    joint = F.to_json(F.struct((n * 2).cast("string").alias("a"), (n % 7).cast("string").alias("b")))
    m = F.map_concat(F.create_map(F.lit("n"), n.cast("string")), F.from_json(joint, "map<string,string>"))
    return read("part").select(n.alias("n"), m.alias("m")).select("n", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b")).distinct()


@query("distribution_compatibility", "SELECT coalesce(a.k, b.k) AS name, CASE WHEN a.k IS NULL THEN 'missing left' WHEN b.k IS NULL THEN 'missing right' WHEN a.t <> b.t THEN 'kind differs' ELSE 'ok' END AS state FROM (SELECT n_name AS k, n_regionkey % 2 AS t FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_name AS k, n_nationkey % 2 AS t FROM nation WHERE n_nationkey > 4) b ON a.k = b.k")
def _(read):
    n = read("nation")
    a = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), (F.col("n_regionkey") % 2).alias("a"))
    b = n.where("n_nationkey > 4").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 2).alias("b"))
    state = F.when(F.col("a").isNull(), "missing left").when(F.col("b").isNull(), "missing right").when(F.col("a") != F.col("b"), "kind differs").otherwise("ok")
    return a.join(b, "name", "full_outer").select("name", state.alias("state"))


@query("audit_record", "SELECT label, '{\"n\":' || CAST(count(*) AS VARCHAR) || ',\"least\":' || CAST(min(vec_id) AS VARCHAR) || '}' AS record FROM embeddings GROUP BY label")
def _(read):
    return _e(read).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")).select("label", F.to_json(F.struct("n", "least")).alias("record"))


@query("position_label_map", "SELECT label, string_agg(CAST(vec_id AS VARCHAR) || '=' || CAST(label AS VARCHAR), ';' ORDER BY vec_id) AS entries FROM embeddings GROUP BY 1")
def _(read):
    e = _e(read).groupBy("label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("vec_id", F.col("label").alias("l"))))).alias("m"))
    return e.select("label", F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"].cast("string"), F.lit("="), x["value"].cast("string"))), ";").alias("entries"))


@query("labels_at_positions", "SELECT p.k AS position, coalesce(label, -1) AS label, label IS NOT NULL AS inside FROM (SELECT c_custkey * 7 AS k FROM customer) p LEFT JOIN embeddings ON vec_id = p.k")
def _(read):
    p = read("customer").select((F.col("c_custkey") * 7).alias("position"))
    return p.join(_e(read), F.col("position") == F.col("vec_id"), "left").select("position", F.coalesce("label", F.lit(-1)).alias("label"), F.col("label").isNotNull().alias("inside"))


@query("holdout_info", "SELECT part, count(*) AS samples, count(DISTINCT c_nationkey) AS classes FROM (SELECT *, CASE WHEN c_nationkey % 5 = 0 THEN 'valid' ELSE 'train' END AS part FROM customer) GROUP BY 1")
def _(read):
    part = F.when(F.col("c_nationkey") % 5 == 0, "valid").otherwise("train")
    return read("customer").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("c_nationkey").alias("classes"))


@query("miner_counts", "SELECT l_orderkey, least(count(*) FILTER (WHERE l_returnflag = 'A'), count(*) FILTER (WHERE l_returnflag = 'R')) AS pairs, count(*) AS rows FROM lineitem GROUP BY 1")
def _(read):
    a, r = F.count_if(F.col("l_returnflag") == "A"), F.count_if(F.col("l_returnflag") == "R")
    return read("lineitem").groupBy("l_orderkey").agg(F.least(a, r).alias("pairs"), F.count(F.lit(1)).alias("rows"))


@query("grid_summary_row", """WITH g AS (SELECT l_linestatus AS s, l_returnflag AS m, avg(l_discount) AS v FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1, 2)
SELECT s AS scenario, round(max(v) FILTER (WHERE m = 'A'), 6) AS supervised, round(max(v) FILTER (WHERE m = 'N'), 6) AS semi, round(max(v) FILTER (WHERE m = 'N') - max(v) FILTER (WHERE m = 'A'), 6) AS delta FROM g GROUP BY 1""")
def _(read):
    g = read("lineitem").where("l_returnflag in ('A', 'N')").groupBy(F.col("l_linestatus").alias("scenario")).pivot("l_returnflag", ["A", "N"]).agg(F.avg("l_discount"))
    return g.select("scenario", F.round("A", 6).alias("supervised"), F.round("N", 6).alias("semi"), F.round(F.col("N") - F.col("A"), 6).alias("delta"))


@query("comparison_row", "SELECT l_linenumber AS seed, round(avg(l_discount), 6) AS metric, round(avg(l_tax), 6) AS other, round(avg(l_tax) - avg(l_discount), 6) AS delta FROM lineitem GROUP BY 1")
def _(read):
    a, b = F.avg("l_discount"), F.avg("l_tax")
    return read("lineitem").groupBy(F.col("l_linenumber").alias("seed")).agg(F.round(a, 6).alias("metric"), F.round(b, 6).alias("other"), F.round(b - a, 6).alias("delta"))


@query("study_result_means", "SELECT o_custkey % 50 AS trial, round(avg(o_totalprice), 2) AS mean_value, count(*) AS replays FROM orders WHERE isfinite(o_totalprice) GROUP BY 1")
def _(read):
    ok = ~F.isnan("o_totalprice") & (F.abs("o_totalprice") != float("inf"))
    return read("orders").where(ok).groupBy((F.col("o_custkey") % 50).alias("trial")).agg(F.round(F.avg("o_totalprice"), 2).alias("mean_value"), F.count(F.lit(1)).alias("replays"))


@query("random_view_pick", "SELECT l_orderkey, arg_min(l_partkey, md5(concat('3:', CAST(l_orderkey AS VARCHAR), ':', CAST(l_partkey AS VARCHAR)))) AS picked FROM lineitem GROUP BY 1")
def _(read):
    key = F.md5(F.concat(F.lit("3:"), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_partkey").cast("string")))
    return read("lineitem").groupBy("l_orderkey").agg(F.min_by("l_partkey", key).alias("picked"))


@query("training_set_build", f"""WITH {_K}, r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('7:', CAST(vec_id AS VARCHAR))), vec_id) AS n FROM embeddings), l AS (SELECT vec_id, label FROM r WHERE n <= 8),
w AS (SELECT query_id, rl, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS i FROM s WHERE ref_id IN (SELECT vec_id FROM l) AND query_id NOT IN (SELECT vec_id FROM l)),
v AS (SELECT query_id, rl AS pred_label, round(count(*) / 5, 6) AS confidence FROM w WHERE i <= 5 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, rl) = 1)
SELECT vec_id AS sample_id, CAST(label AS BIGINT) AS label, 1.0::DOUBLE AS confidence, 'true' AS provenance FROM l UNION ALL SELECT query_id, pred_label, confidence, 'pseudo' FROM v WHERE confidence >= 0.6""")
def _(read):
    return config.build_training_set(_e(read), config.LabelConfig(mode="per_class_min", k=8, seed=7, neighbours=5, threshold=0.6))


@query("labeled_only_build", "SELECT vec_id AS sample_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('7:', CAST(vec_id AS VARCHAR))), vec_id) AS n FROM embeddings) WHERE n <= 8")
def _(read):
    from ..operators.sampling import per_class_min

    return per_class_min(_e(read), "vec_id", "label", 7, k=8).where("pool = 'labeled'").select(F.col("vec_id").alias("sample_id"), "label")


@query("spreading_training_set")
def _(read):
    return config.build_training_set(_e(read), config.LabelConfig(k=8, seed=7, method="label_spreading", neighbours=10))


@query("stratified_group_kfold", """WITH RECURSIVE c AS (SELECT o_custkey AS g, o_orderpriority AS l, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT l, sum(n) AS n FROM c GROUP BY 1),
x AS (SELECT g, sum(c.n) AS n, list(coalesce(c.n, 0) / t.n ORDER BY l) AS v FROM (SELECT g, t.l, c.n FROM (SELECT DISTINCT g FROM c) CROSS JOIN t LEFT JOIN c USING (g, l)) c JOIN t USING (l) GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY n DESC, md5(concat('7:', CAST(g AS VARCHAR))), g) AS i FROM x),
w AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS g, NULL::BIGINT AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS rows, list_resize([]::DOUBLE[][], 5, (SELECT list(0.0::DOUBLE) FROM t)) AS s
UNION ALL SELECT i, g, f, list_transform(rows, lambda r, k: CASE WHEN k - 1 = f THEN r + n ELSE r END)::BIGINT[], list_transform(s, lambda a, k: CASE WHEN k - 1 = f THEN list_transform(a, lambda y, j: y + v[j]) ELSE a END) FROM (
  SELECT o.*, rows, s, list_min([[round(list_dot_product(s[k], v), 12), rows[k], k] FOR k IN [1, 2, 3, 4, 5]])[3]::BIGINT - 1 AS f FROM w JOIN o ON o.i = w.i + 1))
SELECT o_orderkey, o_custkey, o_orderpriority, fold FROM orders JOIN w ON g = o_custkey""")
def _(read):
    """Customers' orders by priority: a customer's rows stay together, every priority is spread over the folds."""
    from ..operators.folds import stratified_group_folds

    return stratified_group_folds(read("orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_orderkey", "o_custkey", "o_orderpriority", 7, 5)


@query("query_test_report", "SELECT count(*) FILTER (WHERE vec_id % 4 = 0) AS queries, count(*) FILTER (WHERE vec_id % 4 <> 0) AS gallery, count(DISTINCT label) FILTER (WHERE vec_id % 4 = 0) AS query_classes, count(DISTINCT label) FILTER (WHERE vec_id % 4 <> 0) AS gallery_classes FROM embeddings")
def _(read):
    q = F.col("vec_id") % 4 == 0
    return _e(read).agg(F.count_if(q).alias("queries"), F.count_if(~q).alias("gallery"), F.count_distinct(F.when(q, F.col("label"))).alias("query_classes"), F.count_distinct(F.when(~q, F.col("label"))).alias("gallery_classes"))
