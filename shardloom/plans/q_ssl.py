"""Queries over protocols, pair traces, running alignment, regularisers, factorised solves and caches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import alignment as A
from ..operators import graph as G
from ..operators import pair_trace as T
from ..operators import propagation as S
from ..operators import protocols as P
from ..operators import simmatch as M
from ..operators.knn import knn
from ..operators.trials import grid_rows
from ..sources.feature_cache import FeatureCache, StudyCache
from ..sources.shared import shared_dir
from ..sources.sinks import split_lists
from . import regularisers as R
from .q_vectors import _K, _MIXED, _N
from .registry import ORACLES, query

_ROWS = "c AS (SELECT c_custkey AS s, c_nationkey AS l, c_custkey % 5 < 4 AS tr FROM customer), k AS (SELECT n_nationkey AS l, n_regionkey AS g, row_number() OVER (ORDER BY n_nationkey) AS i, count(*) OVER () AS n, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS gi, count(*) OVER (PARTITION BY n_regionkey) AS gn FROM nation)"


def _protocol(read, name, **options):
    """Customers by nation, every fifth in the official test source; nations in regions are the class table."""
    classes = [tuple(r) for r in read("nation").select("n_nationkey", "n_regionkey").collect()]  # class metadata
    long_tail = options.pop("long_tail", None)
    plan = P.resolve(name, classes, **options)
    c = read("customer").select(F.col("c_custkey").alias("s"), F.col("c_nationkey").alias("l"))
    parts = P.load(plan, c.where("s % 5 < 4"), c.where("s % 5 = 4"), "s", "l", 7, long_tail)
    return parts[0].withColumn("part", F.lit("development")).unionByName(parts[1].withColumn("part", F.lit("test")))


@query("protocol_official", f"WITH {_ROWS} SELECT s, l, CASE WHEN tr THEN 'development' ELSE 'test' END AS part FROM c")
def _(read):
    return _protocol(read, "official")


@query("protocol_balanced_fraction", """WITH c AS (SELECT c_custkey AS s, c_mktsegment AS l FROM customer), m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM c GROUP BY l)), r AS (SELECT s, l, row_number() OVER (PARTITION BY l ORDER BY md5(concat('7:', CAST(s AS VARCHAR))), s) AS i FROM c)
SELECT s, l, CASE WHEN i <= floor(m * 0.7::DOUBLE) THEN 'development' ELSE 'test' END AS part FROM r, m WHERE i <= floor(m * 0.7::DOUBLE) + floor(m * 0.2::DOUBLE)""")
def _(read):
    """Segments as classes, of which even the smallest table has some rows each."""
    c = read("customer").select(F.col("c_custkey").alias("s"), F.col("c_mktsegment").alias("l"))
    plan = P.resolve("balanced_fraction", [(r[0], None) for r in c.select("l").distinct().collect()], train=0.7, test=0.2)  # a row a class
    parts = P.load(plan, c.where("s % 5 < 4"), c.where("s % 5 = 4"), "s", "l", 7)
    return parts[0].withColumn("part", F.lit("development")).unionByName(parts[1].withColumn("part", F.lit("test")))


@query("protocol_unseen_classes", f"WITH {_ROWS} SELECT s, l, CASE WHEN i <= floor(n * 0.6 + 1e-9) THEN 'development' ELSE 'test' END AS part FROM c JOIN k USING (l)")
def _(read):
    return _protocol(read, "unseen_classes")


@query("protocol_unseen_classes_interleaved", f"WITH {_ROWS} SELECT s, l, CASE WHEN i % 3 = 0 THEN 'test' ELSE 'development' END AS part FROM c JOIN k USING (l)")
def _(read):
    return _protocol(read, "unseen_classes_interleaved")


@query("protocol_within_superclass", f"WITH {_ROWS} SELECT s, l, CASE WHEN gi <= floor(gn * 0.6 + 1e-9) THEN 'development' ELSE 'test' END AS part FROM c JOIN k USING (l)")
def _(read):
    return _protocol(read, "unseen_classes_within_superclass")


@query("protocol_unseen_superclasses", f"""WITH {_ROWS}, d AS (SELECT s, l, CASE WHEN dense_rank() OVER (ORDER BY g) <= floor((SELECT count(DISTINCT g) FROM k) * 0.5 + 1e-9) THEN 'development' ELSE 'test' END AS part FROM c JOIN k USING (l)),
t AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY md5(concat('7:', CAST(s AS VARCHAR))), s) AS r, count(*) OVER (PARTITION BY l) AS n, dense_rank() OVER (ORDER BY l) - 1 AS i FROM d WHERE part = 'development'), m AS (SELECT max(n) AS m, max(i) AS c FROM t)
SELECT s, l, part FROM t, m WHERE r <= least(n, floor(m * pow(0.5::DOUBLE, i / c) + 1e-9)) UNION ALL SELECT s, l, part FROM d WHERE part = 'test'""")
def _(read):
    return _protocol(read, "unseen_superclasses", long_tail=0.5)


_TRACE = f"""{_N}, e AS (SELECT vec_id AS i, vec_id // 100 AS b, CASE WHEN vec_id % 5 = 0 THEN label END AS l, v, l AS n FROM n),
d AS (SELECT least(x.b, y.b) AS left_block, greatest(x.b, y.b) AS right_block, x.l AS p, y.l AS q, 2 - 2 * list_inner_product(x.v, y.v) / (x.n * y.n) AS d FROM e x JOIN e y ON x.i < y.i),
eta AS (SELECT (avg(d) FILTER (WHERE p = q) + avg(d) FILTER (WHERE p <> q)) / 2 AS eta FROM d WHERE p IS NOT NULL AND q IS NOT NULL),
t AS (SELECT *, CASE WHEN p IS NULL AND q IS NULL THEN 'uu' ELSE 'lu' END AS kind, (eta - d) / 0.5 AS z, abs(d - eta) <= 0.4 AS chosen FROM d, eta WHERE p IS NULL OR q IS NULL),
h AS (SELECT *, greatest(z, 0) + ln(1 + exp(-abs(z))) - z / (1 + exp(-z)) AS h FROM t)"""


@query("pair_trace_blocks", f"""WITH {_TRACE}, g AS (SELECT kind, left_block, right_block, count(*) AS candidates, count(*) FILTER (WHERE chosen) AS selected, avg(h) FILTER (WHERE chosen) AS mean, coalesce(sum(h) FILTER (WHERE chosen), 0) AS s FROM h GROUP BY 1, 2, 3)
SELECT kind, left_block, right_block, candidates, selected, round(mean, 6) AS mean_entropy, round(selected / sum(selected) OVER (), 9) AS weight, round(s / sum(selected) OVER (), 9) AS contribution FROM g""")
def _(read):
    e = _partly_labelled(read)
    eta = T.midpoint(e, "embedding", 1.0)
    t = T.block_trace(e, "embedding", eta, 0.5, 0.4, width=100).drop("confident")
    return t.withColumns({"mean_entropy": F.round("mean_entropy", 6), "weight": F.round("weight", 9), "contribution": F.round("contribution", 9)})


def _partly_labelled(read):
    return read("embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 5 == 0, F.col("label")).alias("label"))


@query("running_alignment", f"""WITH RECURSIVE {_N}, x AS (SELECT vec_id, vec_id // 32 AS b, list_transform(v[1:10], lambda f: exp(f)) AS e FROM u), p AS (SELECT vec_id, b, list_transform(e, lambda f: f / list_sum(e)) AS p FROM x),
i AS (SELECT b, p, generate_subscripts(p, 1) AS j, unnest(p) AS f FROM p), m AS (SELECT b, list(f ORDER BY j) AS m, row_number() OVER (ORDER BY b) AS k FROM (SELECT b, j, avg(f) AS f FROM i GROUP BY 1, 2) GROUP BY b),
w AS (SELECT 0::BIGINT AS k, list_transform(range(10), lambda z: 0.1::DOUBLE) AS da UNION ALL SELECT m.k, list_transform(da, lambda a, j: 0.9 * a + 0.1 * m[j]) FROM w JOIN m ON m.k = w.k + 1),
r AS (SELECT vec_id, list_transform(p, lambda f, j: f / greatest(da[j], 1e-7)) AS r FROM p JOIN m USING (b) JOIN w ON w.k = m.k - 1), a AS (SELECT vec_id, list_transform(r, lambda f: f / greatest(list_sum(r), 1e-7)) AS a FROM r)
SELECT vec_id, list_position(a, list_max(a)) - 1 AS best, round(list_max(a), 6) AS top, round(a[1], 6) AS first FROM a""")
def _(read):
    p = read("embeddings").select("vec_id", F.floor(F.col("vec_id") / 32).alias("b"), X.softmax(F.slice(X.doubles("embedding"), 1, 10)).alias("p"))
    a = A.distribution_alignment(p, "b", "p", 0.9)
    return a.select("vec_id", X.argmax(F.col("aligned")).alias("best"), F.round(F.array_max("aligned"), 6).alias("top"), F.round(F.col("aligned")[0], 6).alias("first"))


@query("mixed_label_propagation_factored", f"""WITH {_MIXED}, t AS (SELECT node, class, abs(x) / sum(abs(x)) OVER (PARTITION BY node) AS p FROM g)
SELECT node, arg_min(class, (-p, class)) AS pred_label, round(1 + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln((SELECT count(*) FROM k0)), 6) AS confidence FROM t GROUP BY 1""")
def _(read):
    rows = read("embeddings").select("vec_id", "label", "embedding")
    e = G._cut(G.mixed_affinity(knn(rows, rows, "embedding", 10)))
    nodes, seeds = rows.select(F.col("vec_id").alias("node")), rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("node"), F.col("label").alias("class"))
    f = S.mixed_propagation(e, nodes, seeds, solver="factor")
    return S.confident(f, nodes, seeds).select("node", "pred_label", F.round("confidence", 6).alias("confidence"))


_LAP = f"""{_K}, f AS (SELECT vec_id FROM embeddings WHERE vec_id % 5 <> 0), s2 AS (SELECT query_id, ref_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM s WHERE query_id % 5 <> 0 AND ref_id % 5 <> 0),
b AS (SELECT DISTINCT src, dst FROM (SELECT query_id AS src, ref_id AS dst FROM s2 WHERE rank <= 10 UNION ALL SELECT ref_id, query_id FROM s2 WHERE rank <= 10)),
lap AS (SELECT round(avg(list_inner_product(x.v, x.v) + list_inner_product(y.v, y.v) - 2 * list_inner_product(x.v, y.v)), 6) AS r FROM b JOIN n x ON x.vec_id = src JOIN n y ON y.vec_id = dst WHERE src < dst)"""


@query("regulariser_totals", f"""WITH {_LAP}, {_TRACE.replace(_N + ',', '').replace('vec_id // 100', 'vec_id // 256')}, ent AS (SELECT avg(h) AS r FROM h WHERE chosen AND left_block = right_block),
sup AS (SELECT avg(l - 1) AS loss FROM n WHERE vec_id % 5 = 0)
SELECT 'laplacian' AS name, round(loss, 6) AS supervised, round(r, 6) AS regularisation, round(loss + 0.5 * r, 6) AS total FROM lap, sup
UNION ALL SELECT 'pair_entropy', round(loss, 6), round(r, 6), round(0.25 * loss + 2 * r, 6) FROM ent, sup""")
def _(read):
    e = read("embeddings").select("vec_id", "embedding", "label")
    labelled, free = e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0")
    supervised = labelled.agg(F.avg(X.norm(X.doubles("embedding")) - 1).alias("loss"))
    plugins = (R.get("laplacian", weight=0.5), R.get("pair_entropy", weight=2.0, supervised_weight=0.25, band=0.4))
    a, b = (R.total(p, labelled, free, supervised) for p in plugins)
    return a.unionByName(b).select("name", *[F.round(c, 6).alias(c) for c in ("supervised", "regularisation", "total")])


def _neumann(rounds):
    """CTEs that spread labels over rows and their anchors: ``f <- a P f + (1 - a) y``, whose error falls tenfold a round."""
    out = ", f0 AS MATERIALIZED (SELECT id, i, list_transform(y, lambda x: 0.9 * x) AS f FROM nodes)"
    for k in range(rounds):
        out += f""", f{k + 1} AS MATERIALIZED (SELECT id, i, list(f ORDER BY c) AS f FROM (SELECT t.id, t.i, c, 0.1 * sum(t.p * f.f[c]) + 0.9 * any_value(n.y[c]) AS f FROM tr t JOIN f{k} f ON f.id = t.id AND f.i = t.j JOIN nodes n ON n.id = t.id AND n.i = t.i, generate_series(1, 10) g(c) GROUP BY ALL) GROUP BY 1, 2)"""
    return out


#: From nodes (id, i, v, y), a row (i = 0) and its anchors each, to pr (id, f): the row's propagated probabilities.
_SOLVED = f"""lg AS (SELECT a.id, a.i, b.i AS j, list_inner_product(a.v, b.v) / 0.1 AS x FROM nodes a JOIN nodes b ON a.id = b.id AND a.i <> b.i), ex AS (SELECT *, exp(x - max(x) OVER (PARTITION BY id, i)) AS w FROM lg),
tr AS MATERIALIZED (SELECT id, i, j, w / sum(w) OVER (PARTITION BY id, i) AS p FROM ex){_neumann(14)},
pr AS MATERIALIZED (SELECT id, list_transform(f, lambda x: x / list_sum(f)) AS f FROM f14 WHERE i = 0)"""
_SIM = f"""{_N}, e AS MATERIALIZED (SELECT vec_id AS id, label, v, list_transform(v, lambda x: x / l) AS s FROM n), tv AS (SELECT id, list_transform(v, lambda x, i: x * (1 + 0.1 * ((i - 1) % 3))) AS t FROM e),
un AS MATERIALIZED (SELECT e.id, s, list_transform(t, lambda x: x / sqrt(list_inner_product(t, t))) AS t, list_transform(v[11:20], lambda x: 4 * x) AS z, list_transform(v[1:10], lambda x: exp(8 * x)) AS w FROM e JOIN tv USING (id) WHERE id % 5 > 1),
us AS MATERIALIZED (SELECT id, s, t, z, list_transform(w, lambda x: x / list_sum(w)) AS p FROM un),
q AS MATERIALIZED (SELECT id, s AS v, list_transform(w, lambda x: x / list_sum(w)) AS p FROM (SELECT id, s, list_transform(v[21:30], lambda x: exp(8 * x)) AS w FROM e WHERE id % 5 = 1)),
near AS (SELECT us.id, a.id AS ref, a.label, a.s AS v, row_number() OVER (PARTITION BY us.id ORDER BY list_inner_product(us.t, a.s) DESC, a.id) AS i FROM us, e a WHERE a.id % 5 = 0),
nodes AS MATERIALIZED (SELECT id, 0 AS i, t AS v, p AS y FROM us UNION ALL SELECT id, i, v, list_transform(range(10), lambda c: CASE WHEN c = label THEN 1.0 ELSE 0.0 END) FROM near WHERE i <= 8),
{_SOLVED}"""


@query("simmatch_total", f"""WITH {_SIM}, r AS (SELECT us.id, q.id AS slot, q.p AS qp, list_inner_product(us.t, q.v) / 0.1 AS a, list_inner_product(us.s, q.v) / 0.1 AS b FROM us, q),
w AS (SELECT id, slot, qp, exp(a - max(a) OVER k) AS a, exp(b - max(b) OVER k) AS b FROM r WINDOW k AS (PARTITION BY id)), x AS MATERIALIZED (SELECT id, slot, qp, a / sum(a) OVER k AS t, b / sum(b) OVER k AS s FROM w WINDOW k AS (PARTITION BY id)),
ee AS (SELECT id, -sum(t * ln(greatest(s, 1e-7))) AS ee FROM x GROUP BY 1), ce AS (SELECT id, list(e ORDER BY c) AS e FROM (SELECT id, c, sum(s * qp[c]) AS e FROM x, generate_series(1, 10) g(c) GROUP BY 1, 2) GROUP BY 1),
rowwise AS (SELECT list_max(p) >= 0.25 AS sure, -list_inner_product(f, list_transform(z, lambda y: y - ln(list_sum(list_transform(z, lambda o: exp(o)))))) AS nn, ee, -list_inner_product(p, list_transform(e, lambda y: ln(greatest(y, 1e-7)))) AS ne FROM us JOIN pr USING (id) JOIN ee USING (id) JOIN ce USING (id)),
lx AS (SELECT avg(-(4 * v[label + 1] - ln(list_sum(list_transform(v[1:10], lambda o: exp(4 * o)))))) AS classification FROM e WHERE id % 5 = 0),
m AS (SELECT avg(CASE WHEN sure THEN nn ELSE 0 END) AS node_node, avg(ee) AS edge_edge, avg(ne) AS node_edge, avg(CAST(sure AS INTEGER)) AS confident FROM rowwise)
SELECT round(classification, 6) AS classification, round(node_node, 6) AS node_node, round(edge_edge, 6) AS edge_edge, round(node_edge, 6) AS node_edge, round(confident, 6) AS confident, round(classification + 2 * node_node + 0.5 * edge_edge + node_edge, 6) AS total FROM lx, m""")
def _(read):
    m = M.total_loss(*_streams(read), 10, threshold=0.25, weights=(1.0, 2.0, 0.5, 1.0))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("simmatch_propagated", f"WITH {_SIM} SELECT id, list_position(f, list_max(f)) - 1 AS best, round(list_max(f), 6) AS confidence FROM pr")
def _(read):
    _, free, anchors, _ = _streams(read)
    u = free.select("id", X.unit(X.doubles("teacher")).alias("v"), X.softmax(X.doubles("teacher_logits")).alias("p"))
    a = anchors.select("id", X.unit(X.doubles("v")).alias("v"), "label")
    near = knn(u.select("id", "v"), a.select("id", "v"), "v", 8, id_col="id", metric="dot", skip_self=False)
    p = M.propagated(near, u, a, 10, 0.1, 0.1)
    return p.select("id", X.argmax(F.col("propagated")).alias("best"), F.round(F.array_max("propagated"), 6).alias("confidence"))


#: The older operator starts rows without probabilities of their own.
ORACLES["simmatch_propagate"] = f"""WITH {_N}, e AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(v, lambda x: x / l) AS s FROM n),
near AS (SELECT q.id, a.label, a.s AS v, row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.s, a.s) DESC, a.id) AS i FROM e q, e a WHERE q.id % 5 <> 0 AND a.id % 5 = 0),
nodes AS MATERIALIZED (SELECT id, 0 AS i, s AS v, list_transform(range(10), lambda c: 0.0::DOUBLE) AS y FROM e WHERE id % 5 <> 0 UNION ALL SELECT id, i, v, list_transform(range(10), lambda c: CASE WHEN c = label THEN 1.0 ELSE 0.0 END) FROM near WHERE i <= 8),
{_SOLVED} SELECT id AS query_id, list_position(f, list_max(f)) - 1 AS pred_label, round(list_max(f), 6) AS confidence FROM pr"""


def _streams(read):
    """Every fifth vector is labelled and an anchor, the ones after them are the queue, the others the unlabelled stream;
    its teacher sees the vector with some dimensions stretched, and logits are parts of the vectors."""
    e = read("embeddings").select(F.col("vec_id").alias("id"), "label", X.doubles("embedding").alias("v"))
    part = lambda a, k: F.transform(F.slice("v", a, 10), lambda x: x * k)
    teacher = F.transform("v", lambda x, i: x * (1 + 0.1 * (i % 3)))
    labelled = e.where("id % 5 = 0").select("id", "label", part(1, 4.0).alias("logits"))
    free = e.where("id % 5 > 1").select("id", F.floor(F.col("id") / 32).alias("batch"), part(11, 4.0).alias("student_logits"), F.col("v").alias("student"), part(1, 8.0).alias("teacher_logits"), teacher.alias("teacher"))
    queue = e.where("id % 5 = 1").select(F.col("id").alias("slot"), "v", X.softmax(part(21, 8.0)).alias("p"))
    return labelled, free, e.where("id % 5 = 0").select("id", "v", "label"), queue


@query("feature_cache_counters", """WITH d AS (SELECT text, doc_id % 3 <> 0 AS a, doc_id % 3 <> 1 AS b FROM documents), k AS (SELECT text, bool_or(a) AS a, bool_or(b) AS b FROM d GROUP BY text),
x AS (SELECT count(*) FILTER (WHERE d.a) AS na, count(*) FILTER (WHERE d.b) AS nb, count(*) FILTER (WHERE d.b AND k.a) AS known, count(*) AS n FROM d JOIN k ON k.text IS NOT DISTINCT FROM d.text), y AS (SELECT count(*) FILTER (WHERE a) AS wa, count(*) FILTER (WHERE b AND NOT a) AS wb FROM k)
SELECT 'first' AS session, 1 AS fully_cached_batches, 2 AS batches_with_misses, known + n AS hit_samples, known + n AS memory_hit_samples, 0 AS disk_hit_samples, na + nb - known AS miss_samples, wa + wb AS written_samples FROM x, y
UNION ALL SELECT 'second', 1, 0, n, 0, n, 0, 0 FROM x""")
def _(read):
    """Texts' lengths as features: two overlapping batches and all rows in one session, then all rows in another."""
    d = read("documents").select("doc_id", "text")
    spark, path = d.sparkSession, f"{shared_dir(d.sparkSession)}/features-{uuid.uuid4().hex}"
    sessions = [FeatureCache(spark, path, lambda rows: rows.select("key", F.array(F.length("text")).alias("feature"))) for _ in range(2)]
    for batch in (d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 <> 1"), d):
        sessions[0].get(batch, "text")
    sessions[1].get(d, "text")
    names = list(sessions[0].stats)
    rows = [(n, *[int(c.stats[k]) for k in names]) for n, c in zip(("first", "second"), sessions, strict=True)]
    return spark.createDataFrame(rows, "session string, " + ", ".join(f"{k} long" for k in names))


@query("study_cache_reuse", "WITH t AS (SELECT c_mktsegment AS key, count(*) AS n FROM customer GROUP BY 1) SELECT key, n AS first_rows, n AS second_rows, CAST((SELECT count(*) FROM t) AS BIGINT) AS misses, CAST((SELECT count(*) FROM t) AS BIGINT) AS hits FROM t")
def _(read):
    """Customers of each segment as datasets of a study: computed by its first session, found ready by the second."""
    c = read("customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    spark, path = c.sparkSession, f"{shared_dir(c.sparkSession)}/study-{uuid.uuid4().hex}"
    sessions = [StudyCache(spark, path) for _ in range(2)]
    keys = sorted(r[0] for r in c.select("c_mktsegment").distinct().collect())  # a row per dataset
    made = [{k: s.get_or_compute(k.replace(" ", "_"), lambda k=k: c.where(F.col("c_mktsegment") == k)).count() for k in keys} for s in sessions]
    a, b = (s.stats() for s in sessions)
    return spark.createDataFrame([(k, made[0][k], made[1][k], a["misses"] + b["misses"], a["hits"] + b["hits"]) for k in keys], "key string, first_rows long, second_rows long, misses long, hits long")


@query("split_lists", f"""WITH t AS (SELECT c_custkey AS s, CASE WHEN c_custkey % 5 = 4 THEN 'valid' WHEN c_custkey % 3 = 0 THEN 'labeled' ELSE 'unlabeled' END AS part FROM customer), i AS (SELECT *, row_number() OVER (ORDER BY s) - 1 AS position FROM t WHERE part <> 'valid')
SELECT 'train_indices' AS list, position AS place, s AS value FROM i UNION ALL SELECT part || '_positions', row_number() OVER (PARTITION BY part ORDER BY s) - 1, position FROM i UNION ALL SELECT part || '_indices', row_number() OVER (PARTITION BY part ORDER BY s) - 1, s FROM t""")
def _(read):
    k = F.col("c_custkey")
    part = F.when(k % 5 == 4, "valid").when(k % 3 == 0, "labeled").otherwise("unlabeled")
    return split_lists(read("customer").select(k.alias("s"), part.alias("part")), "part", "s")


@query("grid_rows", """WITH s AS (SELECT DISTINCT l_suppkey AS mode, l_returnflag AS flag FROM lineitem), t AS (SELECT l_suppkey AS mode, l_returnflag AS flag, arg_max(l_orderkey, (l_extendedprice, -l_orderkey, -l_linenumber)) AS best_trial_number, max(l_extendedprice) AS best_hpo_value, max(l_discount) AS valid_metric FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1, 2),
r AS (SELECT l_suppkey AS mode, l_returnflag AS flag, max(l_linenumber) - 2 AS last_epoch, min(l_discount) AS valid_metric, round(avg(l_tax), 6) AS test_metric FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1, 2)
SELECT mode, flag, best_trial_number, best_hpo_value, coalesce(r.valid_metric, t.valid_metric) AS valid_metric, test_metric, CAST(CASE WHEN last_epoch IS NOT NULL THEN greatest(0, last_epoch + 1) END AS BIGINT) AS final_training_epochs FROM s LEFT JOIN t USING (mode, flag) LEFT JOIN r USING (mode, flag)""")
def _(read):
    """Suppliers by return flag as scenarios; rows of the same are their trials and runs."""
    rows = read("lineitem").withColumnsRenamed({"l_suppkey": "mode", "l_returnflag": "flag"})
    by = lambda d: d.groupBy("mode", "flag")
    best = F.max_by("l_orderkey", F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber")))
    studies = by(rows.where("flag <> 'A'")).agg(best.alias("best_trial_number"), F.max("l_extendedprice").alias("best_hpo_value"), F.max("l_discount").alias("valid_metric"))
    runs = by(rows.where("mode % 2 = 0")).agg((F.max("l_linenumber") - 2).cast("long").alias("last_epoch"), F.min("l_discount").alias("valid_metric"), F.round(F.avg("l_tax"), 6).alias("test_metric"))
    return grid_rows(rows.select("mode", "flag").distinct(), studies, runs, ["mode", "flag"], ["valid_metric", "test_metric"])
