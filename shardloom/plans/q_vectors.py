"""Queries over vectors, neighbours, retrieval, pseudo-labels, graphs, propagation and pairwise objectives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import graph as G
from ..operators import losses as L
from ..operators import pair_trace as T
from ..operators import pseudo as P
from ..operators import retrieval as R
from ..operators import propagation as S
from ..operators.knn import knn, majority_vote
from .registry import query

_N = """u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS l FROM u)"""
_S = _N + """, s AS (SELECT a.vec_id AS query_id, b.vec_id AS ref_id, a.label AS ql, b.label AS rl, list_inner_product(a.v, b.v) / (a.l * b.l) AS score FROM n a, n b WHERE a.vec_id <> b.vec_id)"""
_K = _S + """, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM s)"""


def _e(read):
    return read("embeddings").select("vec_id", "label", "embedding")


def _near(read, k):
    e = _e(read)
    return knn(e, e, "embedding", k)


@query("l2_normalize_norms", f"WITH {_N} SELECT vec_id, round(l, 6) AS norm, round(v[1] / l, 6) AS first FROM n")
def _(read):
    v = X.doubles("embedding")
    return _e(read).select("vec_id", F.round(X.norm(v), 6).alias("norm"), F.round(X.unit(v)[0], 6).alias("first"))


@query("embedding_norm_diag", f"WITH {_N} SELECT count(*) AS n, round(min(l), 6) AS min_norm, round(avg(l), 6) AS mean_norm, round(stddev_pop(l), 6) AS std_norm, round(max(l), 6) AS max_norm FROM n")
def _(read):
    l = _e(read).select(X.norm(X.doubles("embedding")).alias("l"))  # noqa: E741
    return l.agg(F.count(F.lit(1)).alias("n"), F.round(F.min("l"), 6).alias("min_norm"), F.round(F.avg("l"), 6).alias("mean_norm"), F.round(F.stddev_pop("l"), 6).alias("std_norm"), F.round(F.max("l"), 6).alias("max_norm"))


@query("nonfinite_check", "WITH x AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS f FROM embeddings) SELECT count(*) FILTER (WHERE isnan(f)) AS nans, count(*) FILTER (WHERE isinf(f)) AS infs, count(DISTINCT vec_id) FILTER (WHERE isnan(f) OR isinf(f)) AS bad_rows FROM x")
def _(read):
    v = X.doubles("embedding")
    return _e(read).select(X.count_nan(v).alias("a"), X.count_inf(v).alias("b")).agg(F.sum("a").alias("nans"), F.sum("b").alias("infs"), F.count_if((F.col("a") > 0) | (F.col("b") > 0)).alias("bad_rows"))


@query("knn_cosine", f"WITH {_K} SELECT query_id, ref_id, round(score, 6) AS score, rank FROM k WHERE rank <= 10")
def _(read):
    return _near(read, 10).select("query_id", "ref_id", F.round("score", 6).alias("score"), "rank")


@query("knn_l2", f"""WITH {_N}, d AS (SELECT a.vec_id AS query_id, b.vec_id AS ref_id, list_inner_product(a.v, a.v) + list_inner_product(b.v, b.v) - 2 * list_inner_product(a.v, b.v) AS d FROM n a, n b),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id = ref_id THEN -1 ELSE d END, ref_id) AS rank FROM d) SELECT query_id, ref_id, round(abs(d), 6) AS distance, rank FROM k WHERE rank <= 5""")
def _(read):
    e = _e(read)
    return knn(e, e, "embedding", 5, metric="l2", skip_self=False).select("query_id", "ref_id", F.round(F.abs("score"), 6).alias("distance"), "rank")


_M = _K + """, c AS (SELECT label, count(*) - 1 AS r FROM embeddings GROUP BY 1), h AS (SELECT k.*, c.r, CAST(ql = rl AS INTEGER) AS rel, sum(CAST(ql = rl AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM k JOIN c ON c.label = ql WHERE c.r > 0),
m AS (SELECT query_id, ql AS label, CAST(max(CASE WHEN rank = 1 THEN rel END) AS DOUBLE) AS precision_at_1, sum(CASE WHEN rank <= r THEN rel * cum / rank ELSE 0.0 END) / max(r) AS map_at_r,
  CAST(sum(CASE WHEN rank <= r THEN rel ELSE 0 END) AS DOUBLE) / max(r) AS r_precision, CAST(max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS DOUBLE) AS hit_at_5, CAST(max(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS DOUBLE) AS hit_at_10 FROM h GROUP BY 1, 2)"""
_AVG = "count(*) AS num_queries, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("precision_at_1", "map_at_r", "r_precision", "hit_at_5", "hit_at_10"))


def _metrics(read):
    e = _e(read)
    return R.query_metrics(e, e, "embedding", "label")


@query("retrieval_metrics", f"WITH {_M} SELECT {_AVG} FROM m")
def retrieval_metrics(read):
    return R.averaged(_metrics(read))


@query("r_precision_hit_at_k", f"WITH {_M} SELECT query_id, round(r_precision, 6) AS r_precision, hit_at_5, hit_at_10 FROM m")
def _(read):
    return _metrics(read).select("query_id", F.round("r_precision", 6).alias("r_precision"), "hit_at_5", "hit_at_10")


@query("per_class_retrieval", f"WITH {_M} SELECT label, {_AVG} FROM m GROUP BY label")
def _(read):
    return R.averaged(_metrics(read), ("label",))


@query("per_class_weighted", f"WITH {_M}, p AS (SELECT label, count(*) AS n, avg(map_at_r) AS x FROM m GROUP BY 1) SELECT round(sum(n * x) / sum(n), 6) AS weighted, round(avg(x), 6) AS macro, round(min(x), 6) AS min, round(max(x), 6) AS max, round(stddev_pop(x), 6) AS std FROM p")
def _(read):
    p = _metrics(read).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("map_at_r").alias("x"))
    return R.class_summary(p, "x", "n")


@query("query_gallery_retrieval", f"""WITH {_N}, s AS (SELECT a.vec_id AS query_id, a.label AS ql, b.label AS rl, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.v, b.v) / (a.l * b.l) DESC, b.vec_id) AS rank FROM n a, n b WHERE a.vec_id % 4 = 0 AND b.vec_id % 4 <> 0),
c AS (SELECT label, count(*) AS r FROM embeddings WHERE vec_id % 4 <> 0 GROUP BY 1), h AS (SELECT s.*, r, CAST(ql = rl AS INTEGER) AS rel, sum(CAST(ql = rl AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS cum FROM s JOIN c ON c.label = ql)
, m AS (SELECT query_id, CAST(max(CASE WHEN rank = 1 THEN rel END) AS DOUBLE) AS precision_at_1, sum(CASE WHEN rank <= r THEN rel * cum / rank ELSE 0.0 END) / max(r) AS map_at_r, CAST(sum(CASE WHEN rank <= r THEN rel ELSE 0 END) AS DOUBLE) / max(r) AS r_precision,
  CAST(max(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS DOUBLE) AS hit_at_5, CAST(max(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS DOUBLE) AS hit_at_10 FROM h GROUP BY 1) SELECT {_AVG} FROM m""")
def _(read):
    e = _e(read)
    return R.averaged(R.query_metrics(e.where("vec_id % 4 = 0"), e.where("vec_id % 4 <> 0"), "embedding", "label", same_source=False))


_V = _S + """, w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) AS rank FROM s WHERE query_id % 5 <> 0 AND ref_id % 5 = 0),
v AS (SELECT query_id, rl AS pred_label, count(*) AS votes FROM w WHERE rank <= 5 GROUP BY 1, 2),
p AS (SELECT query_id, pred_label, votes, round(votes / 5, 6) AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, pred_label) = 1)"""


def _votes(read, k=5):
    e = _e(read)
    labeled = e.where("vec_id % 5 = 0")
    return majority_vote(knn(e.where("vec_id % 5 <> 0"), labeled, "embedding", k), labeled)


@query("knn_majority_vote", f"WITH {_V} SELECT * FROM p")
def _(read):
    return _votes(read)


@query("knn_single_neighbour", f"WITH {_S} SELECT query_id, rl AS pred_label, CAST(1 AS BIGINT) AS votes, round(score, 6) AS confidence FROM s WHERE query_id % 5 <> 0 AND ref_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) = 1")
def _(read):
    return _votes(read, 1)


@query("pseudo_filter", f"WITH {_V} SELECT query_id, pred_label, confidence, 'threshold' AS reason FROM p WHERE confidence >= 0.6 AND pred_label < 8")
def _(read):
    return P.filter_labels(_votes(read), _e(read).where("label < 8").select("label").distinct(), 0.6)


@query("pseudo_rescue", f"""WITH {_V}, a AS (SELECT query_id, pred_label, confidence, 'threshold' AS reason FROM p WHERE confidence >= 0.8), h AS (SELECT DISTINCT pred_label FROM a),
x AS (SELECT p.* FROM p WHERE confidence < 0.8 AND confidence >= 0.2 AND pred_label NOT IN (SELECT pred_label FROM h)),
c AS (SELECT pred_label, row_number() OVER (ORDER BY max(confidence) DESC, pred_label) AS n FROM x GROUP BY 1), y AS (SELECT *, row_number() OVER (PARTITION BY pred_label ORDER BY confidence DESC, query_id) AS i FROM x)
SELECT * FROM a UNION ALL SELECT query_id, pred_label, confidence, 'rescue' FROM y WHERE i <= 3 AND pred_label IN (SELECT pred_label FROM c WHERE n <= 8 - (SELECT count(*) FROM h))""")
def _(read):
    return P.filter_labels(_votes(read), _e(read).select("label").distinct(), 0.8, required=8, top_k=3, floor=0.2)


_A = _V + ", t AS (SELECT p.*, label AS true_label, pred_label = label AS ok FROM p JOIN embeddings ON vec_id = query_id)"


@query("pseudo_audit", f"WITH {_A} SELECT coalesce(true_label, -1) AS true_label, count(*) AS n, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS correct, round(avg(CAST(ok AS INTEGER)), 6) AS accuracy FROM t GROUP BY GROUPING SETS ((true_label), ())")
def _(read):
    return P.audit(_votes(read), _e(read)).withColumn("true_label", F.coalesce("true_label", F.lit(-1)))


def _judged(read):
    t = _e(read).select(F.col("vec_id").alias("query_id"), "label")
    return _votes(read).join(t, "query_id").select("query_id", "confidence", (F.col("pred_label") == F.col("label")).alias("ok"))


@query("confidence_auc", f"""WITH {_A}, r AS (SELECT *, rank() OVER (ORDER BY confidence) + (count(*) OVER (PARTITION BY confidence) - 1) / 2 AS k FROM t), z AS (SELECT sum(CASE WHEN ok THEN k ELSE 0.0 END) AS s, CAST(count(*) FILTER (WHERE ok) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE NOT ok) AS DOUBLE) AS b FROM r)
SELECT CAST(a AS BIGINT) AS n_correct, CAST(b AS BIGINT) AS n_wrong, round(CASE WHEN a > 0 AND b > 0 THEN (s - a * (a + 1) / 2) / (a * b) END, 6) AS auc FROM z""")
def _(read):
    return P.auc(_judged(read), "confidence", "ok")


@query("average_ranks", "SELECT p_partkey, p_size, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS avg_rank FROM part")
def _(read):
    return P.average_ranks(read("part").select("p_partkey", "p_size"), "p_size")


@query("calibration_buckets", f"""WITH {_A}, i AS (SELECT *, row_number() OVER (ORDER BY confidence, query_id) - 1 AS i, count(*) OVER () AS n FROM t), b AS (SELECT *, ((i + 1) * 10 - 1) // n AS bucket FROM i)
SELECT bucket, count(*) AS n, min(confidence) AS min_conf, max(confidence) AS max_conf, round(avg(confidence), 6) AS mean_conf, round(avg(CAST(ok AS INTEGER)), 6) AS accuracy FROM b GROUP BY 1""")
def _(read):
    return P.calibration(G._cut(_judged(read)), "confidence", "ok", "query_id")


@query("confidence_summary", f"WITH {_V} SELECT count(*) AS n, min(confidence) AS min, quantile_cont(confidence, 0.25) AS p25, median(confidence) AS median, quantile_cont(confidence, 0.75) AS p75, max(confidence) AS max, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std FROM p")
def _(read):
    from ..operators.distribution import numeric_summary

    return numeric_summary(_votes(read), "confidence")


@query("generation_diff", f"""WITH {_V}, o AS (SELECT query_id, rl AS x FROM w WHERE rank = 1 AND query_id % 7 <> 0), w2 AS (SELECT query_id, pred_label AS y FROM p WHERE query_id % 11 <> 0), j AS (SELECT x, y FROM o FULL JOIN w2 USING (query_id))
SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS overlap, count(*) FILTER (WHERE x <> y) AS changed, count(*) FILTER (WHERE x IS NULL) AS added, count(*) FILTER (WHERE y IS NULL) AS removed,
  round(count(*) FILTER (WHERE x <> y) / count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL), 6) AS changed_fraction FROM j""")
def _(read):
    return P.generation_diff(_votes(read, 1).where("query_id % 7 <> 0"), _votes(read).where("query_id % 11 <> 0"))


@query("relabeled_union", f"WITH {_V} SELECT vec_id AS sample_id, CAST(label AS BIGINT) AS label, 1.0::DOUBLE AS confidence, 'true' AS provenance FROM embeddings WHERE vec_id % 5 = 0 UNION ALL SELECT query_id, pred_label, confidence, 'pseudo' FROM p WHERE confidence >= 0.6")
def _(read):
    return P.relabeled(_e(read).where("vec_id % 5 = 0"), _votes(read).where("confidence >= 0.6"))


_G = _K + """, d AS (SELECT query_id AS src, ref_id AS dst, greatest(score, 0) AS w FROM k WHERE rank <= 10), a AS (SELECT src, dst, sum(w) AS w FROM (SELECT * FROM d UNION ALL SELECT dst, src, w FROM d) GROUP BY 1, 2 HAVING sum(w) > 0),
b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM d UNION ALL SELECT dst, src FROM d))"""


@query("knn_graph_binary", f"WITH {_G} SELECT src, dst, 1.0::DOUBLE AS w FROM b")
def _(read):
    return G.binary_graph(_near(read, 10))


@query("mixed_affinity", f"WITH {_G} SELECT src, dst, round(w, 6) AS w FROM a")
def _(read):
    return G.mixed_affinity(_near(read, 10)).select("src", "dst", F.round("w", 6).alias("w"))


@query("degrees", f"WITH {_G} SELECT src AS node, count(*) AS degree, round(sum(w), 6) AS weight FROM a GROUP BY 1")
def _(read):
    return G.degrees(G.mixed_affinity(_near(read, 10))).select("node", "degree", F.round("weight", 6).alias("weight"))


_SUP = "p AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 = 0)"


@query("supervised_graph", f"WITH {_SUP} SELECT src, dst, round(1.0 / (SELECT count(*) FROM p), 9) AS w FROM p")
def _(read):
    return G.supervised_graph(_e(read).where("vec_id % 5 = 0"), "vec_id", "label").select("src", "dst", F.round("w", 9).alias("w"))


@query("slrml_graph", f"WITH {_G}, {_SUP} SELECT src, dst, round(sum(w), 9) AS w FROM (SELECT src, dst, 0.1 AS w FROM b UNION ALL SELECT src, dst, 1.0 / (SELECT count(*) FROM p) FROM p) GROUP BY 1, 2")
def _(read):
    return G.supervised_knn_graph(_near(read, 10), 10, _e(read).where("vec_id % 5 = 0"), "vec_id", "label").select("src", "dst", F.round("w", 9).alias("w"))


@query("laplacian_energy", f"""WITH {_G}, e AS (SELECT list_inner_product(x.v, x.v) + list_inner_product(y.v, y.v) - 2 * list_inner_product(x.v, y.v) AS d FROM b JOIN n x ON x.vec_id = src JOIN n y ON y.vec_id = dst WHERE src < dst)
SELECT count(*) AS edges, round(sum(d), 6) AS energy, round(avg(d), 6) AS mean_energy FROM e""")
def _(read):
    return G.energy(G.binary_graph(_near(read, 10)), _e(read), "embedding")


@query("laplacian_energy_normalised", f"""WITH {_G}, g AS (SELECT src AS i, greatest(count(*), 1) AS d FROM b GROUP BY 1),
e AS (SELECT list_inner_product(x.v, x.v) / p.d + list_inner_product(y.v, y.v) / q.d - 2 * list_inner_product(x.v, y.v) / sqrt(p.d * q.d) AS d FROM b JOIN n x ON x.vec_id = src JOIN n y ON y.vec_id = dst JOIN g p ON p.i = src JOIN g q ON q.i = dst WHERE src < dst)
SELECT count(*) AS edges, round(sum(d), 6) AS energy, round(avg(d), 6) AS mean_energy FROM e""")
def _(read):
    return G.energy(G.binary_graph(_near(read, 10)), _e(read), "embedding", normalised=True)


@query("laplacian_identity", f"""WITH {_G}, q AS (SELECT sum(w * (list_inner_product(x.v, x.v) + list_inner_product(y.v, y.v) - 2 * list_inner_product(x.v, y.v))) / 2 AS pairs FROM a JOIN n x ON x.vec_id = src JOIN n y ON y.vec_id = dst)
SELECT round(pairs, 6) AS pairwise, round(pairs, 6) AS quadratic FROM q""")
def _(read):
    e = G.mixed_affinity(_near(read, 10))
    z = _e(read).select(F.col("vec_id").alias("i"), X.doubles("embedding").alias("v"))
    j = e.join(z.select(F.col("i").alias("src"), F.col("v").alias("a")), "src").join(z.select(F.col("i").alias("dst"), F.col("v").alias("b")), "dst")
    s = j.agg(F.sum(F.col("w") * X.squared_distance(F.col("a"), F.col("b"))).alias("p"), F.sum(F.col("w") * X.dot(F.col("a"), F.col("a"))).alias("d"), F.sum(F.col("w") * X.dot(F.col("a"), F.col("b"))).alias("c"))
    return s.select(F.round(F.col("p") / 2, 6).alias("pairwise"), F.round(F.col("d") - F.col("c"), 6).alias("quadratic"))


@query("graph_asymmetry", f"""WITH {_G}, e AS (SELECT src, dst, CASE WHEN src % 50 = 7 AND src < dst THEN -w ELSE w END AS w FROM a WHERE NOT (src % 10 = 3 AND src < dst) UNION ALL SELECT vec_id, vec_id, 1.0 FROM embeddings WHERE vec_id % 100 = 1)
SELECT src, dst FROM e WHERE src = dst OR w <= 0 UNION SELECT least(src, dst), greatest(src, dst) FROM e GROUP BY 1, 2 HAVING count(*) <> 2""")
def _(read):
    """A graph with planted faults: edges without their way back, weights below zero, loops."""
    e = G.mixed_affinity(_near(read, 10))
    up = F.col("src") < F.col("dst")
    e = e.where(~((F.col("src") % 10 == 3) & up)).withColumn("w", F.when((F.col("src") % 50 == 7) & up, -F.col("w")).otherwise(F.col("w")))
    loops = _e(read).where("vec_id % 100 = 1").select(F.col("vec_id").alias("src"), F.col("vec_id").alias("dst"), F.lit(1.0).alias("w"))
    return G.asymmetric(e.unionByName(loops))


@query("induced_subgraph", f"WITH {_G} SELECT src, dst, round(w, 6) AS w FROM a WHERE src < dst AND src % 3 = 0 AND dst % 3 = 0")
def _(read):
    return G.induced(G.mixed_affinity(_near(read, 10)), _e(read).where("vec_id % 3 = 0").select("vec_id"), "vec_id").select("src", "dst", F.round("w", 6).alias("w"))


@query("connected_components", f"""WITH RECURSIVE {_K}, d AS (SELECT query_id AS src, ref_id AS dst FROM k WHERE rank <= 1), b AS (SELECT src, dst FROM d UNION SELECT dst, src FROM d),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT b.src, r.seen FROM r JOIN b ON b.dst = r.node) SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def _(read):
    return G.components(G.binary_graph(_near(read, 1)), _e(read), "vec_id")


def _seeds(read):
    return _e(read).where("vec_id % 5 = 0").select(F.col("vec_id").alias("node"), F.col("label").alias("class"))


_SPREAD = f"""{_G}, g AS (SELECT src AS i, sum(w) AS d FROM a GROUP BY 1), sm AS (SELECT src, dst, w / sqrt(p.d * q.d) AS s FROM a JOIN g p ON p.i = src JOIN g q ON q.i = dst),
f0 AS (SELECT vec_id AS node, label AS class, 0.8 AS y FROM embeddings WHERE vec_id % 5 = 0)"""
_ROUNDS = "".join(
    f", f{i} AS (SELECT node, class, sum(y) AS y FROM (SELECT src AS node, class, 0.2 * s * y AS y FROM sm JOIN f{i - 1} ON dst = node UNION ALL SELECT * FROM f0) GROUP BY 1, 2)" for i in range(1, 21)
)


@query("label_spreading", f"""WITH {_SPREAD}{_ROUNDS}, z AS (SELECT node, class, y, sum(y) OVER (PARTITION BY node) AS m FROM f20 QUALIFY row_number() OVER (PARTITION BY node ORDER BY y DESC, class) = 1)
SELECT node, class AS pred_label, round(y / m, 6) AS confidence FROM z""")
def _(read):
    f = S.spread(G.mixed_affinity(_near(read, 10)), _seeds(read).withColumn("y", F.lit(1.0)), 0.2, 20, 5)
    return S.decided(f, _e(read).select(F.col("vec_id").alias("node"))).select("node", "pred_label", F.round("confidence", 6).alias("confidence"))


def _cg(name, matrix, right, rounds):
    """CTEs of so many rounds of conjugate gradients from zero; the last one is ``name``."""
    out = f", {name}s0 AS MATERIALIZED (SELECT node, class, 0.0::DOUBLE AS x, y AS r, y AS p FROM {right})"
    for i in range(rounds):
        out += f""", {name}u{i} AS MATERIALIZED (SELECT node, class, sum(x) AS x, sum(r) AS r, sum(p) AS p, sum(q) AS q FROM (SELECT *, 0.0 AS q FROM {name}s{i} UNION ALL SELECT src, class, 0.0, 0.0, 0.0, a * p FROM {matrix} JOIN {name}s{i} ON dst = node) GROUP BY 1, 2),
{name}c{i} AS MATERIALIZED (SELECT class, sum(r * r) AS rr, coalesce(sum(r * r) / nullif(sum(p * q), 0), 0) AS step FROM {name}u{i} GROUP BY 1),
{name}v{i} AS MATERIALIZED (SELECT node, class, x + step * p AS x, r - step * q AS r, p, rr FROM {name}u{i} JOIN {name}c{i} USING (class)),
{name}s{i + 1} AS MATERIALIZED (SELECT node, v.class, x, r, r + p * coalesce(b, 0) AS p FROM {name}v{i} v JOIN (SELECT class, sum(r * r) / nullif(max(rr), 0) AS b FROM {name}v{i} GROUP BY 1) USING (class))"""
    return out + f", {name} AS MATERIALIZED (SELECT node, class, x FROM {name}s{rounds})"


@query("class_balanced_diffusion", f"""WITH {_SPREAD}, m AS MATERIALIZED (SELECT src, dst, -0.99 * s AS a FROM sm UNION ALL SELECT vec_id, vec_id, 1.0 FROM embeddings),
y AS (SELECT node, class, 1.0::DOUBLE / count(*) OVER (PARTITION BY class) AS y FROM f0){_cg("f", "m", "y", 20)},
t AS (SELECT node, class, x, x / sum(x) OVER (PARTITION BY node) AS p FROM (SELECT node, class, x FROM f WHERE x > 0)),
e AS (SELECT node, arg_min(class, (-p, class)) AS pred_label, 1 + sum(p * ln(p)) / ln((SELECT count(DISTINCT class) FROM f0)) AS c FROM t GROUP BY 1)
SELECT node, pred_label, round(CASE WHEN node % 5 = 0 THEN 1.0 ELSE c / (SELECT max(c) FROM e) END, 6) AS certainty FROM e""")
def _(read):
    e = G._cut(G.mixed_affinity(_near(read, 10)))
    comp = G.components(e, _e(read), "vec_id")
    f = S.class_balanced_diffusion(e, _e(read).select(F.col("vec_id").alias("node")), _seeds(read), comp)
    return f.select("node", "pred_label", F.round("certainty", 6).alias("certainty"))


_MIXED = f"""{_G}, f0 AS (SELECT vec_id AS node, label AS class, 1.0::DOUBLE / 99 AS y FROM embeddings WHERE vec_id % 5 = 0), deg AS MATERIALIZED (SELECT src AS node, sum(w) AS d FROM a GROUP BY 1),
own AS MATERIALIZED (SELECT vec_id AS node, coalesce(d, 0) AS d, coalesce(d, 0) + CASE WHEN vec_id % 5 = 0 THEN 1.0::DOUBLE / 99 ELSE 0 END AS g FROM embeddings LEFT JOIN deg ON node = vec_id),
m AS MATERIALIZED (SELECT src, dst, -w AS a FROM a UNION ALL SELECT node, node, g FROM own){_cg("f", "m", "f0", 45)},
k0 AS (SELECT DISTINCT class FROM f0), z AS MATERIALIZED (SELECT o.node, k0.class, d, coalesce(x, 0) AS x FROM own o, k0 LEFT JOIN f ON f.node = o.node AND f.class = k0.class),
l AS (SELECT src, dst, p.class, 4 * (p.d * p.x - w * q.x) AS u, 4 * (q.d * q.x - w * p.x) AS v FROM a JOIN z p ON p.node = src JOIN z q ON q.node = dst AND q.class = p.class WHERE src < dst),
h AS (SELECT *, exp(u - max(u) OVER e) AS u1, exp(v - max(v) OVER e) AS v1 FROM l WINDOW e AS (PARTITION BY src, dst)), sx AS (SELECT src, dst, u1 / sum(u1) OVER e AS p, v1 / sum(v1) OVER e AS q FROM h WINDOW e AS (PARTITION BY src, dst)),
diss AS MATERIALIZED (SELECT src, dst, (1 + sum(p * ln(p)) / ln(count(*))) * (1 + sum(q * ln(q)) / ln(count(*))) * (1 - sum(p * q)) AS w FROM sx GROUP BY 1, 2), both_ways AS MATERIALIZED (SELECT src, dst, w FROM diss UNION ALL SELECT dst, src, w FROM diss),
m2 AS MATERIALIZED (SELECT src, dst, sum(a) AS a FROM (SELECT * FROM m UNION ALL SELECT src, dst, 2 * w FROM both_ways UNION ALL SELECT src, src, 2 * w FROM both_ways) GROUP BY 1, 2){_cg("g", "m2", "f0", 45)}"""


@query("mixed_label_propagation", f"""WITH {_MIXED}, t AS (SELECT node, class, abs(x) / sum(abs(x)) OVER (PARTITION BY node) AS p FROM g)
SELECT node, arg_min(class, (-p, class)) AS pred_label, round(1 + sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln((SELECT count(*) FROM k0)), 6) AS confidence FROM t GROUP BY 1""")
def _(read):
    e = G._cut(G.mixed_affinity(_near(read, 10)))
    nodes, seeds = _e(read).select(F.col("vec_id").alias("node")), _seeds(read)
    return S.confident(S.mixed_propagation(e, nodes, seeds), nodes, seeds).select("node", "pred_label", F.round("confidence", 6).alias("confidence"))


@query("softmax_rows", f"WITH {_N}, x AS (SELECT vec_id, unnest(v) AS f, generate_subscripts(v, 1) AS i FROM u), m AS (SELECT *, exp(f - max(f) OVER (PARTITION BY vec_id)) AS e FROM x), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM m) SELECT vec_id, round(max(p), 6) AS top, round(1 + sum(p * ln(p)) / ln(count(*)), 6) AS certainty, arg_min(i, (-f, i)) - 1 AS best FROM p GROUP BY 1")
def _(read):
    p = X.softmax(X.doubles("embedding"))
    return _e(read).select("vec_id", F.round(F.array_max(p), 6).alias("top"), F.round(X.entropy_confidence(p), 6).alias("certainty"), X.argmax(X.doubles("embedding")).alias("best"))


@query("edge_batches_local", "WITH e AS (SELECT user_id AS b, event_id AS p, event_id % 13 AS src, event_id * 7 % 11 AS dst FROM events), x AS (SELECT b, src AS node, p * 2 AS f FROM e UNION ALL SELECT b, dst, p * 2 + 1 FROM e), m AS (SELECT b, node, row_number() OVER (PARTITION BY b ORDER BY min(f)) - 1 AS i FROM x GROUP BY b, node) SELECT e.b, e.p, e.src, e.dst, s.i AS local_src, d.i AS local_dst FROM e JOIN m s ON s.b = e.b AND s.node = e.src JOIN m d ON d.b = e.b AND d.node = e.dst")
def _(read):
    i = F.col("event_id")
    e = read("events").select(F.col("user_id").alias("b"), i.alias("p"), (i % 13).alias("src"), (i * 7 % 11).alias("dst"))
    return G.local_index(e, "b", "p")


_P = _N + ", d AS (SELECT a.vec_id AS i, b.vec_id AS j, a.label AS li, b.label AS lj, 2 - 2 * list_inner_product(a.v, b.v) / (a.l * b.l) AS d FROM n a JOIN n b ON a.vec_id // 256 = b.vec_id // 256 AND a.vec_id < b.vec_id)"
#: Pairwise objectives are defined on batches: runs of 256 ids, which together take every row.
BATCH = 256


@query("pair_distances", f"WITH {_P} SELECT i, j, li, lj, round(d, 6) AS d FROM d")
def _(read):
    return L.pair_distances(_e(read), "embedding", BATCH).withColumn("d", F.round("d", 6))


@query("seraph_pair_entropy", f"""WITH {_P}, e AS (SELECT (avg(d) FILTER (WHERE li = lj) + avg(d) FILTER (WHERE li <> lj)) / 2 AS eta FROM d), x AS (SELECT eta, (eta - d) / 0.5 AS l FROM d, e), y AS (SELECT *, 1 / (1 + exp(-l)) AS s FROM x)
SELECT count(*) AS pairs, round(max(eta), 6) AS eta, round(avg(greatest(l, 0) + ln(1 + exp(-abs(l))) - s * l), 6) AS entropy, round(avg(CAST(s > 0.9 OR s < 0.1 AS INTEGER)), 6) AS confident FROM y""")
def _(read):
    return T.batch_entropy(_e(read), "embedding", 0.5, width=BATCH)


_REF = "r AS (SELECT label AS c, CAST(embedding AS DOUBLE[]) AS y FROM embeddings WHERE vec_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)"


def _references(read):
    e = _e(read).where("vec_id % 5 = 0")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return first


@query("hoffer_entropy", f"""WITH {_N}, {_REF}, s AS (SELECT vec_id, -2.0 * (list_inner_product(v, v) + list_inner_product(y, y) - 2 * list_inner_product(v, y)) AS s FROM u, r WHERE vec_id % 5 <> 0),
m AS (SELECT *, exp(s - max(s) OVER (PARTITION BY vec_id)) AS e FROM s), p AS (SELECT vec_id, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM m), h AS (SELECT vec_id, -sum(p * ln(p)) AS h FROM p GROUP BY 1) SELECT count(*) AS queries, round(avg(h), 6) AS entropy FROM h""")
def _(read):
    return L.reference_entropy(_e(read).where("vec_id % 5 <> 0"), _references(read), "embedding", 2.0)


@query("proxy_loss", f"""WITH {_N}, {_REF}, s AS (SELECT label, c, list_inner_product(v, y) / (l * sqrt(list_inner_product(y, y))) AS s FROM n, r), t AS (SELECT c, CASE WHEN label = c THEN -32 * (s - 0.1) ELSE 32 * (s + 0.1) END AS z FROM s)
SELECT count(DISTINCT c) AS classes, round(sum(greatest(z, 0) + ln(1 + exp(-abs(z)))) / count(DISTINCT c), 4) AS loss FROM t""")
def _(read):
    return L.proxy_loss(_e(read), _references(read), "embedding").withColumn("loss", F.round("loss", 4))




_CTX = f"""{_N}, s AS (SELECT a.vec_id AS i, b.vec_id AS j, CASE WHEN a.vec_id = b.vec_id THEN 2.0 ELSE list_inner_product(a.v, b.v) / (a.l * b.l) END AS score FROM n a, n b),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY i ORDER BY score DESC, j) <= 6), v AS (SELECT a.i, a.j FROM k a JOIN k b ON a.i = b.j AND a.j = b.i),
z AS (SELECT i, count(*) AS n FROM v GROUP BY 1), sh AS (SELECT a.i, b.i AS j, count(*) AS k FROM v a JOIN v b ON a.j = b.j GROUP BY 1, 2), c AS (SELECT sh.i, sh.j, k / greatest(n, 1) AS c FROM sh JOIN v USING (i, j) JOIN z USING (i)),
m AS (SELECT k.i, c.j, sum(c.c) / 3 AS c FROM k JOIN c ON c.i = k.j WHERE k.rank <= 3 GROUP BY 1, 2), ctx AS (SELECT i, j, round(sum(c) / 2, 6) AS ctx FROM (SELECT * FROM m UNION ALL SELECT j, i, c FROM m) GROUP BY 1, 2)"""


def _context(read):
    e = _e(read)
    own = e.select(F.col("vec_id").alias("query_id"), F.col("vec_id").alias("ref_id"), F.lit(1).cast("long").alias("rank"))
    rest = knn(e, e, "embedding", 5).select("query_id", "ref_id", (F.col("rank") + 1).alias("rank"))
    return L.contextual_similarity(own.unionByName(rest), 6)


@query("contextual_similarity", f"WITH {_CTX} SELECT * FROM ctx")
def _(read):
    return _context(read)


@query("relaxed_contrastive", f"""WITH {_CTX}, d AS (SELECT a.vec_id AS i, b.vec_id AS j, greatest(2 - 2 * list_inner_product(a.v, b.v) / (a.l * b.l), 0.0) AS d FROM n a JOIN n b ON a.vec_id // 256 = b.vec_id // 256 AND a.vec_id <> b.vec_id),
q AS (SELECT i, avg(sqrt(d)) AS m FROM d GROUP BY 1), t AS (SELECT sqrt(d) / m AS r, (exp(-d) + coalesce(ctx, 0)) / 2 AS w FROM d JOIN q USING (i) LEFT JOIN ctx USING (i, j))
SELECT round(avg(w * r * r + (1 - w) * pow(greatest(1 - r, 0), 2)), 6) AS loss FROM t""")
def _(read):
    return L.relaxed_contrastive(L.pair_distances(_e(read), "embedding", BATCH), _context(read))


@query("kl_self_distillation", f"""WITH {_P}, b AS (SELECT i, j, d FROM d UNION ALL SELECT j, i, d FROM d), e AS (SELECT i, j, exp(-d) AS a, exp(-2 * d) AS t FROM b), p AS (SELECT i, t / sum(t) OVER (PARTITION BY i) AS p, a / sum(a) OVER (PARTITION BY i) AS q FROM e), r AS (SELECT i, sum(p * (ln(p) - ln(q))) AS k FROM p GROUP BY 1) SELECT round(avg(k), 6) AS kl FROM r""")
def _(read):
    p = L.pair_distances(_e(read), "embedding", BATCH)
    both = p.select("i", "j", "d").unionByName(p.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return L.kl_self_distillation(both, both.withColumn("d", F.col("d") * 2))


@query("simmatch_propagate")
def _(read):
    e = _e(read)
    labeled = e.where("vec_id % 5 = 0")
    out = L.neighbour_propagation(knn(e.where("vec_id % 5 <> 0"), labeled, "embedding", 8), labeled, e, "embedding", 10, 8)
    return out.select("query_id", X.argmax(F.col("probs")).alias("pred_label"), F.round(F.array_max("probs"), 6).alias("confidence"))


@query("distribution_alignment", f"""WITH {_N}, x AS (SELECT vec_id, unnest(v[1:10]) AS f, generate_subscripts(v[1:10], 1) - 1 AS c FROM u), p AS (SELECT vec_id, c, exp(f) / sum(exp(f)) OVER (PARTITION BY vec_id) AS p FROM x), s AS (SELECT vec_id, c, p * 0.1 / avg(p) OVER (PARTITION BY c) AS s FROM p) SELECT vec_id, c, round(s / sum(s) OVER (PARTITION BY vec_id), 6) AS aligned FROM s""")
def _(read):
    from ..operators.trials import distribution_alignment

    p = _e(read).select("vec_id", F.posexplode(X.softmax(F.slice(X.doubles("embedding"), 1, 10))).alias("c", "p")).withColumn("c", F.col("c").cast("long"))
    target = read("embeddings").sparkSession.range(10).select(F.col("id").alias("c"), F.lit(0.1).alias("target"))
    return distribution_alignment(p, "vec_id", "c", "p", target)


@query("pca_2d")
def _(read):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = _e(read).select("vec_id", array_to_vector(X.doubles("embedding")).alias("v"))
    made = PCA(k=2, inputCol="v", outputCol="p").fit(e).transform(e).withColumn("p", vector_to_array("p"))
    return made.select("vec_id", F.round(F.abs(F.col("p")[0]), 6).alias("x"), F.round(F.abs(F.col("p")[1]), 6).alias("y"))
