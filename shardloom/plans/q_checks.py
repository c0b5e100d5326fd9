"""Queries of checks, inverse maps, row normalisers, running means and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as X
from ..operators import batches as B
from ..operators import propagation as P
from ..operators import splits as S
from ..operators import trials as T
from ..sources import sinks
from .registry import query


@query("running_fold_mean", """WITH f AS (SELECT l_returnflag AS run, l_linenumber AS fold, avg(CASE WHEN l_returnflag <> 'A' OR l_linenumber > 1 THEN l_discount END) AS m FROM lineitem GROUP BY 1, 2),
r AS (SELECT run, fold, round(avg(m) OVER (PARTITION BY run ORDER BY fold ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM f)
SELECT * FROM r WHERE running_mean IS NOT NULL""")
def _(read):
    value = F.when((F.col("l_returnflag") != "A") | (F.col("l_linenumber") > 1), F.col("l_discount"))
    folds = read("lineitem").groupBy(F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("fold")).agg(F.avg(value).alias("m"))
    return T.running_fold_mean(folds, ["run"], "fold", "m")


@query("trial_times", """WITH t AS (SELECT user_id AS number, min(ts) AS a, max(CASE WHEN event_type = 'purchase' THEN ts END) AS b FROM events GROUP BY 1)
SELECT number, strftime(a, '%Y-%m-%dT%H:%M:%S.%f') AS datetime_start, strftime(b, '%Y-%m-%dT%H:%M:%S.%f') AS datetime_complete, date_diff('microsecond', a, b) / 1e6 AS duration_seconds, strftime(a, '%Y%m%d-%H%M%S') AS stamp FROM t""")
def _(read):
    done = F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))
    return T.trial_times(read("events").groupBy(F.col("user_id").alias("number")).agg(F.min("ts").alias("a"), done.alias("b")), "a", "b")


@query("small_classes", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) < 60")
def _(read):
    return S.small_classes(read("customer"), "c_nationkey", 60)


@query("classes_by_superclass", "SELECT c_nationkey, min(n_regionkey) AS n_regionkey, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def _(read):
    rows = read("customer").join(read("nation").select("n_nationkey", "n_regionkey"), F.col("n_nationkey") == F.col("c_nationkey"))
    return S.classes_by_superclass(rows, "c_nationkey", "n_regionkey")


@query("inverse_mapping", """WITH m AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS mapped FROM (SELECT DISTINCT label FROM embeddings WHERE label <> 3))
SELECT vec_id, pred, m.label FROM (SELECT vec_id, vec_id % (SELECT count(*) FROM m) AS pred FROM embeddings) JOIN m ON mapped = pred""")
def _(read):
    e = read("embeddings")
    mapper = S.dense_relabel(e.where("label <> 3"), "vec_id", "label").select("label", "mapped").distinct()
    preds = e.select("vec_id", (F.col("vec_id") % mapper.count()).alias("pred"))
    return S.inverse_mapped(preds, mapper, "pred", "label")


@query("class_shares", """WITH s AS (SELECT l_suppkey AS node, l_returnflag AS class, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)
SELECT node, class, round(score / sum(score) OVER (PARTITION BY node), 6) AS share FROM s""")
def _(read):
    scores = read("lineitem").groupBy(F.col("l_suppkey").alias("node"), F.col("l_returnflag").alias("class")).agg(F.sum("l_quantity").alias("score"))
    return P.class_shares(scores).withColumn("share", F.round("share", 6))


@query("l1_normalised", """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, list_sum([abs(x) for x in v]) AS n FROM v)
SELECT vec_id, round(v[1] / n, 6) AS head, round(v[len(v)] / n, 6) AS tail, round(list_sum([abs(x / n) for x in v]), 6) AS mass FROM n""")
def _(read):
    v = read("embeddings").select("vec_id", X.l1_unit(X.doubles("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.col("v")[0], 6).alias("head"), F.round(F.element_at("v", -1), 6).alias("tail"), F.round(X.total(F.transform("v", F.abs)), 6).alias("mass"))


@query("k_shot_choices", """WITH k AS (SELECT min(n) AS k FROM (SELECT least(count(*), 5) AS n FROM customer GROUP BY c_nationkey)), c AS (SELECT DISTINCT c_nationkey * 4 + m AS batch, m FROM customer, (SELECT unnest([2, 3, 4, 6, 8]) AS m))
SELECT concat(batch, ':', m) AS choice, CAST(batch AS BIGINT) AS batch, CAST(m AS BIGINT) AS m FROM c WHERE m <= (SELECT k FROM k)""")
def _(read):
    """The label budget of up to five rows a class decides which shots a class can give."""
    from ..operators.sampling import per_class_min

    c = read("customer")
    budget = per_class_min(c.select(F.col("c_custkey").alias("s"), F.col("c_nationkey").alias("l")), "s", "l", 7, k=5).where("pool = 'labeled'")
    k = budget.groupBy("l").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    m = F.explode(F.array(*[F.lit(x).cast("long") for x in (2, 3, 4, 6, 8)]))
    choices = c.select("c_nationkey").distinct().select("c_nationkey", m.alias("m")).select((F.col("c_nationkey") * 4 + F.col("m")).cast("long").alias("batch"), "m")
    return B.k_shot_choices(choices.distinct().select(F.concat_ws(":", "batch", "m").alias("choice"), "batch", "m"), k)


@query("manifest_summary", """WITH c AS (SELECT o_orderstatus AS split, o_orderpriority AS l, count(*) AS n, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders GROUP BY 1, 2)
SELECT split, CAST(sum(n) AS BIGINT) AS n, min(a) AS first_id, max(b) AS last_id, '{' || string_agg('"' || l || '":' || n, ',' ORDER BY l) || '}' AS label_counts FROM c GROUP BY 1""")
def _(read):
    return sinks.manifest_summary(read("orders").withColumnRenamed("o_orderstatus", "split"), "split", "o_orderkey", "o_orderpriority")
