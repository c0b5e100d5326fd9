"""Queries over label budgets, holdouts and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds as D
from ..operators import sampling as A
from ..operators import splits as S
from ..operators import views as V
from .registry import query

SEED = 7
_T = f"""t AS (SELECT c_custkey AS s, c_nationkey AS l FROM customer),
r AS (SELECT s, l, row_number() OVER (PARTITION BY l ORDER BY md5(concat('{SEED}:', CAST(s AS VARCHAR))), s) AS class_rank, count(*) OVER (PARTITION BY l) AS class_size FROM t),
o AS (SELECT l, row_number() OVER (ORDER BY md5(concat('{SEED}:class:', CAST(l AS VARCHAR))), l) AS class_no, count(*) OVER () AS classes FROM (SELECT DISTINCT l FROM t))"""
_POOL = "CASE WHEN {} THEN 'labeled' ELSE 'unlabeled' END AS pool"


def _rows(read):
    return read("customer").select(F.col("c_custkey").alias("s"), F.col("c_nationkey").alias("l"))


@query("budget_per_class_min", f"WITH {_T} SELECT s, l, {_POOL.format('class_rank <= greatest(1, round_even(class_size * CAST(0.1 AS DOUBLE), 0))')} FROM r")
def _(read):
    return A.per_class_min(_rows(read), "s", "l", SEED, fraction=0.1)


@query("budget_per_class_k", f"WITH {_T} SELECT s, l, {_POOL.format('class_rank <= least(5, class_size)')} FROM r")
def _(read):
    return A.per_class_min(_rows(read), "s", "l", SEED, k=5)


@query("budget_global", f"""WITH {_T}, g AS (SELECT s, row_number() OVER (ORDER BY class_rank, md5(concat('{SEED}:', CAST(class_rank AS VARCHAR), ':class:', CAST(l AS VARCHAR))), l) AS n FROM r)
SELECT s, l, {_POOL.format('n <= greatest(1, floor((SELECT count(*) FROM t) * CAST(0.05 AS DOUBLE)))')} FROM r JOIN g USING (s)""")
def _(read):
    return A.global_budget(_rows(read), "s", "l", SEED, 0.05)


@query("budget_class_subset", f"WITH {_T} SELECT s, l, {_POOL.format('class_no <= greatest(1, floor(classes * CAST(0.3 AS DOUBLE)))')} FROM t JOIN o USING (l)")
def _(read):
    return A.class_subset(_rows(read), "s", "l", SEED, 0.3)


@query("budget_class_subset_k_shot", f"WITH {_T} SELECT s, l, {_POOL.format('class_no <= greatest(1, floor(classes * CAST(0.3 AS DOUBLE))) AND class_rank <= 4')} FROM r JOIN o USING (l)")
def _(read):
    return A.class_subset_k_shot(_rows(read), "s", "l", SEED, 0.3, 4)


_IMB = f"""{_T}, i0 AS (SELECT DISTINCT l, class_size AS available, CAST(greatest(1, round_even(class_size * CAST(0.1 AS DOUBLE), 0)) AS BIGINT) AS b, CAST('0x' || substr(md5(concat('{SEED}:weight:', CAST(l AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM r),
i1 AS (SELECT *, greatest(1, b // 2) AS low, CAST(least(available, 2 * b) - greatest(1, b // 2) AS DOUBLE) AS room, b * (0.25 + CAST(1.75 AS DOUBLE) * u) AS w FROM i0),
i2 AS (SELECT *, CAST(sum(b - low) OVER () AS DOUBLE) AS extra, coalesce(sum(room) OVER (ORDER BY room / w, l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (ORDER BY room / w, l ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM i1),
i3 AS (SELECT *, max(CASE WHEN before + room / w * open >= extra THEN (extra - before) / open END) OVER () AS level FROM i2),
i4 AS (SELECT *, floor(sum(least(room, coalesce(level * w, room))) OVER (ORDER BY l) + 1e-6) AS upto FROM i3),
i5 AS (SELECT l, available, CAST(low + upto - coalesce(lag(upto) OVER (ORDER BY l), 0) AS BIGINT) AS take FROM i4)"""


@query("imbalanced_counts", f"WITH {_IMB} SELECT * FROM i5")
def _(read):
    return A.imbalanced_counts(_rows(read), "l", SEED, 0.1)


@query("budget_imbalanced", f"WITH {_IMB} SELECT s, l, {_POOL.format('class_rank <= take')} FROM r JOIN i5 USING (l)")
def _(read):
    return A.per_class_imbalanced(_rows(read), "s", "l", SEED, 0.1)


@query("unlabeled_cap", f"""WITH {_T}, p AS (SELECT s, l, {_POOL.format('class_rank <= 5')} FROM r),
c AS (SELECT s, row_number() OVER (ORDER BY md5(concat('{SEED}:cap:', CAST(s AS VARCHAR))), s) AS n FROM p WHERE pool = 'unlabeled')
SELECT s, l, CASE WHEN pool = 'unlabeled' AND n > 200 THEN 'unused' ELSE pool END AS pool FROM p LEFT JOIN c USING (s)""")
def _(read):
    return A.unlabeled_cap(A.per_class_min(_rows(read), "s", "l", SEED, k=5), "s", SEED, 200)


_TAIL = f"""{_T}, lt AS (SELECT l, class_size AS available, row_number() OVER (ORDER BY l) - 1 AS i, count(*) OVER () AS c, max(class_size) OVER () AS m FROM (SELECT DISTINCT l, class_size FROM r)),
tt AS (SELECT l, available, least(available, CAST(floor(m * pow(CAST(0.1 AS DOUBLE), i / (c - 1)) + 1e-9) AS BIGINT)) AS target FROM lt)"""


@query("long_tail_counts", f"WITH {_TAIL} SELECT * FROM tt")
def _(read):
    return A.long_tail_counts(_rows(read), "l", 0.1)


@query("long_tail_sample", f"WITH {_TAIL} SELECT s, l FROM r JOIN tt USING (l) WHERE class_rank <= target")
def _(read):
    return A.long_tail_sample(_rows(read), "s", "l", SEED, 0.1)


@query("balanced_fraction", f"""WITH {_T}, m AS (SELECT min(class_size) AS n FROM r)
SELECT s, l, CASE WHEN class_rank <= floor(n * CAST(0.5 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM r, m WHERE class_rank <= floor(n * CAST(0.5 AS DOUBLE)) + floor(n * CAST(0.25 AS DOUBLE))""")
def _(read):
    return A.balanced_fraction(_rows(read), "s", "l", SEED, 0.5, 0.25)


@query("match_train_valid", f"""WITH {_T}, x AS (SELECT r.*, class_no FROM r JOIN o USING (l) WHERE class_size >= 2 AND class_no <= 8)
SELECT s, l FROM x ORDER BY class_rank, class_no LIMIT 50""")
def _(read):
    return A.match_train(_rows(read), "s", "l", SEED, 50, 8)


@query("uniform_sample", f"SELECT c_custkey AS s FROM customer ORDER BY md5(concat('{SEED}:', CAST(c_custkey AS VARCHAR))), c_custkey LIMIT 40")
def _(read):
    return A.uniform_sample(_rows(read), "s", SEED, 40).select("s")


@query("holdout_by_class", f"WITH {_T} SELECT s, l, CASE WHEN class_no <= floor(classes * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'valid' END AS part FROM t JOIN o USING (l)")
def _(read):
    return S.holdout_by_class(_rows(read), "s", "l", SEED)


@query("holdout_superclass_balanced", f"""WITH {_T}, x AS (SELECT o.*, n_regionkey AS g, row_number() OVER (PARTITION BY n_regionkey ORDER BY class_no) AS i, count(*) OVER (PARTITION BY n_regionkey) AS z FROM o JOIN nation ON n_nationkey = l),
v AS (SELECT l FROM x WHERE i <= z - 1 QUALIFY row_number() OVER (ORDER BY class_no) <= classes - floor(classes * CAST(0.8 AS DOUBLE)))
SELECT s, t.l, n_regionkey AS g, CASE WHEN v.l IS NULL THEN 'train' ELSE 'valid' END AS part FROM t JOIN nation ON n_nationkey = t.l LEFT JOIN v ON v.l = t.l""")
def _(read):
    g = _rows(read).join(F.broadcast(read("nation").select(F.col("n_nationkey").alias("l"), F.col("n_regionkey").alias("g"))), "l")
    return S.holdout_superclass_balanced(g, "s", "l", "g", SEED)


@query("post_apportion_holdout", f"""WITH {_T}, p AS (SELECT s, l, {_POOL.format('class_rank <= 5')} FROM r), h AS (SELECT l FROM o WHERE class_no > least(greatest(floor(classes * CAST(0.8 AS DOUBLE)), 1), classes - 1))
SELECT s, p.l, CASE WHEN h.l IS NULL THEN pool WHEN pool = 'labeled' THEN 'valid' ELSE 'excluded' END AS part FROM p LEFT JOIN h ON h.l = p.l""")
def _(read):
    return S.post_apportion(A.per_class_min(_rows(read), "s", "l", SEED, k=5), "s", "l", SEED)


@query("kfold", f"""WITH {_T}, x AS (SELECT s, row_number() OVER (ORDER BY md5(concat('{SEED}:', CAST(s AS VARCHAR))), s) - 1 AS i, count(*) OVER () AS n FROM t)
SELECT s, CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS BIGINT) AS fold FROM x""")
def _(read):
    return S.kfold(_rows(read), "s", SEED, 7)


#: Segments as classes: stratified folds need a row of every class for each fold, at every size of the table.
_SK = f"t AS (SELECT c_custkey AS s, c_mktsegment AS l FROM customer), f AS (SELECT s, l, (row_number() OVER (PARTITION BY l ORDER BY md5(concat('{SEED}:', CAST(s AS VARCHAR))), s) - 1) % 5 AS fold FROM t)"


def _segments(read):
    return read("customer").select(F.col("c_custkey").alias("s"), F.col("c_mktsegment").alias("l"))


@query("stratified_kfold", f"WITH {_SK} SELECT * FROM f")
def _(read):
    return S.stratified_kfold(_segments(read), "s", "l", SEED, 5)


@query("group_kfold", f"""WITH RECURSIVE {_T}, g AS (SELECT l, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, l) AS i FROM t GROUP BY l),
w AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS l, CAST(NULL AS BIGINT) AS fold, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load
UNION ALL SELECT g.i, g.l, list_position(load, list_min(load)) - 1, list_transform(load, lambda x, k: CASE WHEN k = list_position(load, list_min(load)) THEN x + g.n ELSE x END) FROM w JOIN g ON g.i = w.i + 1)
SELECT s, t.l, fold FROM t JOIN w ON w.l = t.l""")
def _(read):
    return S.group_kfold(_rows(read), "s", "l", 5)


@query("superclass_group_kfold", f"""WITH RECURSIVE {_T}, c AS (SELECT l, n_regionkey AS g, count(*) AS n FROM t JOIN nation ON n_nationkey = l GROUP BY 1, 2),
x AS (SELECT *, count(*) OVER (PARTITION BY g) - 1 AS most, count(*) OVER () AS c, row_number() OVER (ORDER BY n DESC, md5(concat('{SEED}:', CAST(l AS VARCHAR))), l) AS i FROM c),
w AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS l, NULL::BIGINT AS fold, [0, 0, 0]::BIGINT[] AS rows, []::BIGINT[][] AS had
UNION ALL SELECT i, l, best[3], list_transform(rows, lambda r, f: CASE WHEN f - 1 = best[3] THEN r + n ELSE r END), list_append(had, [best[3], g]) FROM (
  SELECT x.*, rows, had, list_min(list_filter([[rows[f + 1], len(list_filter(had, lambda y: y[1] = f)), f, len(list_filter(had, lambda y: y[1] = f AND y[2] = g))] FOR f IN [0, 1, 2]],
    lambda z: z[2] < c // 3 + CASE WHEN z[3] < c % 3 THEN 1 ELSE 0 END AND z[4] < most)) AS best FROM w JOIN x ON x.i = w.i + 1))
SELECT s, t.l, g, fold FROM t JOIN w ON w.l = t.l JOIN c ON c.l = t.l""")
def _(read):
    g = _rows(read).join(read("nation").select(F.col("n_nationkey").alias("l"), F.col("n_regionkey").alias("g")), "l")
    return D.superclass_group_folds(g, "s", "l", "g", SEED, 3)


@query("cv_leakage_exclusion", f"""WITH {_T}, p AS (SELECT s, l, {_POOL.format('class_rank <= 5')} FROM r), f AS (SELECT s, l, class_no % 3 AS fold FROM p JOIN o USING (l) WHERE pool = 'labeled')
SELECT x.fold, p.s, p.l, p.pool FROM p, (SELECT DISTINCT fold FROM f) x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.fold = x.fold AND f.s = p.s) AND NOT EXISTS (SELECT 1 FROM f WHERE f.fold = x.fold AND f.l = p.l)""")
def _(read):
    tagged = A.per_class_min(_rows(read), "s", "l", SEED, k=5)
    order = A.class_order(_rows(read), "l", SEED)
    folds = tagged.where("pool = 'labeled'").join(F.broadcast(order), "l").select("s", "l", (F.col("class_no") % 3).alias("fold"))
    return S.leakage_excluded(tagged, folds, "s", "l", grouped=True)


@query("fold_label_sets", f"WITH {_T}, f AS (SELECT s, l, (class_rank - 1) % 5 AS fold FROM r) SELECT x.fold, count(DISTINCT l) AS classes, count(*) AS rows FROM f, (SELECT DISTINCT fold FROM f) x WHERE f.fold <> x.fold GROUP BY 1")
def _(read):
    f = S.class_dealt(_rows(read), "s", "l", SEED, 5)  # small tables have classes of fewer rows than folds
    per = f.groupBy("fold", "l").agg(F.count(F.lit(1)).alias("n"))
    folds = F.broadcast(f.select(F.col("fold").alias("held")).distinct())
    return per.join(folds, F.col("fold") != F.col("held")).groupBy(F.col("held").alias("fold")).agg(F.count_distinct("l").alias("classes"), F.sum("n").alias("rows"))


@query("sampler_capacity", "SELECT m, b, m * (SELECT count(DISTINCT label) FROM embeddings) >= b AS fits FROM (SELECT CAST(unnest([2, 4, 8]) AS BIGINT) AS m), (SELECT CAST(unnest([16, 32, 64]) AS BIGINT) AS b)")
def _(read):
    e = read("embeddings")
    n = e.agg(F.count_distinct("label").alias("c"))
    one = lambda name, xs: F.explode(F.array(*[F.lit(x).cast("long") for x in xs])).alias(name)
    return n.select("c", one("m", [2, 4, 8])).select("c", "m", one("b", [16, 32, 64])).select("m", "b", (F.col("m") * F.col("c") >= F.col("b")).alias("fits"))


@query("m_per_class_batches")
def _(read):
    return V.ring_batches(_rows(read), "s", "l", SEED, 10, 4, 8)


@query("budget_selection_records", """
WITH b AS (SELECT CAST(unnest([3, 5]) AS BIGINT) AS k), z AS (SELECT CAST(unnest([1, 2]) AS BIGINT) AS seed), c AS (SELECT DISTINCT c_nationkey AS l FROM customer),
x AS (SELECT k, seed, l, row_number() OVER (PARTITION BY k, seed ORDER BY md5(concat(CAST(seed AS VARCHAR), ':class:', CAST(l AS VARCHAR))), l) AS n FROM b, z, c)
SELECT k, seed, string_agg(CAST(l AS VARCHAR), ';' ORDER BY l) AS classes FROM x WHERE n <= k GROUP BY 1, 2
""")
def _(read):
    c = _rows(read).select("l").distinct()
    out = None
    for seed in (1, 2):
        ranked = A.class_order(c, "l", seed).withColumn("seed", F.lit(seed).cast("long")).withColumn("k", F.explode(F.array(F.lit(3).cast("long"), F.lit(5).cast("long")))).where("class_no <= k")
        out = ranked if out is None else out.unionByName(ranked)
    return out.groupBy("k", "seed").agg(F.array_join(F.array_sort(F.collect_list("l")).cast("array<string>"), ";").alias("classes"))
