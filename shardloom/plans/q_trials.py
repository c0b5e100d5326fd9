"""Queries over trials, grids, folds, epochs and metric logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import trials as T
from .registry import query

_ORD = "SELECT o_orderkey AS number, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'PRUNED' ELSE 'FAIL' END AS state, o_totalprice AS value, o_orderpriority AS study, o_custkey AS seed FROM orders"


def _trials(read):
    state = F.when(F.col("o_orderstatus") == "F", "COMPLETE").when(F.col("o_orderstatus") == "O", "PRUNED").otherwise("FAIL")
    return read("orders").select(F.col("o_orderkey").alias("number"), state.alias("state"), F.col("o_totalprice").alias("value"), F.col("o_orderpriority").alias("study"), F.col("o_custkey").alias("seed"))


@query("best_trial", f"WITH t AS ({_ORD}) SELECT number, value, CAST(1 AS BIGINT) AS rank FROM t WHERE state = 'COMPLETE' ORDER BY value DESC, number LIMIT 1")
def _(read):
    return T.top_trials(T.completed(_trials(read)), 1).select("number", "value", "rank")


@query("top_n_trials", f"WITH t AS ({_ORD}) SELECT number, value, row_number() OVER (ORDER BY value, number) AS rank FROM t WHERE state = 'COMPLETE' ORDER BY value, number LIMIT 20")
def _(read):
    return T.top_trials(T.completed(_trials(read)), 20, maximise=False).select("number", "value", "rank")


@query("ranked_trials", f"WITH t AS ({_ORD}) SELECT number, study, value, row_number() OVER (PARTITION BY study ORDER BY value DESC, number) AS rank FROM t WHERE state = 'COMPLETE'")
def _(read):
    from pyspark.sql import Window

    w = Window.partitionBy("study").orderBy(F.desc("value"), "number")
    return T.completed(_trials(read)).select("number", "study", "value", F.row_number().over(w).cast("long").alias("rank"))


@query("trial_budget", f"WITH t AS ({_ORD}) SELECT count(*) FILTER (WHERE state IN ('COMPLETE', 'PRUNED')) AS budget, count(*) FILTER (WHERE state IN ('PRUNED', 'FAIL')) AS retryable FROM t")
def _(read):
    return T.budget(_trials(read))


@query("retryable_trials", f"WITH t AS ({_ORD}) SELECT number, state FROM t WHERE state IN ('PRUNED', 'FAIL')")
def _(read):
    return _trials(read).where(F.col("state").isin("PRUNED", "FAIL")).select("number", "state")


def _props(read):
    return read("events").select("event_id", F.from_json("props", "map<string,string>").alias("params"))


@query("delete_trials_antijoin", "WITH d AS (SELECT o_orderkey FROM orders WHERE o_orderkey > (SELECT quantile_disc(o_orderkey, 0.5) FROM orders)) SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM d)")
def _(read):
    o = read("orders").select(F.col("o_orderkey").alias("l_orderkey"))
    keep = o.agg(F.percentile_disc(0.5, "l_orderkey") if hasattr(F, "percentile_disc") else F.expr("percentile_disc(0.5) within group (order by l_orderkey)")).first()[0]
    return T.delete_trials({"l": read("lineitem")}, o, "l_orderkey", int(keep))["l"].select("l_orderkey", "l_linenumber")


_L = "SELECT l_returnflag AS method, l_linestatus AS status, l_linenumber AS seed, l_discount AS m1, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_tax END AS m2 FROM lineitem"


def _runs(read):
    return read("lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("seed"), F.col("l_discount").alias("m1"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_tax")).alias("m2"))


@query("grid_aggregate", f"WITH r AS ({_L}) SELECT method, status, count(DISTINCT seed) AS num_seeds, round(avg(m1), 6) AS m1_mean, round(coalesce(stddev_samp(m1), 0), 6) AS m1_std, round(avg(m2), 6) AS m2_mean, round(CASE WHEN count(m2) = 1 THEN 0.0 ELSE stddev_samp(m2) END, 6) AS m2_std FROM r GROUP BY 1, 2")
def _(read):
    return T.grid_aggregate(_runs(read), ["method", "status"], "seed", ["m1", "m2"])


@query("paired_deltas", f"""WITH r AS ({_L}), g AS (SELECT method, seed, avg(m1) AS m1, avg(m2) AS m2 FROM r GROUP BY 1, 2)
SELECT a.seed, round(a.m1, 6) AS m1_base, round(b.m1, 6) AS m1_other, round(b.m1 - a.m1, 6) AS m1_delta, round(a.m2, 6) AS m2_base, round(b.m2, 6) AS m2_other, round(b.m2 - a.m2, 6) AS m2_delta FROM g a JOIN g b USING (seed) WHERE a.method = 'A' AND b.method = 'R'""")
def _(read):
    g = _runs(read).groupBy("method", "seed").agg(F.avg("m1").alias("m1"), F.avg("m2").alias("m2"))
    return T.paired_deltas(g, ["seed"], "method", "A", "R", ["m1", "m2"])


@query("cv_summary_rollup", """
SELECT l_returnflag AS run, coalesce(l_linenumber, -1) AS fold, round(avg(l_discount), 6) AS m, CAST(max(l_suppkey) AS BIGINT) AS last_epoch, CAST(sum(l_partkey) AS BIGINT) AS total_steps, CAST(round_even(avg(l_suppkey), 0) AS BIGINT) AS selected_epoch
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linenumber), (l_returnflag))
""")
def _(read):
    f = read("lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("fold"), F.col("l_discount").alias("m"), F.col("l_suppkey").alias("epoch"), F.col("l_partkey").alias("steps"))
    return T.cv_summary(f, ["run"], "fold", ["m"], "epoch", "steps").withColumn("fold", F.coalesce("fold", F.lit(-1)))


@query("epoch_plan", """
WITH t AS (SELECT o_custkey AS trial, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 13 END AS sel, o_orderkey % 17 AS lst FROM orders),
g AS (SELECT trial, CASE WHEN count(*) = count(sel) THEN avg(greatest(sel + 1, 0)) ELSE avg(greatest(lst + 1, 0)) END AS m FROM t GROUP BY 1) SELECT trial, round(m, 6) AS mean_epochs, CAST(floor(m + 0.5) AS BIGINT) AS final_epochs FROM g
""")
def _(read):
    o = F.col("o_orderkey")
    t = read("orders").select(F.col("o_custkey").alias("trial"), F.when(o % 9 != 0, o % 13).alias("sel"), (o % 17).alias("lst"))
    return T.epoch_plan(t, "trial", "sel", "lst")


@query("cross_seed_winner", f"""WITH t AS ({_ORD}), m AS (SELECT study, number % 40 AS trial, avg(value) AS m, count(DISTINCT seed) AS seeds FROM t GROUP BY 1, 2 HAVING count(DISTINCT seed) >= 2)
SELECT study, trial, round(m, 2) AS mean_value, seeds FROM m QUALIFY row_number() OVER (PARTITION BY study ORDER BY round(m, 9) DESC, trial) = 1""")
def _(read):
    t = _trials(read).withColumn("trial", F.col("number") % 40)
    return T.cross_seed_winner(t, ["study"], "trial", "seed", "value").withColumn("mean_value", F.round("mean_value", 2))


@query("scenario_groups", f"WITH t AS ({_ORD}) SELECT study, state, count(DISTINCT seed % 7) AS seeds FROM t GROUP BY 1, 2 HAVING count(DISTINCT seed % 7) >= 2")
def _(read):
    return _trials(read).groupBy("study", "state").agg(F.count_distinct(F.col("seed") % 7).alias("seeds")).where("seeds >= 2")


_EV = "SELECT user_id AS run, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 2 AS epoch FROM events"


def _log(read):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read("events").select(F.col("user_id").alias("run"), "event_id", "value", (F.row_number().over(w) - 2).cast("long").alias("epoch"))


@query("early_stopping", f"""WITH e AS ({_EV}), a AS (SELECT *, max(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
b AS (SELECT *, CAST(before IS NULL OR value > before AS INTEGER) AS up FROM a), c AS (SELECT *, sum(up) OVER (PARTITION BY run ORDER BY epoch) AS isl FROM b),
d AS (SELECT *, sum(CASE WHEN up = 0 AND epoch >= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run, isl ORDER BY epoch) AS wait FROM c), s AS (SELECT run, min(epoch) FILTER (WHERE wait >= 3) AS stop_epoch FROM d GROUP BY 1)
SELECT run, stop_epoch, max(epoch) AS selected_epoch, round(arg_max(value, epoch), 6) AS best_value FROM d JOIN s USING (run) WHERE up = 1 AND (stop_epoch IS NULL OR epoch <= stop_epoch) GROUP BY 1, 2""")
def _(read):
    return T.early_stopping(_log(read), "run", "epoch", "value", 3)


@query("running_best", f"WITH e AS ({_EV}) SELECT run, epoch, round(max(value) OVER w, 6) AS best, round(avg(value) OVER w, 9) AS mean_so_far FROM e WINDOW w AS (PARTITION BY run ORDER BY epoch)")
def _(read):
    return T.running_best(_log(read), "run", "epoch", "value").withColumn("mean_so_far", F.round("mean_so_far", 9))


@query("lr_summary", f"WITH e AS ({_EV}) SELECT run, round(arg_min(value, epoch), 6) AS start, round(avg(value), 6) AS mean, round(min(value), 6) AS min, round(max(value), 6) AS max, round(arg_max(value, epoch), 6) AS end FROM e GROUP BY run")
def _(read):
    return T.edge_values(_log(read), "run", "epoch", "value")


@query("ring_buffer", f"WITH e AS ({_EV}) SELECT run, epoch, value FROM e QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) <= 4")
def _(read):
    return T.ring_buffer(_log(read), ["run"], ["epoch"], 4).select("run", "epoch", "value")


@query("labeled_bank_upsert", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def _(read):
    return T.last_write(read("events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("ema_fold", f"WITH RECURSIVE e AS ({_EV}), r AS (SELECT run, epoch, value AS m FROM e WHERE epoch = -1 UNION ALL SELECT e.run, e.epoch, 0.9 * r.m + 0.1 * e.value FROM r JOIN e ON e.run = r.run AND e.epoch = r.epoch + 1) SELECT run, round(m, 6) AS ema FROM r QUALIFY row_number() OVER (PARTITION BY run ORDER BY epoch DESC) = 1")
def _(read):
    return T.ema(_log(read), "run", ["epoch"], "value", 0.9)


@query("windowed_metrics", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max FROM events GROUP BY 1, 2")
def _(read):
    from ..streaming.metrics import windowed

    return windowed(read("events"), "ts", "event_type", "value")


@query("scenario_grid", "SELECT *, 'flag-' || flag || '_status-' || status || '_seed-' || CAST(seed AS VARCHAR) AS scenario FROM (SELECT DISTINCT l_returnflag AS flag FROM lineitem), (SELECT DISTINCT l_linestatus AS status FROM lineitem), (SELECT DISTINCT l_linenumber AS seed FROM lineitem)")
def _(read):
    l = read("lineitem")  # noqa: E741
    pick = lambda c, n: l.select(F.col(c).alias(n)).distinct()
    return T.scenario_grid({"flag": pick("l_returnflag", "flag"), "status": pick("l_linestatus", "status"), "seed": pick("l_linenumber", "seed")})


@query("two_stream_combos", "SELECT b AS batch, l AS labeled, m FROM (SELECT CAST(unnest([16, 32, 64, 128, 256, 512]) AS BIGINT) AS b), (SELECT CAST(unnest([8, 16, 32, 64]) AS BIGINT) AS l), (SELECT CAST(unnest([2, 4]) AS BIGINT) AS m) WHERE l < b AND (b - l) % m = 0 AND l % m = 0 AND (b - l) // m <= (SELECT count(*) FROM nation)")
def _(read):
    n = read("nation")
    one = lambda name, xs: F.explode(F.array(*[F.lit(x).cast("long") for x in xs])).alias(name)
    grid = n.limit(1).select(one("batch", [16, 32, 64, 128, 256, 512])).select("batch", one("labeled", [8, 16, 32, 64])).select("batch", "labeled", one("m", [2, 4]))
    c = n.agg(F.count(F.lit(1)).alias("c"))
    rest = F.col("batch") - F.col("labeled")
    return grid.crossJoin(c).where((F.col("labeled") < F.col("batch")) & (rest % F.col("m") == 0) & (F.col("labeled") % F.col("m") == 0) & (F.floor(rest / F.col("m")) <= F.col("c"))).drop("c")


@query("lr_schedules", """WITH e AS (SELECT DISTINCT p_size AS epoch FROM part) SELECT epoch, round(0.1 * pow(0.5, floor(epoch / 10)), 9) AS step, round((1 + cos(pi() * least(epoch, 30) / 30)) / 20, 9) AS cosine, round((1 + cos(pi() * (epoch % 8) / 8)) / 20, 9) AS restarts, epoch >= 4 AND (epoch - 4) % 3 = 0 AS rebuild FROM e""")
def _(read):
    e = read("part").select(F.col("p_size").alias("epoch")).distinct()
    r = lambda c: F.round(c, 9)
    x = F.col("epoch")
    return e.select("epoch", r(T.schedule("step", x, 0.1, 10, 0.5)).alias("step"), r(T.schedule("cosine", x, 0.1, 30)).alias("cosine"), r(T.schedule("restarts", x, 0.1, 8)).alias("restarts"), T.rebuild_due(x, 4, 3).alias("rebuild"))


@query("epoch_lengths", "SELECT DISTINCT p_size AS n, CAST((p_size + 15) // 16 * 16 AS BIGINT) AS rounded_up, CAST(p_size // 16 * 16 AS BIGINT) AS rounded_down FROM part")
def _(read):
    n = F.col("n")
    return read("part").select(F.col("p_size").alias("n")).distinct().select("n", (F.ceil(n / 16) * 16).cast("long").alias("rounded_up"), (F.floor(n / 16) * 16).cast("long").alias("rounded_down"))


@query("paired_streams", "SELECT n_nationkey AS batch_a, n_nationkey % 5 AS batch_b FROM nation")
def _(read):
    from ..operators.views import paired_streams

    return paired_streams(read("nation").select(F.col("n_nationkey").alias("b")), read("region").select(F.col("r_regionkey").alias("b")), "b")


@query("cross_seed_evidence", f"WITH t AS ({_ORD}) SELECT study, '[' || string_agg(CAST(number AS VARCHAR), ',' ORDER BY seed, number) || ']' AS trials, count(*) AS n FROM t GROUP BY 1")
def _(read):
    g = _trials(read).groupBy("study").agg(F.array_sort(F.collect_list(F.struct("seed", "number"))).alias("s"), F.count(F.lit(1)).alias("n"))
    return g.select("study", F.to_json(F.transform("s", lambda x: x["number"])).alias("trials"), "n")


@query("params_wide", "SELECT event_id, json_extract_string(props, '$.' || 'k') AS param_k FROM events")
def _(read):
    return T.trials_wide(_props(read), "event_id", "params", ["k"])


@query("loss_miner_pairs", "SELECT DISTINCT split_part(p_type, ' ', 1) AS loss, split_part(p_type, ' ', 2) AS miner FROM part")
def _(read):
    s = F.split("p_type", " ")
    return read("part").select(F.get(s, F.lit(0)).alias("loss"), F.coalesce(F.get(s, F.lit(1)), F.lit("")).alias("miner")).distinct()


@query("config_overlay", "SELECT n_nationkey, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'override' ELSE 'base' END AS mode FROM nation")
def _(read):
    n = read("nation")
    base = F.create_map(F.lit("name"), F.col("n_name"), F.lit("mode"), F.lit("base"))
    over = F.when(F.col("n_nationkey") % 2 == 0, F.create_map(F.lit("mode"), F.lit("override"))).otherwise(F.create_map().cast("map<string,string>"))
    both = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k)), over)
    return n.select("n_nationkey", both["name"].alias("name"), both["mode"].alias("mode"))
