"""Trials, grids, folds, epochs: experiment-log analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def completed(trials: DataFrame, state: str = "state", value: str = "value", done: str = "COMPLETE") -> DataFrame:
    return trials.where((F.col(state) == done) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def top_trials(trials: DataFrame, n: int, number: str = "number", value: str = "value", maximise: bool = True) -> DataFrame:
    """The best ``n`` with their rank, ties to the lowest number (a top-n sort, no global window over all rows)."""
    best = trials.orderBy((F.desc if maximise else F.asc)(value), number).limit(n)
    w = Window.orderBy((F.desc if maximise else F.asc)(value), number)
    return best.withColumn("rank", F.row_number().over(w).cast("long"))


def trials_wide(trials: DataFrame, number: str, params: str, names: list[str]) -> DataFrame:
    """Parameters of a map column as columns ``param_<name>``."""
    return trials.select(*[c for c in trials.columns if c != params], *[F.try_element_at(params, F.lit(n)).alias(f"param_{n}") for n in names])


def mentions(trials: DataFrame, params: str, name: str) -> DataFrame:
    return trials.where(F.map_contains_key(params, name))


def budget(trials: DataFrame, state: str = "state") -> DataFrame:
    """Trials that count towards a budget, and those that may be run again."""
    s = F.col(state)
    return trials.agg(F.count_if(s.isin("COMPLETE", "PRUNED")).alias("budget"), F.count_if(s.isin("PRUNED", "FAIL")).alias("retryable"))


def delete_trials(tables: dict[str, DataFrame], trials: DataFrame, number: str, keep: int) -> dict[str, DataFrame]:
    """Every table without the rows of trials numbered above the ``keep``-th completed one: anti joins, no mutation."""
    gone = trials.where(F.col(number) > keep).select(number)
    return {name: t.join(gone, number, "left_anti") for name, t in tables.items()}


def grid_aggregate(runs: DataFrame, keys: list[str], seed: str, metrics: list[str]) -> DataFrame:
    """Seeds, mean and sample deviation (0 for one value, null for none) per key; nulls are skipped."""
    out = [F.count_distinct(seed).alias("num_seeds")]
    for m in metrics:
        n = F.count(m)
        out += [F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.when(n == 1, F.lit(0.0)).when(n > 1, F.stddev_samp(m)), 6).alias(f"{m}_std")]
    return runs.groupBy(*keys).agg(*out)


def grid_rows(scenarios: DataFrame, studies: DataFrame, results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A summary row per scenario of a grid: its columns, the best trial of its study if it has one, and its run's figures.

    ``studies`` has the keys, best_trial_number, best_hpo_value and what the best trial noted; ``results`` the keys, the
    last epoch (from 0; -1: none) and the run's figures. Where a scenario has both, the run's figures go before the
    trial's; one with neither keeps nulls. ``final_training_epochs`` is the number of epochs trained. Scenarios with
    several studies or runs are errors, as their rows could not be told apart.
    """
    one = lambda df, what: df.groupBy(*keys).agg(*[(F.when(F.count(F.lit(1)) == 1, F.first(c)).otherwise(F.raise_error(F.lit(f"several {what} of a scenario")).cast(t))).alias(f"_{what}_{c}") for c, t in df.dtypes if c not in keys])
    rows = scenarios.join(one(studies, "studies"), keys, "left").join(one(results, "runs"), keys, "left")
    have = {"studies": set(studies.columns), "runs": set(results.columns)}
    pick = lambda m: F.coalesce(*[F.col(f"_{w}_{m}") for w in ("runs", "studies") if m in have[w]]).alias(m)
    epochs = F.greatest(F.lit(0).cast("long"), F.col("_runs_last_epoch") + 1).cast("long")
    last = F.when(F.col("_runs_last_epoch").isNotNull(), epochs).alias("final_training_epochs")
    return rows.select(*scenarios.columns, F.col("_studies_best_trial_number").alias("best_trial_number"), F.col("_studies_best_hpo_value").alias("best_hpo_value"), *[pick(m) for m in metrics], last)


def paired_deltas(runs: DataFrame, keys: list[str], method: str, base: str, other: str, metrics: list[str]) -> DataFrame:
    """Other minus base per key, null if either is; one pass by conditional aggregation."""
    pick = lambda m, v: F.max(F.when(F.col(method) == v, F.col(m)))
    a = runs.where(F.col(method).isin(base, other)).groupBy(*keys).agg(*[c for m in metrics for c in (F.round(pick(m, base), 6).alias(f"{m}_base"), F.round(pick(m, other), 6).alias(f"{m}_other"), F.round(pick(m, other) - pick(m, base), 6).alias(f"{m}_delta"))])
    return a


def cv_summary(folds: DataFrame, keys: list[str], fold: str, metrics: list[str], epoch: str, steps: str) -> DataFrame:
    """Fold rows and a mean row (fold null): mean metrics, last epoch's largest, sum of steps, mean epoch half to even."""
    sets = [[*keys, fold], keys]
    return folds.groupingSets([[F.col(c) for c in s] for s in sets], *keys, fold).agg(
        *[F.round(F.avg(m), 6).alias(m) for m in metrics],
        F.max(epoch).alias("last_epoch"), F.sum(steps).cast("long").alias("total_steps"), F.bround(F.avg(epoch)).cast("long").alias("selected_epoch"),
    )


def running_fold_mean(folds: DataFrame, keys: list[str], fold: str, metric: str) -> DataFrame:
    """Mean of the folds up to each one, nulls skipped; folds before the first value are left out."""
    so_far = Window.partitionBy(*keys).orderBy(fold).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return folds.withColumn("running_mean", F.round(F.avg(metric).over(so_far), 6)).where("running_mean is not null").select(*keys, fold, "running_mean")


def trial_times(trials: DataFrame, start: str, end: str) -> DataFrame:
    """Adds ISO strings of both times, the seconds between them and the start's stamp for a folder; open trials have nulls."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return trials.select(
        *[F.col(c) for c in trials.columns if c not in (start, end)],
        F.date_format(start, iso).alias("datetime_start"), F.date_format(end, iso).alias("datetime_complete"),
        (F.timestamp_diff("MICROSECOND", F.col(start), F.col(end)) / 1e6).alias("duration_seconds"), F.date_format(start, "yyyyMMdd-HHmmss").alias("stamp"),
    )


def epoch_plan(trials: DataFrame, key: str, selected: str, last: str) -> DataFrame:
    """Mean of ``epoch + 1`` (the selected one unless any is null), half up."""
    use = F.when(F.count(F.when(F.col(selected).isNull(), 1)) == 0, F.avg(F.greatest(F.col(selected) + 1, F.lit(0)))).otherwise(F.avg(F.greatest(F.col(last) + 1, F.lit(0))))
    return trials.groupBy(key).agg(F.round(use, 6).alias("mean_epochs"), F.floor(use + 0.5).cast("long").alias("final_epochs"))


def cross_seed_winner(trials: DataFrame, group: list[str], trial: str, seed: str, value: str) -> DataFrame:
    """Per group with two seeds or more: the trial of the highest mean over seeds, ties to the lowest number."""
    means = trials.groupBy(*group, trial).agg(F.avg(value).alias("m"), F.count_distinct(seed).alias("seeds")).where("seeds >= 2")
    w = Window.partitionBy(*group).orderBy(F.desc(F.round("m", 9)), trial)
    return means.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*group, trial, F.col("m").alias("mean_value"), "seeds")


def early_stopping(log: DataFrame, run: str, epoch: str, value: str, patience: int, warmup: int = 0) -> DataFrame:
    """Per run: selected epoch, its value, and the stop epoch (null if never). The first row is the baseline."""
    w = Window.partitionBy(run).orderBy(epoch)
    before = F.max(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(w) == 1
    marked = log.withColumn("_up", (first | (F.col(value) > before)).cast("int")).withColumn("_run", F.sum("_up").over(w))
    island = Window.partitionBy(run, "_run").orderBy(epoch)
    waits = marked.withColumn("_wait", F.sum(F.when((F.col("_up") == 0) & (F.col(epoch) >= warmup), 1).otherwise(0)).over(island))
    stops = waits.groupBy(run).agg(F.min(F.when(F.col("_wait") >= patience, F.col(epoch))).alias("stop_epoch"))
    seen = waits.join(stops, run).where(F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return seen.where("_up = 1").groupBy(run, "stop_epoch").agg(F.max(epoch).alias("selected_epoch"), F.round(F.max_by(value, epoch), 6).alias("best_value"))


def running_best(log: DataFrame, run: str, epoch: str, value: str) -> DataFrame:
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    return log.select(run, epoch, F.round(F.max(value).over(w), 6).alias("best"), F.avg(value).over(w).alias("mean_so_far"))


def edge_values(log: DataFrame, run: str, step: str, value: str) -> DataFrame:
    """Start, mean, least, largest and last value per run."""
    r = lambda c, n: F.round(c, 6).alias(n)
    return log.groupBy(run).agg(r(F.min_by(value, step), "start"), r(F.avg(value), "mean"), r(F.min(value), "min"), r(F.max(value), "max"), r(F.max_by(value, step), "end"))


def scenario_grid(dimensions: dict[str, DataFrame]) -> DataFrame:
    """All combinations of small dimensions of options, with a readable name."""
    out = None
    for d in dimensions.values():
        out = d if out is None else out.crossJoin(F.broadcast(d))  # options are a handful of literals
    return out.withColumn("scenario", F.concat_ws("_", *[F.concat(F.lit(f"{n}-"), F.col(n).cast("string")) for n in dimensions]))


def schedule(kind: str, epoch: Column, base: float, period: int, gamma: float = 0.1, floor: float = 0.0) -> Column:
    """Learning rates as closed forms: step decay, cosine, cosine with warm restarts."""
    if kind == "step":
        return base * F.pow(F.lit(gamma), F.floor(epoch / period))
    t = epoch % period if kind == "restarts" else F.least(epoch, F.lit(period))
    return floor + (base - floor) * (1 + F.cos(F.lit(3.141592653589793) * t / period)) / 2


def rebuild_due(epoch: Column, start: int, every: int | None) -> Column:
    """Whether something is rebuilt: once, every epoch or each ``every`` epochs from ``start``."""
    if every is None:
        return epoch == start
    return (epoch >= start) & ((epoch - start) % every == 0)


def ring_buffer(log: DataFrame, key: list[str], seq: list[str], size: int) -> DataFrame:
    """The last ``size`` rows by arrival."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in seq])
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= size).drop("_n")


def last_write(log: DataFrame, key: list[str], seq: list[str]) -> DataFrame:
    """A keyed bank after all writes: the last row of each key."""
    return ring_buffer(log, key, seq, 1)


def ema(log: DataFrame, run: str, seq: list[str], value: str, decay: float) -> DataFrame:
    """Exponential average by arrival, folded over each run's ordered values (a run's rows meet in one row)."""
    ordered = F.array_sort(F.collect_list(F.struct(*seq, F.col(value).alias("_v"))))
    folded = F.aggregate(F.slice("_o", 2, F.greatest(F.size("_o") - 1, F.lit(0))), F.col("_o")[0]["_v"].cast("double"), lambda a, x: decay * a + (1 - decay) * x["_v"])
    return log.groupBy(run).agg(ordered.alias("_o")).select(run, F.round(folded, 6).alias("ema"))


def distribution_alignment(probs: DataFrame, row: str, cls: str, p: str, target: DataFrame) -> DataFrame:
    """Probabilities times target over mean share of their class, normalised by row."""
    mean = probs.groupBy(cls).agg(F.avg(p).alias("_m"))
    scaled = probs.join(F.broadcast(mean), cls).join(F.broadcast(target), cls).withColumn("_s", F.col(p) * F.col("target") / F.greatest("_m", F.lit(1e-12)))
    sums = scaled.groupBy(row).agg(F.sum("_s").alias("_t"))
    return scaled.join(sums, row).select(row, cls, F.round(F.col("_s") / F.col("_t"), 6).alias("aligned"))
