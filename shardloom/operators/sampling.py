"""Label budgets and subsamples in seeded orders (see ``functions.ordering``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import group_positioned, hash_positioned, order_key


def ranked(df: DataFrame, sample: str, label: str, seed: int) -> DataFrame:
    """Adds the row's shuffled rank in its class (from 1) and the class size."""
    return group_positioned(df, label, order_key(seed, sample), [sample], "class_rank", "class_size")


def class_order(df: DataFrame, label: str, seed: int) -> DataFrame:
    """Classes with their shuffled rank (from 1) and their number; a row per class."""
    classes = df.select(label).distinct()
    w = Window.orderBy(order_key(seed, label, "class:"), label)
    return classes.select(label, F.row_number().over(w).cast("long").alias("class_no"), F.count(F.lit(1)).over(Window.partitionBy()).alias("classes"))


def _tagged(df: DataFrame, sample: str, label: str, labeled: Column) -> DataFrame:
    return df.select(sample, label, F.when(labeled, "labeled").otherwise("unlabeled").alias("pool"))


def per_class_count(fraction: float | None, k: int | None, size: Column) -> Column:
    """``min(k, size)``, or the fraction of the size rounded half to even, 1 at least."""
    if k is not None:
        return F.least(F.lit(k).cast("long"), size)
    return F.greatest(F.lit(1).cast("long"), F.bround(size * F.lit(float(fraction))).cast("long"))


def per_class_min(df: DataFrame, sample: str, label: str, seed: int, fraction: float | None = None, k: int | None = None) -> DataFrame:
    r = ranked(df, sample, label, seed)
    return _tagged(r, sample, label, F.col("class_rank") <= per_class_count(fraction, k, F.col("class_size")))


def full_rounds(sizes: DataFrame, size: str, budget: int) -> tuple[int, int]:
    """Round robin over classes of the given sizes: the rounds that fit the budget whole, and the rows they take. The
    round is sought among 64 candidates at a time, each step one sum over the class table."""
    low, high = 0, (sizes.agg(F.max(size)).first()[0] or 0) + 1
    taken = 0
    while high - low > 1:
        tries = sorted({low + max(1, (high - low) * k // 65) for k in range(1, 65)} - {low, high}) or [low + 1]
        sums = sizes.agg(*[F.sum(F.least(F.col(size), F.lit(t))).alias(f"s{t}") for t in tries]).first()
        fit = [(t, s) for t, s in zip(tries, sums, strict=True) if s <= budget]
        over = [t for t, s in zip(tries, sums, strict=True) if s > budget]
        low, taken = fit[-1] if fit else (low, taken)
        high = over[0] if over else high
    return low, int(taken)


def _round_robin(r: DataFrame, label: str, order: list, budget: int) -> DataFrame:
    """``r`` (class_rank, class_size) with ``_in``: whole rounds, and of the next one the first classes in ``order``."""
    whole, taken = full_rounds(r.select(label, "class_size").distinct(), "class_size", budget)
    last = r.where(F.col("class_rank") == whole + 1)  # a row per class at most
    last = last.withColumn("_n", F.row_number().over(Window.orderBy(*order))).where(F.col("_n") <= budget - taken)
    last = last.select(F.col(label).alias("_l"), F.lit(True).alias("_last"))
    joined = r.join(last, F.col(label).eqNullSafe(F.col("_l")), "left")
    inside = (F.col("class_rank") <= whole) | ((F.col("class_rank") == whole + 1) & F.col("_last").isNotNull())
    return joined.withColumn("_in", inside).drop("_l", "_last")


def global_budget(df: DataFrame, sample: str, label: str, seed: int, fraction: float) -> DataFrame:
    """Round robin over classes, freshly shuffled each round, up to ``max(1, floor(rows * fraction))`` rows."""
    budget = max(1, int(df.count() * fraction))
    turn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("class_rank").cast("string"), F.lit(":class:"), F.col(label).cast("string")))
    return _tagged(_round_robin(ranked(df, sample, label, seed), label, [turn, label], budget), sample, label, F.col("_in"))


def _chosen_classes(df: DataFrame, label: str, seed: int, fraction: float) -> DataFrame:
    order = class_order(df, label, seed)
    m = F.least(F.col("classes"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("classes") * F.lit(float(fraction)))))
    return order.where(F.col("class_no") <= m).select(label, F.lit(True).alias("_in"))


def class_subset(df: DataFrame, sample: str, label: str, seed: int, fraction: float) -> DataFrame:
    return _tagged(df.join(_chosen_classes(df, label, seed, fraction), label, "left"), sample, label, F.col("_in").isNotNull())


def class_subset_k_shot(df: DataFrame, sample: str, label: str, seed: int, fraction: float, k: int) -> DataFrame:
    r = ranked(df, sample, label, seed).join(_chosen_classes(df, label, seed, fraction), label, "left")
    return _tagged(r, sample, label, F.col("_in").isNotNull() & (F.col("class_rank") <= k))


def imbalanced_counts(df: DataFrame, label: str, seed: int, fraction: float) -> DataFrame:
    """(label, available, take): the total of :func:`per_class_min` spread unevenly, within ``max(1, floor(b / 2))`` and
    ``min(size, 2 b)`` of a class's even share ``b``.

    Above its lower bound a class has a seeded weight, ``b`` times a number from 0.25 to 2. What is left of the total
    fills the classes in proportion to their weights, up to their upper bounds (a common level, from sums over the
    classes by how soon they are full); running totals are rounded down, so that the sum is exact. All of it is windows
    over the class table.
    """
    u = F.conv(F.substring(order_key(seed, label, "weight:"), 1, 8), 16, 10).cast("double") / 4294967296.0
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("available"))
    c = c.withColumn("_b", per_class_count(fraction, None, F.col("available")))
    c = c.withColumn("_low", F.greatest(F.lit(1), F.floor(F.col("_b") / 2)))
    c = c.withColumns({"_room": (F.least("available", F.col("_b") * 2) - F.col("_low")).cast("double"), "_w": F.col("_b") * (F.lit(0.25) + F.lit(1.75) * u)})
    everything, full = Window.partitionBy(), Window.orderBy(F.col("_room") / F.col("_w"), label)
    c = c.withColumns({
        "_extra": F.sum(F.col("_b") - F.col("_low")).over(everything).cast("double"), "_all": F.sum("_room").over(everything),
        "_before": F.coalesce(F.sum("_room").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_open": F.sum("_w").over(full.rowsBetween(0, Window.unboundedFollowing)),
    })
    level = (F.col("_extra") - F.col("_before")) / F.col("_open")
    fits = F.col("_before") + F.col("_room") / F.col("_w") * F.col("_open") >= F.col("_extra")
    c = c.withColumn("_level", F.max(F.when(fits, level)).over(everything))
    share = F.least("_room", F.coalesce(F.col("_level") * F.col("_w"), F.col("_room")))
    upto = F.floor(F.sum(share).over(Window.orderBy(label)) + 1e-6)
    c = c.withColumn("_upto", upto)
    take = F.col("_low") + F.col("_upto") - F.coalesce(F.lag("_upto").over(Window.orderBy(label)), F.lit(0))
    return c.select(label, "available", take.cast("long").alias("take"))


def per_class_imbalanced(df: DataFrame, sample: str, label: str, seed: int, fraction: float) -> DataFrame:
    plan = imbalanced_counts(df, label, seed, fraction).select(label, "take")
    return _tagged(ranked(df, sample, label, seed).join(plan, label), sample, label, F.col("class_rank") <= F.col("take"))


def unlabeled_cap(tagged: DataFrame, sample: str, seed: int, cap: int) -> DataFrame:
    """At most ``cap`` unlabeled rows stay in their pool; the others are unused."""
    others = [c for c in tagged.columns if c != "pool"]
    free = hash_positioned(tagged.where("pool = 'unlabeled'"), order_key(seed, sample, "cap:"), [sample], "_i")
    free = free.select(*others, F.when(F.col("_i") < cap, "unlabeled").otherwise("unused").alias("pool"))
    return tagged.where("pool is null or pool <> 'unlabeled'").select(*others, "pool").union(free)


def long_tail_counts(df: DataFrame, label: str, factor: float) -> DataFrame:
    """Target counts ``int(largest * factor^(i/(C-1)))`` by ascending label, capped by what there is."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("available"))
    w = Window.orderBy(label)
    c = counts.select(label, "available", (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_c"), F.max("available").over(Window.partitionBy()).alias("_m"))
    exponent = F.when(F.col("_c") == 1, F.lit(0.0)).otherwise(F.col("_i") / (F.col("_c") - 1))
    return c.select(label, "available", F.least(F.col("available"), F.floor(F.col("_m") * F.pow(F.lit(float(factor)), exponent) + 1e-9)).alias("target"))


def long_tail_sample(df: DataFrame, sample: str, label: str, seed: int, factor: float) -> DataFrame:
    r = ranked(df, sample, label, seed).join(F.broadcast(long_tail_counts(df, label, factor).select(label, "target")), label)
    return r.where(F.col("class_rank") <= F.col("target")).select(sample, label)


def balanced_fraction(df: DataFrame, sample: str, label: str, seed: int, train: float, test: float) -> DataFrame:
    """Equal numbers per class, fractions of the smallest class: train rows first, then test rows of the shuffled class."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    r = ranked(df, sample, label, seed).crossJoin(F.broadcast(least))  # one row
    a, b = F.floor(F.col("least") * F.lit(train)), F.floor(F.col("least") * F.lit(test))
    part = F.when(F.col("class_rank") <= a, "train").when(F.col("class_rank") <= a + b, "test")
    return r.withColumn("part", part).where("part is not null").select(sample, label, "part")


def match_train(df: DataFrame, sample: str, label: str, seed: int, rows: int, classes: int) -> DataFrame:
    """A balanced subset: classes of two rows or more, in shuffled order, round robin to ``rows`` rows."""
    r = ranked(df, sample, label, seed).where("class_size >= 2")
    t = min(rows, r.count())
    order = class_order(r, label, seed)
    m = F.least(F.lit(classes).cast("long"), F.col("classes"), F.lit(max(1, t // 2)).cast("long"))
    picked = r.join(order.where(F.col("class_no") <= m).select(label, "class_no"), label)
    return _round_robin(picked, label, ["class_no"], t).where("_in").select(sample, label)


def uniform_sample(df: DataFrame, sample: str, seed: int, n: int) -> DataFrame:
    """The first ``n`` rows of the seeded order."""
    return hash_positioned(df, order_key(seed, sample), [sample], "_i").where(F.col("_i") < n).drop("_i")
