"""Closed-schema configuration, dataset names, search spaces and method registries (driver side)."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

MODES = ("per_class_min", "per_class_imbalanced", "global_budget", "class_subset", "class_subset_k_shot")
VALIDATION_MODES = ("all", "match_train", "split_after_apportion")


@dataclass(frozen=True)
class LabelConfig:
    """How rows are labelled, filtered and validated."""

    mode: str = "per_class_min"
    fraction: float = 0.1
    k: int | None = None
    seed: int = 0
    method: str = "knn_majority_vote"
    neighbours: int = 5
    threshold: float = 0.0
    rescue_classes: int | None = None
    unlabeled_cap: int | None = None
    validation_mode: str = "all"

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode: {self.mode}")
        if self.validation_mode not in VALIDATION_MODES:
            raise ValueError(f"validation_mode: {self.validation_mode}")
        if not 0 < self.fraction <= 1:
            raise ValueError("fraction outside (0, 1]")
        if self.k is not None and self.k < 1 or self.neighbours < 1:
            raise ValueError("counts begin at 1")
        if self.mode == "class_subset_k_shot" and self.k is None:
            raise ValueError("k is required")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold outside [0, 1]")


def load(cls: type, source: dict[str, Any] | str, lenient: bool = False) -> tuple[Any, list[str]]:
    """A config of a mapping or a JSON file, and the keys ignored; unknown keys raise unless ``lenient``."""
    given = source if isinstance(source, dict) else json.loads(Path(source).read_text())
    known = {f.name for f in fields(cls)}
    extra = sorted(set(given) - known)
    if extra and not lenient:
        raise ValueError(f"unknown keys: {', '.join(extra)}")
    return cls(**{k: v for k, v in given.items() if k in known}), extra


def with_value(config: dict[str, Any], path: str, value: Any) -> dict[str, Any]:
    """A copy of a nested mapping with ``value`` at a dotted path; mappings on the way are made where they are missing.
    A path without a key, and one through something that is no mapping, are errors."""
    head, _, rest = path.partition(".")
    if not head:
        raise ValueError(f"no key in path {path!r}")
    if not isinstance(config, dict):
        raise ValueError(f"{head!r} is not within a mapping")
    if not rest and path.endswith("."):
        raise ValueError(f"no key at the end of {path!r}")
    return config | {head: with_value(config.get(head, {}), rest, value) if rest else value}


def overridden(config: dict[str, Any], prefix: str, params: dict[str, Any]) -> dict[str, Any]:
    """``config`` with each parameter ``prefix.path`` set at its path; parameters of other names are not for it."""
    for name in sorted(params):
        if name == prefix or name.startswith(f"{prefix}."):
            config = with_value(config, name[len(prefix) + 1 :], params[name])
    return config


def canonical_name(name: str, aliases: dict[str, str]) -> str:
    """A dataset's name from its aliases, whatever the case and separators."""
    key = "".join(c for c in name.lower() if c.isalnum())
    table = {"".join(c for c in a.lower() if c.isalnum()): n for a, n in aliases.items()}
    if key not in table:
        raise ValueError(f"unknown dataset {name}; one of {', '.join(sorted(set(aliases.values())))}")
    return table[key]


def ready(spark: SparkSession, path: str, tables: list[str]) -> list[str]:
    """Tables missing under a path, looked up with Hadoop's file systems, so any store will do."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    missing = []
    for t in tables:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{t}.parquet")
        if not at.getFileSystem(conf).exists(at):
            missing.append(t)
    return missing


def fraction_protocol(train: float, test: float) -> None:
    """Fractions in (0, 1] that sum to 1 at most."""
    if not (0 < train <= 1 and 0 < test <= 1 and train + test <= 1 + 1e-12):
        raise ValueError("fractions must be in (0, 1] and sum to 1 at most")


def space(spec: dict[str, Any]) -> dict[str, Any]:
    """A checked search-space entry: categorical with choices, or float / int with bounds, log or step."""
    kind = spec.get("type")
    allowed = {"categorical": {"type", "choices"}, "float": {"type", "low", "high", "log", "step"}, "int": {"type", "low", "high", "log", "step"}}.get(kind)
    if allowed is None or set(spec) - allowed:
        raise ValueError(f"bad space: {spec}")
    if kind == "categorical":
        if not spec.get("choices"):
            raise ValueError("no choices")
    elif not spec["low"] <= spec["high"] or spec.get("log") and (spec["low"] <= 0 or spec.get("step")):
        raise ValueError(f"bad bounds: {spec}")
    return spec


METHODS: dict[str, Callable[..., DataFrame]] = {}


def method(name: str) -> Callable:
    """Registers a pseudo-label method: (labeled, unlabeled, config) to (query_id, pred_label, confidence)."""

    def put(f: Callable) -> Callable:
        METHODS[name] = f
        return f

    return put


@method("knn_majority_vote")
def _(labeled: DataFrame, unlabeled: DataFrame, config: LabelConfig) -> DataFrame:
    from ..operators.knn import knn, majority_vote

    return majority_vote(knn(unlabeled, labeled, "embedding", config.neighbours), labeled).select("query_id", "pred_label", "confidence")


@method("label_spreading")
def _(labeled: DataFrame, unlabeled: DataFrame, config: LabelConfig) -> DataFrame:
    from pyspark.sql import functions as F

    from ..operators import graph, propagation
    from ..operators.knn import knn

    both = labeled.select("vec_id", "embedding").unionByName(unlabeled.select("vec_id", "embedding"))
    edges = graph.mixed_affinity(knn(both, both, "embedding", config.neighbours))
    seeds = labeled.select(F.col("vec_id").alias("node"), F.col("label").alias("class"), F.lit(1.0).alias("y"))
    nodes = unlabeled.select(F.col("vec_id").alias("node"))
    return propagation.decided(propagation.spread(edges, seeds), nodes).select(F.col("node").alias("query_id"), "pred_label", F.least("confidence", F.lit(1.0)).alias("confidence"))


def build_sets(df: DataFrame, config: LabelConfig, sample: str = "vec_id", label: str = "label", valid: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The training set and its validation rows (sample, label). The training set is the whole build: budget, holdout
    after it if configured, cap, pseudo-labels by the configured method, filter and rescue, relabelled union.

    ``all`` keeps the validation rows given; ``match_train`` takes a balanced subset of them, of as many rows and classes
    as are labelled; ``split_after_apportion`` holds labelled classes out of ``df`` instead and drops their unlabelled rows.
    """
    from pyspark.sql import functions as F

    from ..operators import pseudo, sampling, splits

    mode = config.validation_mode
    if mode == "match_train" and valid is None or mode == "split_after_apportion" and valid is not None:
        raise ValueError(f"validation rows {'missing' if valid is None else 'given'}: {mode}")
    make = {
        "per_class_min": lambda: sampling.per_class_min(df, sample, label, config.seed, config.fraction, config.k),
        "per_class_imbalanced": lambda: sampling.per_class_imbalanced(df, sample, label, config.seed, config.fraction),
        "global_budget": lambda: sampling.global_budget(df, sample, label, config.seed, config.fraction),
        "class_subset": lambda: sampling.class_subset(df, sample, label, config.seed, config.fraction),
        "class_subset_k_shot": lambda: sampling.class_subset_k_shot(df, sample, label, config.seed, config.fraction, config.k),
    }
    pools = make[config.mode]()
    if mode == "split_after_apportion":
        parts = splits.post_apportion(pools, sample, label, config.seed)
        valid = parts.where("part = 'valid'").select(sample, label)
        pools = parts.where("part in ('labeled', 'unlabeled')").select(sample, label, F.col("part").alias("pool"))
    elif mode == "match_train":
        size = pools.where("pool = 'labeled'").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("classes")).first()
        valid = sampling.match_train(valid, sample, label, config.seed, size["n"], size["classes"])
    elif valid is not None:
        valid = valid.select(sample, label)
    if config.unlabeled_cap is not None:
        pools = sampling.unlabeled_cap(pools, sample, config.seed, config.unlabeled_cap)
    rows = df.join(pools.select(sample, "pool"), sample)
    labeled, unlabeled = rows.where("pool = 'labeled'"), rows.where("pool = 'unlabeled'").drop(label)
    preds = METHODS[config.method](labeled, unlabeled, config)
    kept = pseudo.filter_labels(preds, labeled.select(label).distinct(), config.threshold, config.rescue_classes)
    return pseudo.relabeled(labeled, kept, sample, label), valid


def build_training_set(df: DataFrame, config: LabelConfig, sample: str = "vec_id", label: str = "label", valid: DataFrame | None = None) -> DataFrame:
    """The training set of ``build_sets``."""
    return build_sets(df, config, sample, label, valid)[0]
