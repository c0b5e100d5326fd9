"""Dataset protocols: which classes and rows develop and which test.

A protocol is resolved to a plan from the class table alone, before any row is read; the plan is checked (disjoint, nothing
unknown, nothing empty) where it is made. Loading it filters the sources by the plan's classes, so the filter reaches the
scan, or ranks rows within classes where the protocol takes shares of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sampling

#: Class lists up to this length are filters, longer ones joins.
MOST_LISTED = 1000

ClassTable = Sequence[tuple]  # (class, superclass or None)


@dataclass(frozen=True)
class Plan:
    """What a protocol comes to: classes of both sides (None: all, told apart by the source), or shares of every class."""

    name: str
    basis: str
    development: tuple | None = None
    held_out: tuple | None = None
    shares: tuple[float, float] | None = None
    class_disjoint: bool = False
    superclass_disjoint: bool = False
    facts: dict = field(default_factory=dict)

    def check(self, classes: ClassTable) -> Plan:
        if self.development is None:
            return self
        known = {c for c, _ in classes}
        dev, test = set(self.development), set(self.held_out)
        if both := dev & test:
            raise ValueError(f"{self.name}: classes on both sides: {sorted(both)[:10]}")
        if strange := (dev | test) - known:
            raise ValueError(f"{self.name}: unknown classes: {sorted(strange)[:10]}")
        if not dev or not test:
            raise ValueError(f"{self.name}: a side without classes")
        if self.superclass_disjoint:
            above = dict(classes)
            if both := {above[c] for c in dev} & {above[c] for c in test}:
                raise ValueError(f"{self.name}: superclasses on both sides: {sorted(both)[:10]}")
        return self


PROTOCOLS: dict[str, Callable[..., Plan]] = {}


def protocol(name: str) -> Callable:
    """Registers a rule (class table, options) -> plan; a name is taken once."""

    def put(rule: Callable[..., Plan]) -> Callable[..., Plan]:
        if name in PROTOCOLS:
            raise ValueError(f"protocol {name} exists")
        PROTOCOLS[name] = rule
        return rule

    return put


def resolve(name: str, classes: ClassTable, **options) -> Plan:
    """The checked plan of a protocol for these classes."""
    if name not in PROTOCOLS:
        raise ValueError(f"unknown protocol {name!r}; known: {', '.join(sorted(PROTOCOLS))}")
    if len({c for c, _ in classes}) < len(classes):
        raise ValueError("a class occurs twice in the class table")
    return PROTOCOLS[name](sorted(classes), **options).check(classes)


def _head(n: int, share: float) -> int:
    """``share`` of n things, at least one on either side."""
    if not 0 < share < 1 or n < 2:
        raise ValueError(f"a share of {share} of {n} leaves a side without classes")
    return min(max(1, math.floor(n * share + 1e-9)), n - 1)


@protocol("official")
def _(classes: ClassTable) -> Plan:
    """The sources' own boundary."""
    return Plan("official", "official_splits")


@protocol("balanced_fraction")
def _(classes: ClassTable, train: float = 0.8, test: float = 0.2) -> Plan:
    """Equal numbers of rows of every class, fractions of the smallest one's."""
    if not 0 < train <= 1 or not 0 < test <= 1 or train + test > 1 + 1e-12:
        raise ValueError(f"fractions {train} and {test} must be in (0, 1] and sum to at most 1")
    return Plan("balanced_fraction", "rows_within_class", shares=(train, test))


@protocol("unseen_classes")
def _(classes: ClassTable, share: float = 0.6) -> Plan:
    """The first classes develop, the others test."""
    ids = [c for c, _ in classes]
    n = _head(len(ids), share)
    return Plan("unseen_classes", "contiguous_classes", tuple(ids[:n]), tuple(ids[n:]), class_disjoint=True)


@protocol("unseen_classes_interleaved")
def _(classes: ClassTable, every: int = 3) -> Plan:
    """Every so many-th class tests."""
    ids = [c for c, _ in classes]
    test = ids[every - 1 :: every]
    return Plan("unseen_classes_interleaved", "every_nth_class", tuple(c for c in ids if c not in set(test)), tuple(test), class_disjoint=True)


def _by_superclass(classes: ClassTable) -> dict:
    above: dict = {}
    for c, s in classes:
        if s is None:
            raise ValueError(f"class {c} has no superclass")
        above.setdefault(s, []).append(c)
    return above


@protocol("unseen_classes_within_superclass")
def _(classes: ClassTable, share: float = 0.6) -> Plan:
    """Of every superclass the first classes develop and the others test: unseen classes of seen superclasses."""
    above = _by_superclass(classes)
    dev = [c for s in sorted(above) for c in above[s][: _head(len(above[s]), share)]]
    test = [c for c, _ in classes if c not in set(dev)]
    return Plan("unseen_classes_within_superclass", "classes_within_superclass", tuple(dev), tuple(test), class_disjoint=True, facts={"superclasses": sorted(above)})


@protocol("unseen_superclasses")
def _(classes: ClassTable, share: float = 0.5) -> Plan:
    """The first superclasses' classes develop, the others' test."""
    above = _by_superclass(classes)
    order = sorted(above)
    n = _head(len(order), share)
    dev, test = ([c for s in part for c in above[s]] for part in (order[:n], order[n:]))
    return Plan("unseen_superclasses", "superclasses", tuple(dev), tuple(test), class_disjoint=True, superclass_disjoint=True, facts={"development": order[:n], "held_out": order[n:]})


def _of_classes(rows: DataFrame, label: str, classes: tuple) -> DataFrame:
    if len(classes) <= MOST_LISTED:
        return rows.where(F.col(label).isin(*classes))
    listed = rows.sparkSession.createDataFrame([(c,) for c in classes], f"_c {dict(rows.dtypes)[label]}")
    return rows.join(listed, F.col(label) == F.col("_c"), "left_semi")


def load(plan: Plan, train: DataFrame, test: DataFrame, sample: str, label: str, seed: int = 0, long_tail: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Development and test rows (sample, label) of a plan. All but the official protocol join the two sources first;
    ``long_tail`` (least over largest class) thins the development classes afterwards, and doesn't go with shares, which
    are balanced."""
    if long_tail is not None and (plan.shares or not 0 < long_tail <= 1):
        raise ValueError("a long tail needs a factor in (0, 1] and a protocol that isn't balanced")
    train, test = (d.select(sample, label) for d in (train, test))
    if plan.shares:
        both = train.unionByName(test)
        least = both.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0] or 0
        if any(math.floor(least * s) < 1 for s in plan.shares):
            raise ValueError(f"a fraction of the smallest class ({least} rows) is no row")
        parts = sampling.balanced_fraction(both, sample, label, seed, *plan.shares)
        return tuple(parts.where(F.col("part") == p).select(sample, label) for p in ("train", "test"))
    if plan.development is None:
        development, held_out = train, test
    else:
        both = train.unionByName(test)
        development, held_out = _of_classes(both, label, plan.development), _of_classes(both, label, plan.held_out)
    if long_tail is not None:
        development = sampling.long_tail_sample(development, sample, label, seed, long_tail)
    return development, held_out
