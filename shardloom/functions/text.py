"""Text expressions: slugs, path keys, tokens, rendered lists and table cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than letters and digits as one ``_``, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def float_token(c: Column) -> Column:
    """A number for use in names: ``.`` as ``p``."""
    return F.replace(c.cast("string"), F.lit("."), F.lit("p"))


def class_list(labels: Column, most: int = 50) -> Column:
    """Sorted labels joined by ``;``: the first ``most``, then ``...(+n)``."""
    s = F.array_sort(labels)
    shown = F.array_join(F.slice(s, 1, most).cast("array<string>"), ";")
    return F.when(F.size(s) > most, F.concat(shown, F.lit(";...(+"), (F.size(s) - most).cast("string"), F.lit(")"))).otherwise(shown)


def group_key(path: Column, prefixes: list[str]) -> Column:
    """The first two directories of a path behind known leading directories."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    known = F.array(*[F.lit(p) for p in prefixes])
    start = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, p: F.struct((a["n"] + F.when(a["on"] & F.array_contains(known, F.lower(p)), 1).otherwise(0)).alias("n"), (a["on"] & F.array_contains(known, F.lower(p))).alias("on")),
        lambda a: a["n"],
    )
    return F.array_join(F.slice(parts, start + 1, 2), "/")


def first_token(line: Column, suffixes: list[str]) -> Column:
    """The first white-space token that ends with one of the suffixes, in any case; null if there is none."""
    pattern = "(?i).*\\.(" + "|".join(s.lstrip(".") for s in suffixes) + ")$"
    return F.try_element_at(F.filter(F.split(F.trim(line), "\\s+"), lambda t: t.rlike(pattern)), F.lit(1))


def cell(c: Column, kind: str) -> Column:
    """A Markdown cell: four decimals for fractions, empty for null, pipes escaped."""
    text = F.when(c.isNotNull(), F.format_string("%.4f", c.cast("double"))) if kind in ("double", "float") else c.cast("string")
    return F.coalesce(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit(""))
