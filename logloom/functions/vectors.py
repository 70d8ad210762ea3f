"""Usage vectors: structs of nullable counters in which unknown is never zero."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "cache_write_input_tokens", "total_tokens")
TYPE = "struct<" + ", ".join(f"{f}: bigint" for f in FIELDS) + ">"


def each(of: Callable[[str], Column]) -> Column:
    return F.struct(*[of(f).cast("long").alias(f) for f in FIELDS])


def some(of: Callable[[str], Column]) -> Column:
    """True where it holds for a field; unknown counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(of(f), F.lit(False)) for f in FIELDS])


def zero() -> Column:
    return each(lambda f: F.lit(0))


def subtract(a: Column, b: Column) -> Column:
    """Known differences; a component unknown on one side is unknown. See decreases() for what must be refused."""
    return each(lambda f: a[f] - b[f])


def decreases(now: Column, before: Column) -> Column:
    return some(lambda f: now[f] < before[f])


def known(v: Column) -> Column:
    return some(lambda f: v[f].isNotNull())


def positive(v: Column) -> Column:
    return some(lambda f: v[f] > 0)


def explicit_zero(v: Column) -> Column:
    return F.coalesce(v["total_tokens"] == 0, F.lit(False)) & ~some(lambda f: v[f] != 0)


def same(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x & y, [a[f].eqNullSafe(b[f]) for f in FIELDS])


def matches(observed: Column, target: Column) -> Column:
    """Equal wherever the target is known."""
    return ~some(lambda f: target[f].isNotNull() & ~observed[f].eqNullSafe(target[f]))


def masked(v: Column, target: Column) -> Column:
    return each(lambda f: F.when(target[f].isNotNull(), v[f]))


def without_baseline(v: Column, baseline: Column, target: Column) -> Column:
    """Less the inherited part, not below zero; a null baseline takes nothing away, an unknown component of one leaves the value."""
    return each(lambda f: F.when(target[f].isNotNull(), F.when(v[f].isNotNull() & baseline[f].isNotNull(), F.greatest(v[f] - baseline[f], F.lit(0))).otherwise(F.when(baseline.isNull(), F.greatest(v[f], F.lit(0))).otherwise(v[f]))))


def total(v: Callable[[str], Column]) -> Column:
    """Aggregate: sums of the known values, unknown where none is."""
    return each(lambda f: F.sum(v(f)))


def key(v: Column) -> Column:
    """A value equal for equal vectors, unknown components equal to each other."""
    return F.concat_ws(",", *[F.coalesce(v[f].cast("string"), F.lit("?")) for f in FIELDS])
