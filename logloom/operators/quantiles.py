"""Exact quantiles of many groups, without a group's values meeting in one task.

Equal values are counted first. Values fall into steps of a logarithmic scale; the counts of a group's steps, a few
hundred rows, give each step its first rank, and ranks are told inside a step. So a task holds the distinct
values of one step of one group at most."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEPS = 64  # of a doubling


def step(v: Column) -> Column:
    """Rises with v."""
    size = F.when(F.abs(v) >= 1, 1 + F.floor(F.log2(F.abs(v).cast("double")) * STEPS)).otherwise(0)
    return F.when(v < 0, -size).otherwise(size)


def same(a: DataFrame, b: DataFrame, keys: tuple[str, ...], how: str = "left") -> DataFrame:
    """a joined to b on keys, nulls alike; b's other columns are added."""
    if not keys:
        return a.crossJoin(b)  # one row
    renamed = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    return a.join(renamed, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), how).drop(*[f"__{k}" for k in keys])


def exact(df: DataFrame, keys: tuple[str, ...], value: Column, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """keys and, for each name of wanted, a quantile of value in each group: disc, the smallest value that so large a
    share is not above; cont, interpolated between neighbours. Nulls don't count; groups of nulls alone aren't there."""
    rows = df.select(*keys, value.alias("__v")).where("__v IS NOT NULL").groupBy(*keys, "__v").agg(F.count("*").alias("__n")).withColumn("__step", step(F.col("__v")))
    steps = rows.groupBy(*keys, "__step").agg(F.sum("__n").alias("__m"))
    order = W.partitionBy(*keys).orderBy("__step")
    steps = steps.select(*keys, "__step", F.coalesce(F.sum("__m").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__m").over(W.partitionBy(*keys)).alias("__all"))
    inside = F.coalesce(F.sum("__n").over(W.partitionBy(*keys, "__step").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = same(rows.withColumn("__inside", inside), steps, (*keys, "__step"), "inner").withColumn("__first", F.col("__before") + F.col("__inside"))
    at = lambda place: F.max(F.when((F.col("__first") <= place) & (place < F.col("__first") + F.col("__n")), F.col("__v")))
    cols = []
    for name, (p, kind) in wanted.items():
        if kind == "disc":
            cols.append(at(F.greatest(F.ceil(F.col("__all") * p) - 1, F.lit(0))).alias(name))
            continue
        place = (F.col("__all") - 1) * F.lit(p)
        low, part = F.floor(place), F.max(place - F.floor(place))
        cols.append((at(low) + (at(F.ceil(place)) - at(low)) * part).cast("double").alias(name))
    return ranked.groupBy(*keys).agg(*cols)
