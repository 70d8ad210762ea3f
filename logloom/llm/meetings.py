"""A stated set of asked rows against all rows, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_LOT = 512  # rows; smaller lots aren't made only to keep more tasks busy


def sound(v: Column) -> Column:
    """Whether a vector is there, isn't empty and holds neither null nor non-finite components."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0), F.lit(False))


def scaled(v: Column, scale: int) -> Column:
    """Floored multiples of the components; what a long can't hold ends at its limits."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def matrix(t: pa.Table, size: int, column: str = "v") -> np.ndarray:
    return np.asarray(t[column].combine_chunks().flatten()).reshape(-1, size) if t.num_rows else np.zeros((0, size), "i8")


def met(asked: DataFrame, rows: DataFrame, on: list[str], meeting: Callable[[tuple[pa.Scalar, ...], pa.Table, pa.Table], pa.Table], schema: str, block: int, lot: int) -> DataFrame:
    """meeting(key, block of asked, lot of rows) for all pairs of blocks and lots that are equal in on (the key begins with it).

    Both tables have a column row, by whose hash they are dealt: a group of any size is as many blocks or lots
    as it needs. An asked row moves once for each lot, another row once for each block."""
    tasks = asked.sparkSession.sparkContext.defaultParallelism
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size).cast("int"))
    counts = rows.groupBy(*on).agg(F.count("*").alias("n"))
    lots = counts.select(*on, F.greatest(parts(F.col("n"), lot), F.least(parts(F.col("n"), LEAST_LOT), F.lit(tasks))).alias("__lots"))
    blocks = asked.groupBy(*on).agg(F.count("*").alias("n")).select(*on, parts(F.col("n"), block).alias("__blocks"))
    sizes = lots.join(blocks, on)
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, on).withColumn("__block", dealt("__blocks")).withColumn("__lot", to_all("__lots")).drop("__blocks", "__lots")
    right = rows.join(sizes, on).withColumn("__lot", dealt("__lots")).withColumn("__block", to_all("__blocks")).drop("__blocks", "__lots")
    left = left.select(*[F.col(c).alias(c) for c in left.columns])  # both sides may come from one table
    key = [*on, "__block", "__lot"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(meeting, schema)
