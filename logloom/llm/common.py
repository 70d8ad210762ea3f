"""Small helpers shared by the training-text operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.checkpoints import checkpointed

__all__ = ["checkpointed", "learnable", "model", "prefix_sums", "released", "table"]
_models: dict[Hashable, Any] = {}


def model(name: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker has read or built for a step: one at a time, as workers outlive the steps of a pipeline."""
    if name not in _models:
        released()
        _models[name] = make()
    return _models[name]


def released() -> None:
    """Gives back what a worker still holds of earlier steps: the model, and freed memory that the allocators keep."""
    if _models:
        _models.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def learnable(doc_id: Column) -> Column:
    """False for the fifth of the documents that is held out of every fit, and for rows without an id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) != 0, F.lit(False))


def prefix_sums(df: DataFrame, key: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Adds out: the sum of value over all smaller keys (key: distinct integers from 0).

    Two levels, so that no window holds more than block rows of one level; df is small (a row per
    bucket or partition)."""
    blocks = df.withColumn("__block", F.floor(F.col(key) / block))
    before = blocks.groupBy("__block").agg(F.sum(value).alias("__sum"))
    before = before.select(
        "__block",
        F.coalesce(F.sum("__sum").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    inside = F.coalesce(F.sum(value).over(W.partitionBy("__block").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("__inside", inside).join(before, "__block").withColumn(out, F.col("__before") + F.col("__inside")).drop("__block", "__before", "__inside")
