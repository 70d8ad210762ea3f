"""Continuous ingest: the batch functions over micro-batches, windows with late data, and stateful counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from logloom.sources import records

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # what stateful counters need


def ingest(lines: DataFrame, out: str, checkpoint: str, more: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Record lines (a stream of immutable chunks) parsed and appended as Parquet.

    A micro-batch that is run again overwrites what it wrote before."""

    def keep(batch: DataFrame, number: int) -> None:
        more(records.parsed(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return lines.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_usage(steps: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Tokens by window of event time, once the watermark is past it; what comes later still is left out (corrections takes it in)."""
    return steps.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", width).alias("w")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("steps")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "tokens", "steps")


def corrections(steps: DataFrame, out: str, checkpoint: str, width: str = "1 day") -> StreamingQuery:
    """Window totals that late steps correct: for every window a micro-batch touches, the former total taken back and the new one put in its place.

    Each micro-batch writes what it adds to each window, and the rows that retract and replace, into folders of its
    own number; one that is run again overwrites them and reads only those before it, so its effect counts once.
    Nothing is held back, whatever the lateness; settled() and the sum of the signed rows agree at any time."""

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        part = batch.groupBy(F.window("occurred_at", width)["start"].alias("start")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("steps"))
        part.write.mode("overwrite").parquet(f"{out}/added/batch={number}")
        new = spark.read.schema(part.schema).parquet(f"{out}/added/batch={number}")
        totals = lambda df: df.groupBy("start").agg(F.sum("tokens").alias("tokens"), F.sum("steps").alias("steps"))
        before = spark.read.schema(ADDED).parquet(f"{out}/added").where(F.col("batch") < number).join(new.select("start"), "start", "left_semi")
        old = totals(before).withColumn("sign", F.lit(-1))
        now = totals(before.select(new.columns).unionByName(new)).withColumn("sign", F.lit(1))
        old.unionByName(now).write.mode("overwrite").parquet(f"{out}/signed/batch={number}")

    return steps.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ADDED = "start timestamp, tokens long, steps long, batch int"
SIGNED = "start timestamp, tokens long, steps long, sign int, batch int"


def settled(signed: DataFrame) -> DataFrame:
    """(start, tokens, steps, replaced): the windows as the signed rows leave them, and how often each was replaced."""
    return signed.groupBy("start").agg(F.sum(F.col("sign") * F.col("tokens")).alias("tokens"), F.sum(F.col("sign") * F.col("steps")).alias("steps"), F.count_if(F.col("sign") < 0).alias("replaced"))


class Increments(StatefulProcessor):
    """Holds each session's last cumulative total; a fall yields a row marked as such and starts anew."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "total long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        parts = list(rows)
        r = (parts[0] if len(parts) == 1 else pd.concat(parts)).sort_values("event_ordinal")
        total = r["cumulative_total"].to_numpy("i8")
        before = np.concatenate([[0 if last is None else last], total[:-1]])
        falls = total < before
        if last is None:
            falls[:1] = False
        self.last.update((int(total[-1]),))
        yield pd.DataFrame({"sid": key[0], "occurred_at": r["occurred_at"].to_numpy(), "tokens": np.where(falls, total, total - before), "fallback": falls})

    def close(self) -> None:
        pass


def increments(events: DataFrame) -> DataFrame:
    """events: sid, event_ordinal, occurred_at, cumulative_total, in order within a session across batches."""
    return events.groupBy("sid").transformWithStateInPandas(Increments(), "sid long, occurred_at timestamp, tokens long, fallback boolean", "append", "None")
