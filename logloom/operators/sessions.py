"""Session lists and summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUTSIDE = ("outside-git", "non-git", "none")


def in_window(ts: Column, since: datetime | None = None, until: datetime | None = None) -> Column:
    """Half open: since <= ts < until."""
    test = F.lit(True)
    if since is not None:
        test &= ts >= F.lit(since)
    if until is not None:
        test &= ts < F.lit(until)
    return test


def of_repository(wanted: str, root: Column, name: Column | None = None, identity: Column | None = None) -> Column:
    """A repository by its root, its identity or its name in any case; outside-git is none at all."""
    if wanted.lower() in OUTSIDE:
        return root.isNull()
    test = root == wanted
    name = F.element_at(F.split(root, "/"), -1) if name is None else name
    test |= F.lower(name) == wanted.lower()
    return test | (identity == wanted) if identity is not None else test


def of_model(wanted: str, model: Column) -> Column:
    return (model.isNull() | (model == "")) if wanted.lower() in ("unknown", "none") else F.lower(model) == wanted.lower()


def of_task(wanted: str, value: Column) -> Column:
    return F.coalesce(value, F.lit("unknown")) == wanted


def label(root: Column, name: Column | None = None) -> Column:
    parts = [F.element_at(F.split(root, "/"), -1), F.lit("Outside Git repositories")]
    return F.coalesce(*([name] if name is not None else []), *parts)


def duration(start: Column, end: Column) -> Column:
    """Whole seconds; unknown when an end is missing or before the start."""
    return F.when(end >= start, F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000))


def latest(rows: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """The newest row of each key."""
    return rows.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*newest))).where("__rank = 1").drop("__rank")


def by_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """The row of an id or of an unambiguous beginning of one; at most two rows reach the driver."""
    exact = rows.where(F.col(column) == prefix)
    if exact.limit(1).count():
        return exact
    found = [r[0] for r in rows.where(F.col(column).startswith(prefix)).select(column).distinct().limit(2).collect()]
    if not found:
        raise LookupError(f"no {column} begins with {prefix!r}")
    if len(found) > 1:
        raise LookupError(f"more than one {column} begins with {prefix!r}")
    return rows.where(F.col(column) == found[0])


def listed(sessions: DataFrame, usage: DataFrame, events: DataFrame, limit: int) -> DataFrame:
    """Sessions, newest first, with the known total and the number of events."""
    if limit < 1:
        raise ValueError("limit must be positive")
    counts = events.groupBy("sid").agg(F.count("*").alias("events"))
    rows = sessions.join(usage.select("sid", F.col("observed.total_tokens").alias("total_tokens")), "sid", "left").join(counts, "sid", "left")
    return rows.orderBy(F.desc_nulls_last("started_at"), "sid").limit(limit)


def repositories(sessions: DataFrame, usage: DataFrame) -> DataFrame:
    rows = sessions.join(usage, "sid", "left")
    return rows.groupBy("repository_root").agg(
        F.count("*").alias("sessions"),
        F.min("started_at").alias("first_at"),
        F.max("started_at").alias("latest_at"),
        F.sum("observed.total_tokens").alias("tokens"),
        F.count("observed.total_tokens").alias("known_sessions"),
        F.count_distinct("model").alias("models"),
    )


def models(sessions: DataFrame, usage: DataFrame) -> DataFrame:
    return sessions.join(usage, "sid", "left").groupBy("model").agg(
        F.count("*").alias("sessions"),
        F.max("started_at").alias("latest_at"),
        F.sum("observed.total_tokens").alias("tokens"),
        F.count("observed.total_tokens").alias("known_sessions"),
        F.count_distinct("repository_root").alias("repositories"),
    )


def overview(sessions: DataFrame, usage: DataFrame, now: datetime) -> DataFrame:
    start = F.col("started_at")
    back = lambda days: F.count_if((start >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS")) & (start < F.lit(now)))
    return sessions.join(usage, "sid", "left").agg(
        F.count("*").alias("sessions"),
        F.count_distinct(F.to_date(start)).alias("active_days"),
        F.count_distinct("repository_root").alias("repositories"),
        F.count_if(F.to_date(start) == F.to_date(F.lit(now))).alias("today"),
        back(7).alias("last_7_days"),
        back(30).alias("last_30_days"),
        F.sum("observed.total_tokens").alias("tokens"),
        F.count("observed.total_tokens").alias("known_sessions"),
    )
