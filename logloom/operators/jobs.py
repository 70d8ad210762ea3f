"""Incremental ingest into partitioned tables: only what changed is parsed, a log cut short keeps its earlier rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions import vectors as V

BUCKETS = 64


def bucket(sid: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(sid), F.lit(buckets)).cast("int")


def clean_sessions(parsed: DataFrame) -> DataFrame:
    """(sid) of the sessions with a sound line and no last line cut short; malformed lines between are only counted."""
    by = parsed.groupBy("sid").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "partial").alias("partial"))
    return by.where("ok > 0 AND partial = 0").select("sid")


def upsert(previous: DataFrame | None, parsed: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """What write() has to write: the sound lines of clean sessions in the place of theirs, and the other sessions of the same buckets as they were.

    Sessions that are not clean keep what they had and are marked stale; buckets without a parsed session are
    neither read nor written."""
    good = clean_sessions(parsed)
    fresh = parsed.where("status = 'ok'").join(good, "sid", "left_semi").withColumn("stale", F.lit(False))
    if previous is None:
        return fresh
    seen = parsed.select("sid").distinct()
    touched = seen.select(bucket(F.col("sid"), buckets).alias("session_bucket")).distinct()  # a row per bucket
    before = previous if "session_bucket" in previous.columns else previous.withColumn("session_bucket", bucket(F.col("sid"), buckets))
    before = before.join(F.broadcast(touched), "session_bucket", "left_semi").drop("session_bucket")
    failed = seen.join(good, "sid", "left_anti").withColumn("__failed", F.lit(True))
    kept = before.join(good, "sid", "left_anti").join(failed, "sid", "left")
    return fresh.unionByName(kept.withColumn("stale", F.col("stale") | F.col("__failed").isNotNull()).drop("__failed"))


def write(table: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """By session bucket; only the buckets in the table are overwritten."""
    rows = table.withColumn("session_bucket", bucket(F.col("sid"), buckets))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_bucket").parquet(path)


def counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Sessions by discovered, updated and unchanged; before and after: sid, digest."""
    a, b = after.alias("a"), before.alias("b")
    state = F.when(F.col("b.sid").isNull(), "discovered").when(F.col("a.digest").eqNullSafe(F.col("b.digest")), "unchanged").otherwise("updated")
    return a.join(b, F.col("a.sid") == F.col("b.sid"), "left").groupBy(state.alias("state")).agg(F.count("*").alias("sessions"))


def schema_fingerprint(parsed: DataFrame) -> DataFrame:
    """(sid, fingerprint): equal for sessions of the same record and payload types."""
    types = F.sort_array(F.collect_set(F.concat_ws("/", F.coalesce("record_type", F.lit("?")), F.coalesce("payload_type", F.lit("?")))))
    return parsed.groupBy("sid").agg(F.sha2(F.to_json(types), 256).alias("fingerprint"))


def unknown_shapes(parsed: DataFrame, known: list[str], most: int = 128) -> DataFrame:
    """(sid, name, n) of record types that are not known; beyond the first names of a session, one for the rest."""
    rows = parsed.where(~F.coalesce("record_type", F.lit("?")).isin(known)).groupBy("sid", F.coalesce("record_type", F.lit("?")).alias("name")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    place = F.row_number().over(W.partitionBy("sid").orderBy("first", "name"))
    return rows.withColumn("name", F.when(place <= most, F.col("name")).otherwise(F.lit("__other__"))).groupBy("sid", "name").agg(F.sum("n").alias("n"))


def token_warnings(events: DataFrame) -> DataFrame:
    """(sid, decreases, component_over_total): falls between snapshots, and parts greater than their total."""
    order = W.partitionBy("sid").orderBy("event_ordinal")
    c = F.col("cumulative")
    rows = events.where("cumulative IS NOT NULL").withColumn("before", F.lag("cumulative").over(order))
    over = V.some(lambda f: c[f] > c["total_tokens"])
    return rows.groupBy("sid").agg(F.count_if(V.decreases(c, F.col("before"))).alias("decreases"), F.count_if(over).alias("component_over_total"))


def purged(table: DataFrame, text: str, operation: str | None = None) -> tuple[DataFrame, int]:
    """The table without a text column's content, and how many rows had some.

    operation: a column that first keeps, where it is empty, whether the text was a commit of git."""
    rows = table.where(F.col(text).isNotNull()).count()
    if operation:
        commits = F.col(text).rlike(r"^\s*(?:\S*/)?git\s+commit(?:\s|$)")
        table = table.withColumn(operation, F.coalesce(F.col(operation), F.when(commits, "git_commit")))
    return table.withColumn(text, F.lit(None).cast("string")), rows


def inventory(tables: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(name, counter, n): rows of each table, and those of which each condition holds."""
    parts = []
    for name, (df, conditions) in tables.items():
        row = df.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("counter"), F.col(k).alias("n")) for k in ("rows", *conditions)]))
        parts.append(row.select(F.lit(name).alias("name"), pairs.alias("p")).select("name", "p.*"))
    return reduce(DataFrame.unionByName, parts)


def manifest(listing: DataFrame, before: DataFrame | None, parsed: DataFrame, version: str) -> DataFrame:
    """(path, size, modified_at, version, fingerprint, status, warning, indexed): the state of each file after a run.

    listing: path, size, modified_at, sid; parsed: sid, status, fingerprint of the run's sessions (ok, partial or
    failed). What was last read well stays known where a run fails."""
    now = listing.join(parsed, "sid", "left")
    if before is None:
        before = now.select("path", F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified_at"), F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("fingerprint")).limit(0)
    old = before.select("path", *[F.col(c).alias(f"old_{c}") for c in ("size", "modified_at", "version", "fingerprint")])
    rows = now.join(old, "path", "left")
    read = F.col("status") == "ok"
    kept = lambda c, new: F.when(read, new).otherwise(F.col(f"old_{c}")).alias(c)
    warning = F.when(F.col("status") == "partial", "last line cut short").when(F.col("status") == "failed", "no sound line")
    return rows.select("path", kept("size", F.col("size")), kept("modified_at", F.col("modified_at")), kept("version", F.lit(version)), kept("fingerprint", F.col("fingerprint")), F.coalesce("status", F.lit("unchanged")).alias("status"), warning.alias("warning"))


def run_log(states: DataFrame, run: int, started: Column, finished: Column) -> DataFrame:
    """One row of a run: how many sessions were discovered, new, updated, unchanged, stale or failed, and how it ended.

    states: a row per session with its state."""
    names = ("new", "updated", "unchanged", "stale", "failed")
    row = states.agg(F.count("*").alias("discovered"), *[F.count_if(F.col("state") == s).alias(s) for s in names])
    status = F.when(F.col("failed") + F.col("stale") == 0, "completed").otherwise("completed_with_errors")
    return row.select(F.lit(run).alias("run"), started.alias("started_at"), finished.alias("finished_at"), "discovered", *names, status.alias("status"))


def dirty_by_version(tables: list[tuple[DataFrame, str]], key: str = "sid") -> DataFrame:
    """(key) of the rows of any table that another version of its classifier wrote. tables: (rows with key and version, the version in use)."""
    return reduce(DataFrame.unionByName, [t.where(~F.col("version").eqNullSafe(F.lit(v))).select(key) for t, v in tables]).distinct()


def changed_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """(parent, child, state): edges that are new or gone."""
    edge = ["parent", "child"]
    new, gone = after.select(edge).subtract(before.select(edge)), before.select(edge).subtract(after.select(edge))
    return new.withColumn("state", F.lit("new")).unionByName(gone.withColumn("state", F.lit("gone")))


def replaced(before: DataFrame, after: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(stale, new): rows of before whose key is no more, rows of after whose key is new."""
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    return before.join(after, same(before, after), "left_anti"), after.join(before, same(after, before), "left_anti")


def warnings_of(topology: DataFrame) -> DataFrame:
    """(warning, n) of a spawn graph: self edges, orphan parents and children, children of several parents and nodes on cycles, where there are any."""
    names = ("self_edges", "orphan_parents", "orphan_children", "several_parents", "cycle_nodes")
    return topology.select(F.explode(F.array(*[F.struct(F.lit(k).alias("warning"), F.col(k).cast("long").alias("n")) for k in names])).alias("w")).select("w.*").where("n > 0")
