"""What is known of how many sessions, and where that falls from run to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# What can be known of a session.
CAPABILITIES = ("rollout_metadata", "token_usage", "token_lineage", "prompt_content", "event_provenance", "tool_activity", "command_extraction", "task_lifecycle", "git_metadata", "duration_timestamps", "repository_attribution", "model_attribution", "provenance_matching", "session_catalogue", "thread_relationships")


def capabilities(sessions: DataFrame, token_events: DataFrame) -> DataFrame:
    """(sid, capability, available), long form."""
    used = token_events.select("sid").distinct().withColumn("used", F.lit(True))
    rows = sessions.join(used, "sid", "left")
    known = {"repository": F.col("repository_root").isNotNull(), "model": F.col("model").isNotNull(), "end_time": F.col("ended_at").isNotNull(), "token_usage": F.col("used").isNotNull()}
    return rows.select("sid", F.explode(F.array(*[F.struct(F.lit(k).alias("capability"), v.alias("available")) for k, v in known.items()])).alias("c")).select("sid", "c.*")


def matrix(facts: DataFrame) -> DataFrame:
    """(sid, capability, status, evidence): fifteen rows a session.

    facts: sid, a count (null: not looked at) under each capability's name, and partial_line, odd_tools, unresolved
    (flags). Available with evidence, not_observed without; degraded where a log is cut short, where tools come
    in an unknown form only, or where no event could be resolved; unknown where nothing was looked at."""
    bad = {"rollout_metadata": F.col("partial_line"), "tool_activity": F.col("odd_tools") & (F.col("tool_activity") == 0), "command_extraction": F.col("odd_tools") & (F.col("command_extraction") == 0), "provenance_matching": F.col("unresolved") & (F.col("provenance_matching") == 0)}
    def one(k: str) -> Column:
        status = F.when(F.col(k).isNull(), "unknown").when(bad.get(k, F.lit(False)), "degraded").when(F.col(k) > 0, "available").otherwise("not_observed")
        return F.struct(F.lit(k).alias("capability"), status.alias("status"), F.coalesce(F.col(k).cast("long"), F.lit(0)).alias("evidence"))

    return facts.select("sid", F.explode(F.array(*map(one, CAPABILITIES))).alias("c")).select("sid", "c.*")


def run_coverage(rows: DataFrame, run: int) -> DataFrame:
    """(run, capability, total, available, degraded, not_observed, unknown, ratio): a run's sessions by status, a row for each capability."""
    by = rows.groupBy("capability").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("available", "degraded", "not_observed", "unknown")])
    return by.select(F.lit(run).alias("run"), "*", (F.col("available") / F.col("total")).alias("ratio"))


def carried(before: DataFrame, run: int) -> DataFrame:
    """The last run's coverage under a new run, for a run in which nothing changed."""
    last = before.agg(F.max("run").alias("last"))
    return before.crossJoin(last).where("run = last").drop("last").withColumn("run", F.lit(run))  # one row


def status(ratio: Column, regressed: Column) -> Column:
    return F.when(ratio.isNull(), "unknown").when(regressed, "regressed").when(ratio == 0, "not_observed").when(ratio < 1, "partial").otherwise("complete")


def snapshot(rows: DataFrame, *run: str) -> DataFrame:
    by = rows.groupBy(*run, "capability").agg(F.count("*").alias("sessions"), F.count_if("available").alias("available"))
    return by.withColumn("ratio", F.col("available") / F.col("sessions"))


def against_previous(snapshots: DataFrame, least: int = 10, drop: float = 0.35) -> DataFrame:
    """With the ratio of the run before, and whether it fell: by drop at least, to half or less, from least sessions or more."""
    w = W.partitionBy("capability").orderBy("run")
    rows = snapshots.select("*", F.lag("ratio").over(w).alias("ratio_before"), F.lag("sessions").over(w).alias("sessions_before"))
    fell = (F.col("sessions_before") >= least) & (F.col("ratio_before") - F.col("ratio") >= drop) & (F.col("ratio") <= F.col("ratio_before") / 2)
    return rows.withColumn("regressed", F.coalesce(fell, F.lit(False)))
