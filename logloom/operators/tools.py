"""Tool activity: calls with their results, and reports over them.

Activity rows: sid, occurred_at, command_category, result_status, and where known executable, fingerprint, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions import shell


def classified(calls: DataFrame, command: str = "command") -> DataFrame:
    """calls with the safe text, fingerprint, executable, category, scope and commit flag of their command.

    Each distinct safe command is taken apart once; a command that very many rows share joins by a
    broadcast or a split of the larger side, as adaptive execution decides."""
    safe = calls.withColumn("__safe", shell.redacted(F.col(command)))
    rows = safe.select(*calls.columns, F.col("__safe.text").alias("text"), F.col("__safe.fingerprint").alias("fingerprint"), F.col("__safe.redacted").alias("redacted"), F.col("__safe.truncated").alias("truncated"))
    once = rows.select("text").where("text IS NOT NULL").distinct().withColumn("h", shell.resolved(F.col("text")))
    name, args = F.col("h.executable"), F.col("h.args")
    kinds = once.select("text", F.col("h.typed").alias("executable"), shell.category(name, args).alias("command_category"), shell.test_scope(name, args).alias("test_scope"), shell.is_commit(name, args).alias("is_commit"))
    return rows.join(kinds, "text", "left")


def paired(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls with the result of the same call id, where that id is one call's and one known (or one single) result's.

    results: sid, call_id, result_status, and what else is told of a result."""
    rest = [c for c in results.columns if c not in ("sid", "call_id")]
    one_call = calls.withColumn("__n", F.count("*").over(W.partitionBy("sid", "call_id")))
    known = F.col("result_status") != "unknown"
    per = results.where("call_id IS NOT NULL").groupBy("sid", "call_id").agg(F.count("*").alias("__all"), F.count_if(known).alias("__known"), F.max_by(F.struct(*rest), F.when(known, 1).otherwise(0)).alias("__result"))
    per = per.where("__known = 1 OR __all = 1").select(F.col("sid").alias("__sid"), F.col("call_id").alias("__id"), "__result")
    rows = one_call.join(per, (F.col("sid") == F.col("__sid")) & (F.col("call_id") == F.col("__id")) & (F.col("__n") == 1), "left")
    return rows.select(*calls.columns, *[F.col(f"__result.{c}").alias(c) for c in rest]).fillna("unknown", ["result_status"])


def summary(activity: DataFrame) -> DataFrame:
    """One row of counts; the failure rate is over known results."""
    c, r = F.col("command_category"), F.col("result_status")
    known = F.count_if(r.isin("success", "failure"))
    return activity.agg(
        F.count("*").alias("calls"),
        F.count_distinct("sid").alias("sessions"),
        F.count_if(c == "testing").alias("tests"),
        F.count_if(c.isin("git_inspection", "filesystem_inspection", "text_search")).alias("inspections"),
        F.count_if(c == "editing_patching").alias("edits"),
        F.count_if(r == "failure").alias("failures"),
        known.alias("known_results"),
        F.when(known > 0, F.count_if(r == "failure") / known).alias("failure_rate"),
    )


def of(activity: DataFrame, categories: list[str] | None = None, sid: int | str | None = None, commands_only: bool = False) -> DataFrame:
    """Activity of some categories, of one session, or with a command."""
    test = F.lit(True)
    if categories:
        test &= F.col("command_category").isin(categories)
    if sid is not None:
        test &= F.col("sid") == sid
    if commands_only:
        test &= F.col("fingerprint").isNotNull()
    return activity.where(test)


def top(activity: DataFrame, key: str, n: int) -> DataFrame:
    return activity.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("calls")).orderBy(F.desc("calls"), key).limit(n)


def repeated(activity: DataFrame, least: int = 2, limit: int | None = None) -> DataFrame:
    """Fingerprints met more than once, with the text of the first; the most frequent of them first."""
    at = F.struct("occurred_at", "event_id")
    rows = activity.where("fingerprint IS NOT NULL").groupBy("fingerprint").agg(
        F.count("*").alias("runs"),
        F.count_distinct("sid").alias("sessions"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
        F.bool_or("redacted").alias("any_redacted"),
        F.bool_or("truncated").alias("any_truncated"),
        F.min_by("text", at).alias("text"),
    ).where(F.col("runs") >= least)
    rows = rows.orderBy(F.desc("runs"), F.lower("text"), "fingerprint")
    return rows.limit(limit) if limit else rows


def per_session(activity: DataFrame) -> DataFrame:
    counts = activity.groupBy("sid", "command_category").agg(F.count("*").alias("n"), F.count_if(F.col("result_status") == "failure").alias("failed"))
    return counts.groupBy("sid").agg(F.sum("n").alias("calls"), F.sum("failed").alias("failures"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("command_category", "n")))).alias("categories"))
